import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import packing


@pytest.mark.parametrize(("n", "want"), [(1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (16, [(0, 8), (8, 8)]), (20, [(0, 4), (4, 8), (12, 8)])])
def test_cut(n, want):
    assert packing.cut(n, 8) == want


def fresh():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TRUTH = fresh()


def test_ids_are_those_of_the_unaltered_tokenizer():
    enc = packing.Encoder.get(*packing.vocabulary())
    texts = ["Hello  world\n\n it's 12,345 €", "<|endoftext|> x", "a<|endoftext|>", "<|endoftext", "naïve Straße çà ñandú", "a" * 500, " \t\n ", "日本語 text", " x­", "don't WE'LL", "\x00\x85\xa0 \xad½²ª"]
    for t in texts:
        assert enc.ids(t).tolist() == TRUTH.encode(t, add_special_tokens=False).ids
    assert enc.ids("a<|endoftext|>")[-1] == TRUTH.token_to_id("<|endoftext|>")
    assert enc.fast is not None


@given(st.text(alphabet=st.characters(max_codepoint=255), max_size=80))
@settings(max_examples=300, deadline=None)
def test_ids_of_latin_1_texts(text):
    enc = packing.Encoder.get(*packing.vocabulary())
    assert enc.ids(text).tolist() == TRUTH.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("lo", "hi"), [(300, 1300), (650, 720), (500, 1100)])
def test_local_search_saves_bins(lo, hi):
    lengths = np.random.default_rng(lo).integers(lo, hi, 600)
    start = packing.best_fit(lengths, 2048)
    got = packing.local_search(lengths, start.copy(), 2048)
    fill = np.bincount(got, weights=lengths)
    assert fill.max() <= 2048 and fill.sum() == lengths.sum()
    assert len(np.unique(got)) < len(np.unique(start))


def test_no_trade_is_left():
    lengths = np.random.default_rng(3).integers(20, 60, 40)
    got = packing.local_search(lengths, packing.best_fit(lengths, 100), 100, effort=10**6)
    fill = np.bincount(got, weights=lengths)
    for k, g in enumerate(got):  # a move or an exchange that would raise the sum of squares
        for b in np.unique(got):
            if b == g or fill[g] == 100 or fill[b] == 100:
                continue
            for back in [0, *lengths[got == b]]:
                gain = lengths[k] - back
                assert gain <= 0 or fill[b] + gain > 100 or fill[b] + gain <= fill[g]


@given(st.lists(st.integers(1, 99), min_size=1, max_size=60))
@settings(max_examples=150, deadline=None)
def test_assign_packs_every_item_once(sizes):
    lengths = np.array(sizes)
    bins, offset = packing.assign(lengths, 100)
    for b in range(bins.max() + 1):
        at = np.flatnonzero(bins == b)
        order = at[np.argsort(offset[at])]
        assert len(at) and lengths[at].sum() <= 100
        assert offset[order].tolist() == (np.cumsum(lengths[order]) - lengths[order]).tolist()
    first = len(np.unique(packing.best_fit(lengths, 100)))
    assert -(-lengths.sum() // 100) <= bins.max() + 1 <= first


def test_local_search_empties_bins():
    lengths = np.array([60, 30, 50, 40, 10, 10])
    start = np.array([0, 1, 2, 1, 3, 2])  # 60 | 30+40 | 50+10 | 10
    got = packing.local_search(lengths, start.copy(), 100)
    assert len(np.unique(got)) < 4
    fill = np.bincount(got, weights=lengths)
    assert fill.max() <= 100 and (fill**2).sum() > (np.bincount(start, weights=lengths) ** 2).sum()


def test_pack_table(spark):
    long = "many words " * 3000
    rows = [(1, "a b c"), (2, None), (3, ""), (4, long), (4, "a b c"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 length", "2 id", "3 sequence_id")
    out = [r.asDict() for r in packing.pack(packing.pieces(docs, window=512, with_ids=True), window=512).collect()]
    enc = packing.Encoder.get(*packing.vocabulary())
    whole = {}
    for r in out:
        assert r["crc"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        assert len(r["ids"]) == r["length"] <= 512
        whole.setdefault((r["id"], r["row"]), []).append(r)
    assert len(whole) == len(rows)
    texts = sorted(((i if i is not None else -1), (enc.ids(t).tolist() if t else []) + [0]) for i, t in rows)
    got = sorted(((k[0] if k[0] is not None else -1), [x for r in sorted(v, key=lambda r: r["piece"]) for x in r["ids"]]) for k, v in whole.items())
    assert got == texts
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in places.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 512


def test_pack_empty_table(spark):
    assert packing.pack(packing.pieces(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_groups_are_bounded(spark):
    docs = spark.range(400).selectExpr("id doc_id", "repeat('word ', cast(id % 37 as int)) text")
    out = packing.pack(packing.pieces(docs, window=64), window=64, group=50).toPandas()
    total = out["length"].sum()
    assert len(out) >= 400 and out.groupby("sequence_id")["length"].sum().max() <= 64
    assert out["sequence_id"].nunique() <= -(-total // 64) + 8 + 2
