import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from logloom.llm import queries
from logloom.llm.common import checkpoint

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "decontamination", "packing"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = c.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(cols).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("op6_licenses", "op12_upsert")])
def test_query_covers_its_table(spark, name):
    """op12 returns files, whose rows its own test compares."""
    table = {"op3_warc": "pages", "op4_html": "pages", "op7_embeddings": "embeddings", "op11_lexical": "benchmark"}.get(name, "documents")
    key = {"pages": "page_id", "embeddings": "vec_id", "benchmark": "item_id"}.get(table, "doc_id")
    ids = {r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect()}
    out = queries.QUERIES[name](spark, DATA)
    assert {r[0] for r in out.select(key).collect()} == ids


def test_stages_only_take_rows_away(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {tuple(r) for r in docs.collect()}
    extra = [(10_001, "12 ?!", "en", "s", 5), (10_002, None, None, None, None), (None, "no id but text here", "en", "s", 19)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    copy = docs.filter("n_chars > 300").limit(1).first()
    docs = docs.unionByName(spark.createDataFrame([(10_003, copy["text"] + " x", "en", "s", 1)], docs.schema))
    leak = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    docs = docs.unionByName(spark.createDataFrame([(10_004, "Words here. " + leak, "en", "s", 1)], docs.schema))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    left = {tuple(r) for r in docs.collect()}
    ids = {r[0] for r in left}
    assert not ids & {10_001, 10_002, 10_003, 10_004}
    assert left - {r for r in left if r[0] is None} <= before
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() >= len(left)


def words(text):
    return [w for w in re.split(r"[ \t\n\v\f\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def test_run_against_brute_force(spark):
    """Stage by stage on all rows: near copies by exact similarity of all pairs, passages by containment, packing by its ids."""
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:2]:
        frame = checkpoint(stage(spark, frame, DATA))
    left = sorted(r["doc_id"] for r in frame.collect())
    sets = {d: shingle_set(docs[d]["text"]) for d in left}
    links = [(a, b) for k, b in enumerate(left) for a in left[:k] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    low = {d: d for d in left}
    for _ in left:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    once = [d for d in left if low[d] == d]
    clean = [d for d in once if not any(" ".join(words(t)) in " ".join(words(docs[d]["text"])) for t in items)]
    assert len(clean) < len(once) < len(left) < len(docs)
    out = corpus_pipeline.run(spark, DATA).collect()
    assert sorted({r["doc_id"] for r in out}) == clean
    truth = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = {}, {}
    for r in out:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, got in pieces.items():
        ids = np.array([*truth.encode(docs[d]["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for k, r in enumerate(sorted(got, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() == 0
