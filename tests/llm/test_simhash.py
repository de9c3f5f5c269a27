import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import simhash
from logloom.llm.common import local_components


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for c in lowered + " ":
        if c == " " or "\x09" <= c <= "\x0d":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@given(st.text(alphabet="aB é \n\t\x0b1", max_size=40))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def clusters(rng, budget, n=40):
    out = set()
    for _ in range(n):
        base = int(rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(int(rng.integers(1, 30))):
            x = base
            for _ in range(int(rng.integers(0, budget + 3))):
                x ^= 1 << int(rng.integers(0, 64))
            out.add(x)
    return np.array(sorted(out), dtype=np.uint64)


def brute_components(v, budget):
    i, j = np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= budget)
    return local_components(len(v), i, j)


@pytest.mark.parametrize("budget", [0, 1, 2, 3, 5, 8])
@pytest.mark.parametrize("hot", [4, 1 << 18])
def test_trie_links_join_all_near_pairs(spark, budget, hot):
    v = clusters(np.random.default_rng(budget), budget)
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    links = np.array([(r["u"], r["v"]) for r in simhash.trie_links(df, budget, hot).collect()], dtype=np.int64).reshape(-1, 2).view(np.uint64)
    assert (np.bitwise_count(links[:, 0] ^ links[:, 1]) <= budget).all()
    got = local_components(len(v), np.searchsorted(v, links[:, 0]), np.searchsorted(v, links[:, 1]))
    assert (got == brute_components(v, budget)).all()


def test_dense_cluster_gives_few_links(spark):
    base = 0x0123456789ABCDEF
    v = sorted({base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)} | {base})
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in v], "fp long")
    assert simhash.trie_links(df, 2).count() <= 3 * len(v)


def test_near_duplicates_edge_cases(spark):
    long = " ".join(f"w{k}" for k in range(300))
    rows = [(5, None), (3, ""), (9, " \n"), (7, "a b c d"), (7, "a b c d"), (8, "A b  c\td"), (None, "a b c d"), (1, long), (2, long + " x"), (None, "only one here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' fp", "1 component_id", "2 id")
    got = sorted(((r["id"] is None, r["id"] or 0, r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert len(got) == len(rows)
    by = {r[1]: r[2] for r in got if not r[0]}
    assert by[5] == by[3] == by[9] == 3
    assert by[7] == by[8] == 7
    nulls = sorted((r[2] for r in got if r[0]), key=str)
    assert nulls == [7, None]


def test_near_duplicates_of_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert simhash.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_copies(spark):
    rng = np.random.default_rng(3)
    words = [f"word{k}" for k in range(2000)]
    docs, truth = [], {}
    for g in range(30):
        base = [words[k] for k in rng.integers(0, 2000, 300)]
        for c in range(4):
            copy = list(base)
            for k in rng.integers(0, 300, 0 if c < 2 else 4):
                copy[k] = "other"
            truth[len(docs)] = g
            docs.append((len(docs), " ".join(copy)))
    docs += [(1000, "of the a"), (1001, "the of b"), (1002, None), (1003, "")]
    got = {r["id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[d] == min(x for x, y in truth.items() if y == g) for d, g in truth.items())
    assert (got[1000], got[1001], got[1002], got[1003]) == (1000, 1001, 1002, 1002)


def exact_similarity(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_near_copies_below_the_similarity_stay_apart(spark):
    rng = np.random.default_rng(11)
    docs, pairs = [], []
    for g in range(40):
        base = [f"g{g}w{k}" for k in rng.integers(0, 2000, 300)]
        copy = list(base)
        for k in range(20, 300, 300 // 9):  # nine edits: 45 of 296 shingles, a similarity of 0.74
            copy[k] = f"x{g}"
        pairs.append((2 * g, 2 * g + 1))
        docs += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
    text = dict(docs)
    assert all(0.7 < exact_similarity(text[a], text[b]) < 0.8 for a, b in pairs)
    got = {r["id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: d for d in text}


def test_near_copies_links_every_near_pair(spark):
    rng = np.random.default_rng(5)
    docs = []
    for g in range(12):  # copies of one base: they link with it, and by chance with one another
        base = [f"g{g}w{k}" for k in rng.integers(0, 2000, 300)]
        for c in range(14):
            copy = list(base)
            for k in rng.integers(0, 300, 0 if c == 0 else 1 + c):
                copy[k] = f"x{k}"
            docs.append((100 * g + c, " ".join(copy)))
    docs += [(5000, "a b c d e f g h"), (5001, "b a c d e f g h"), (5002, "c d e f g h a b"), (5003, "c d e f g h a b a")]  # one set of words
    fps = [simhash.text_print(t.encode())[0] for _, t in docs]
    near = [(i, j) for j in range(len(docs)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 8 and exact_similarity(docs[i][1], docs[j][1]) >= 0.8]
    label = local_components(len(docs), np.array([i for i, _ in near]), np.array([j for _, j in near]))
    want = {docs[k][0]: docs[x][0] for k, x in enumerate(label.tolist())}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (4, simhash.COPY_BLOCK):
        assert {r["id"]: r["component_id"] for r in simhash.near_copies(df, block=block).collect()} == want


def test_sketches_let_similar_texts_pass():
    rng = np.random.default_rng(8)
    for n in (1, 3, 6, 20, 80, 300, 3000):
        base = [f"w{k}" for k in rng.integers(0, 10**6, n + 4)]
        for edits in (0, 1, n // 60, n // 50):
            copy = list(base)
            for k in range(edits):
                copy[(k * 45 + 3) % len(copy)] = f"x{k}"
            a, b = " ".join(base), " ".join(copy)
            if exact_similarity(a, b) >= 0.8:
                s = np.stack([simhash.text_print(t.encode())[3] for t in (a, b)])
                assert simhash.may_be_similar(s, np.array([0]), np.array([1]), 0.8).all()
    texts = [" ".join(f"t{g}w{k}" for k in rng.integers(0, 500, 200)) for g in range(40)]
    s = np.stack([simhash.text_print(t.encode())[3] for t in texts])
    i, j = np.triu_indices(len(texts), 1)
    assert not simhash.may_be_similar(s, i, j, 0.8).any()


@pytest.mark.parametrize("most", [50, 1 << 21])
def test_walk_meets_all_pairs_of_a_repeated_value(most):
    rng = np.random.default_rng(1)
    v = np.sort(np.repeat(np.array([5, 7, 1 << 40], dtype=np.uint64), [300, 40, 60]))
    kind = rng.integers(0, 6, len(v))
    forest = simhash.Forest(len(v))
    simhash.trie_walk(v, [(0, len(v), 0, len(v), 0)], 0, tuple([2] * 65), forest, check=lambda i, j: kind[i] == kind[j], most=most)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 2
    i, j = np.nonzero(near & (kind[:, None] == kind[None, :]))
    assert (local_components(len(v), *forest.edges()) == local_components(len(v), i, j)).all()


def test_near_copies_equal_brute_force_over_texts_with_like_words(spark):
    rng = np.random.default_rng(21)
    words = [f"w{k}" for k in range(60)]  # few words: most texts are near by fingerprint, few by shingles
    docs = []
    for g in range(400):
        base = [words[k] for k in rng.integers(0, 60, 120)]
        docs.append(" ".join(base))
        for c in range(int(rng.integers(0, 8))):
            copy = list(base)
            if c == 3:
                rng.shuffle(copy)
            for k in rng.integers(0, 120, c % 4):
                copy[k] = words[int(rng.integers(0, 60))]
            docs.append(" ".join(copy))
    fp = np.array([simhash.text_print(t.encode())[0] for t in docs], dtype=np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 8, 1))
    ok = np.array([exact_similarity(docs[a], docs[b]) >= 0.8 for a, b in zip(i.tolist(), j.tolist(), strict=True)])
    assert 0 < ok.sum() < len(ok) / 2
    want = local_components(len(docs), i[ok], j[ok])
    got = {r["id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), block=64).collect()}
    assert [got[k] for k in range(len(docs))] == want.tolist()


@pytest.mark.parametrize("block", [1024, 5])
def test_no_near_copy_of_a_short_text_is_missed(spark, block):
    """One word changed, put in or left out, at every length from 5 words up: the components are those of all pairs."""
    rng = np.random.default_rng(8)
    texts = ["", "a", "a b"]
    for n in (5, 6, 8, 10, 12, 16, 20, 24, 32, 40, 64, 90, 100):
        for _ in range(6):
            words = [f"w{x}" for x in rng.integers(0, 400, n)]
            texts.append(" ".join(words))
            for _ in range(4):
                k, kind = int(rng.integers(0, n)), int(rng.integers(0, 4))
                texts.append(" ".join([words[:k] + ["new"] + words[k + 1 :], words[:k] + ["put"] + words[k:], words[:k] + words[k + 1 :], [*words, f"end{k}"]][kind]))
    sets = [set(simhash.shingles(t.encode()).tolist()) for t in texts]
    short = [0 < len(s) <= simhash.SHORT for s in sets]
    i, j = np.array([(a, b) for a in range(len(texts)) for b in range(a) if texts[a] == texts[b] or (short[a] and short[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))], dtype=np.int64).T
    want = local_components(len(texts), i, j)
    got = {r["id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=block).collect()}
    for k in range(len(texts)):
        if short[k]:
            assert got[k] == want[k]
    linked = np.array([len(simhash.shingles(t.encode())) for t in texts])[i]
    assert len(set(linked.tolist())) > 8
