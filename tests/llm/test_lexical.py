"""Lexical search against scoring every document, and the cases that its docstring states."""

import math
import random
import re
from collections import Counter

import pytest

from logloom.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    """Scores by the formula, in plain integers, over rows (id, text)."""
    counts = [(i, Counter(split(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in counts if c), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for row, (doc_id, c) in enumerate(counts):
            s = 0
            for t in set(split(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 10 + 90 * c.total() * n_docs // n_terms
                    s += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if s > 0:
                scored.append((-s, doc_id is not None, doc_id or 0, row))
        for rank, (s, known, doc_id, _) in enumerate(sorted(scored)[:k], 1):
            out.append((item_id, rank, doc_id if known else None, -s))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)] + ["Über", "ÜBER", "a1", "Ünter", "x"]
    say = lambda n: " ".join(rnd.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=n))
    docs = [(k, say(rnd.randint(1, 60))) for k in range(300)]
    docs += [(300, None), (301, ""), (302, "--- ..."), (None, say(20)), (7, say(9)), (7, docs[7][1]), (303, say(20_000)), (304, "W1,w2;W3\x00w4_w5")]
    items = [(k, say(rnd.randint(1, 12))) for k in range(25)] + [(25, None), (26, "?"), (27, "nowhere"), (3, say(4)), (None, "w1 w9"), (28, "w1 W1 w1")]
    return docs, items


@pytest.mark.parametrize("share, terms_a_pass, k", [(0.6, 200_000, 10), (1.0, 40, 3), (0.1, 200_000, 500)])
def test_equals_scoring_all_documents(spark, corpus, share, terms_a_pass, k):
    docs, items = corpus
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, rank int").repartition(3)
    q = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    got = lexical.search(d, q, k=k, share=share, terms_a_pass=terms_a_pass)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert rows(got) == brute(docs, items, k)


def test_lists_in_pieces(spark, corpus, monkeypatch):
    monkeypatch.setattr(lexical, "PIECE_ROWS", 7)
    docs, items = corpus
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == brute(docs, items, 10)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs, spark.createDataFrame([(1, "z")], "item_id long, text string")).count() == 0
