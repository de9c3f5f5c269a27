"""Candidates of the merge rule against the kernel over all pairs."""

import random

import pytest

from logloom.functions import align
from logloom.operators import mine, pairs


def mixed(n, seed):
    """Templates of many shapes: related and unrelated, with punctuation, wildcards in and between words, and none."""
    rnd = random.Random(seed)
    words = ["error", "disk", "full", "user", "open", "file", "a.b.c", "x=<*>", "(<*>)", "io-wait", "Ünicode", "日本", "7", "v2", "to", "of"]
    made = {"<*>", "<*> <*>", "<*> 7", "<*> <*> <*>", "", " ", "...", "error", "error error", "<*", "a<*>b"}
    while len(made) < n:
        t = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 4, 6, 9, 14]))]
        for _ in range(rnd.randint(1, 4)):
            v = list(t)
            for _ in range(rnd.randint(0, 3)):
                k = rnd.randrange(len(v))
                v[k] = rnd.choice(["<*>", "<*> <*>", v[k], rnd.choice(words), "", f"{v[k]}:<*>"])
            made.add(" ".join(x for x in v if x or rnd.random() < 0.2))
    return sorted(made)


@pytest.mark.parametrize("seed, block", [(1, 1000), (2, 7)])
def test_all_mergeable_pairs_meet(spark, monkeypatch, seed, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    templates = mixed(400, seed)
    df = spark.createDataFrame([(t,) for t in templates] + [(templates[0],), (None,)], "template string").repartition(3)
    want = {}
    for i, a in enumerate(templates):
        for b in templates[i + 1 :]:
            ok, m = align.judge(*sorted((a, b)))
            if ok:
                want[tuple(sorted((a, b)))] = m.template
    got = [tuple(r) for r in pairs.mergeable_pairs(df).collect()]
    assert len(got) == len(set(got)) and {(a, b): m for a, b, m in got} == want and len(want) > 200


def test_merges_into_one_of_two_are_among_the_contained(spark):
    """And clusters by them equal those of all pairs."""
    templates = mixed(250, 4)
    df = spark.createDataFrame([(t,) for t in templates], "template string")
    got = {(r["a"], r["b"]) for r in pairs.contained_pairs(df).collect()}
    root = {t: t for t in templates}

    def top(t):
        while root[t] != t:
            t = root[t]
        return t

    n = 0
    for i, a in enumerate(templates):
        for b in templates[i + 1 :]:
            x, y = sorted((a, b))
            ok, m = align.judge(x, y)
            if ok and m.template in (a, b):
                assert (x, y) in got
                n += 1
                low, high = sorted((top(a), top(b)))
                root[high] = low
    assert n > 50
    assert {r["template"]: r["root"] for r in mine.merge_clusters(df).collect()} == {t: top(t) for t in templates}


def test_unrelated_templates_do_not_meet(spark):
    """Common words bring no long templates together."""
    rnd = random.Random(3)
    templates = [" ".join(["the", "of", "to", *(f"w{rnd.randrange(10**6)}" for _ in range(9)), "<*>"]) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in templates], "template string")
    assert pairs.rule_pairs(df).count() < 300


def test_empty(spark):
    assert pairs.mergeable_pairs(spark.createDataFrame([], "template string")).count() == 0
