"""Deleted interpolation against counters and loops in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import interpolation
from logloom.llm.common import crc_mod

WORD = re.compile("[^\x20\x09-\x0d]+")
END, BEGIN = "</>", "<>"  # neither is a word of the texts here


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), END]


def grams(text, order):
    t = [BEGIN] * (order - 1) + tokens(text)
    return [tuple(t[k - o + 1 : k + 1]) for o in range(1, order + 1) for k in range(order - 1, len(t))]


class Plain:
    """Counts of some texts, and the mixture by given weights."""

    def __init__(self, texts, order, types=None):
        self.order = order
        self.count = Counter(g for t in texts for g in grams(t, order))
        self.n = sum(len(tokens(t)) for t in texts)
        self.texts = len(texts)
        self.types = sum(len(g) == 1 for g in self.count) if types is None else types

    def context(self, gram):
        if len(gram) == 1:
            return self.n
        return self.texts if gram[-2] == BEGIN and set(gram[:-1]) == {BEGIN} else self.count[gram[:-1]]

    def steps(self, gram, weights):
        """(order, level, own part, probability) from the lowest order up."""
        p, out = 1 / (self.types + 1), []
        for o in range(1, self.order + 1):
            c = self.context(gram[-o:])
            level = min(c.bit_length(), interpolation.LEVELS - 1) if o > 1 else int(self.n > 0)
            own = weights[o - 1][level] * (self.count[gram[-o:]] / c if c else 0)
            p = own + (1 - weights[o - 1][level]) * p
            out.append((o, level, own, p))
        return out

    def weigh(self, texts, rounds):
        w = [[0.0] + [0.5] * (interpolation.LEVELS - 1) for _ in range(self.order)]
        whole = [g for t in texts for g in grams(t, self.order) if len(g) == self.order]
        last = None
        for _ in range(rounds if whole else 0):
            own, uses, score = Counter(), Counter(), 0.0
            for g in whole:
                reaches, steps = 1.0, self.steps(g, w)
                score += math.log10(steps[-1][3])
                for o, level, x, p in reversed(steps):
                    own[o, level] += reaches * x / p
                    uses[o, level] += reaches
                    reaches *= 1 - x / p
            w = [[0.0] + [(own[o, k] + 0.5) / (uses[o, k] + 1) for k in range(1, interpolation.LEVELS)] for o in range(1, self.order + 1)]
            if last is not None and score - last < interpolation.GAIN * len(whole):
                break
            last = score
        return w


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    vocabulary = [f"w{k}" for k in range(40)] + ["Ä", "ä", "X", "x\x00y", "--", "a\x85b"]

    def say(n):
        out = [rnd.choice(vocabulary)]
        while len(out) < n:
            out.append(vocabulary[(hash_of(out[-1]) * 3 + rnd.randint(0, 3)) % 20] if rnd.random() < 0.7 else rnd.choice(vocabulary))
        return rnd.choice([" ", "\n", " \t\x0b"]).join(out)

    def hash_of(w):
        return sum(map(ord, w))

    docs = [(k, say(rnd.randint(1, 30))) for k in range(250)]
    return docs + [(250, None), (251, ""), (252, " \n "), (3, docs[3][1]), (3, docs[3][1]), (None, say(8)), (253, say(5000)), (254, "never seen words here")]


@pytest.mark.parametrize("order, chunk, buckets", [(3, 1 << 20, 64), (2, 100, 8), (1, 37, 1)])
def test_equals_plain_counts(spark, texts, monkeypatch, order, chunk, buckets):
    monkeypatch.setattr(interpolation, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(interpolation, "LEAST_BUCKETS", buckets)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, chunk int, score string").repartition(3)
    part = crc_mod("doc_id", 7)
    tagged = df.select("doc_id", "text", part.alias("part")).collect()
    out, model = interpolation.score(df, part != 2, part == 5, order=order)
    got = sorted((tuple(r) for r in out.select("id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=repr)
    train = Plain([r["text"] for r in tagged if r["part"] != 2], order)
    kept = Plain([r["text"] for r in tagged if r["part"] not in (2, 5)], order, train.types)
    weights = kept.weigh([r["text"] for r in tagged if r["part"] == 5], interpolation.ROUNDS)
    assert (model.tokens, model.types) == (train.n, train.types)
    assert model.weights == pytest.approx(np.array(weights), abs=1e-9)
    want = []
    for r in tagged:
        t = tokens(r["text"])
        base = sum(math.log10((train.count[w,] + 1) / (train.n + train.types + 1)) for w in t)
        whole = sum(math.log10(train.steps(g, weights)[-1][3]) for g in grams(r["text"], order) if len(g) == order)
        want.append((r["doc_id"], r["part"] != 2, len(t), sum(train.count[w,] > 0 for w in t), train.n, base, whole))
    for a, b in zip(got, sorted(want, key=repr), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    if order > 1:
        held = [r for r in got if not r[1]]
        assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_probabilities_add_up(texts):
    model = Plain([t for _, t in texts[:200]], 3)
    weights = model.weigh([t for _, t in texts[200:250]], 3)
    words = [g[0] for g in model.count if len(g) == 1]
    for context in ((BEGIN, BEGIN), (BEGIN, "w1"), ("w1", "w2"), ("nowhere", "w3"), ("nowhere", "never")):
        assert sum(model.steps((*context, w), weights)[-1][3] for w in [*words, "unseen"]) == pytest.approx(1)


def test_nothing_to_learn_from(spark, texts):
    df = spark.createDataFrame(texts[:20], "doc_id long, text string")
    out, model = interpolation.score(df, F.lit(None).cast("boolean"), F.lit(True))
    assert model.tokens == 0 and [(r["n_known"], r["base_score"], r["score"]) for r in out.collect()] == [(0, 0.0, 0.0)] * 20
    out, _ = interpolation.score(df, F.lit(True), F.lit(False))  # no text tells the weights
    assert all(r["n_known"] == r["n_tokens"] and r["score"] < 0 for r in out.collect())
    out, _ = interpolation.score(df.limit(0), F.lit(True), F.lit(False))
    assert out.count() == 0
