import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import language, quality, toxicity
from logloom.llm.ngrams import SLICE, code_points, hashed, text_buckets

VOCAB = {"aa": ["then", "with", "thing", "over", "about"], "bb": ["der", "und", "nicht", "eine", "auch"], "cc": ["que", "para", "los", "ción", "una"]}


def documents(spark, n=300, seed=0):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(list(VOCAB))
        words = rng.choices(VOCAB[lang], k=rng.randrange(5, 60))
        toxic = rng.random() < 0.3
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vileword", "vilestuff", "nastybit"])
        junk = rng.random() < 0.3
        text = " | ".join(w.upper() + "!!" for w in words) if junk else " ".join(words)
        rows.append((k, text, lang, "s", int(not junk), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, quality int, toxic int")


def test_ngrams_of_slices_are_those_of_the_whole():
    cp = code_points("ab" * 10)
    whole = np.concatenate(list(text_buckets(cp, (3,), 12)))
    assert (whole == hashed(cp, 3, 12)).all() and len(whole) == 18
    assert len(hashed(cp[:2], 3, 12)) == 0
    long = np.arange(SLICE + 100, dtype="<u4")
    assert sum(len(x) for x in text_buckets(long, (3,), 12)) == len(long) - 2


def test_language(spark):
    docs = documents(spark)
    model = language.fit(docs.filter("doc_id % 3 != 0"))
    out = language.identify(docs, model).filter("doc_id % 3 = 0")
    assert out.filter("lang_pred = lang").count() / out.count() > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "und nicht"), (4, "und nicht"), (None, "que los " * 200_000)], "doc_id long, text string").withColumn("LANG_PRED", F.lit(9))
    got = sorted(((r["doc_id"], r["lang_pred"]) for r in language.identify(odd, model).collect()), key=str)
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "bb"), (4, "bb"), (None, "cc")]
    empty = language.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language.identify(docs.limit(3), empty).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_toxicity(spark):
    docs = documents(spark, 600)
    labels = docs.select("doc_id", "quality", "toxic")
    model = toxicity.fit(docs, labels.filter("doc_id % 4 != 0"))
    got = toxicity.score(docs, model).filter("doc_id % 4 = 0").select("toxic", (F.col("toxicity") >= 0.5).cast("int").alias("p")).collect()
    assert sum(r["toxic"] == r["p"] for r in got) / len(got) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "so vileword " + "then " * 100_000)], "doc_id long, text string").selectExpr("*", "'x' y", "1 Toxicity")
    scores = [(r["doc_id"], r["toxicity"]) for r in toxicity.score(odd, model).collect()]
    assert all(0 <= s <= 1 for _, s in scores) and dict(scores)[None] > 0.5 and dict(scores)[1] == dict(scores)[2] < 0.5
    single = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert {round(r["toxicity"], 6) for r in toxicity.score(docs.limit(4), single).collect()} == {0.0}


def test_quality(spark):
    docs = documents(spark, 600)
    labels = docs.select("doc_id", "quality", "toxic")
    model = quality.fit(docs, labels.filter("doc_id % 4 != 0"), rating=F.col("quality") * (F.lit(2) - F.col("toxic")))
    assert model.grades == [0, 1, 2] and model.cuts[0] < model.cuts[1]
    got = quality.grade(docs, model, least=1).filter("doc_id % 4 = 0").collect()
    assert sum(bool(r["quality"]) == r["kept"] for r in got) / len(got) > 0.95
    mean = {q: np.mean([r["expected_grade"] for r in got if r["quality"] == q]) for q in (0, 1)}
    assert mean[1] > mean[0] + 0.5
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x " * 300_000)], "doc_id long, text string").selectExpr("*", "1 kept")
    assert all(0 <= r["tail_prob"] <= 1 for r in quality.grade(odd, model).collect())
    assert quality.fit(docs, labels.limit(0)).grades == [0]


def test_cumulative_gradient_descends():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 5)).astype(np.float32)
    z = x @ np.array([2, -1, 0, 0, 1]) + rng.logistic(size=400)
    y = np.digitize(z, [-1.0, 1.0, 2.0])
    w, cuts = quality._fit_cumulative(x, y, 4, 1e-5, 400)
    assert np.allclose(cuts, [-1.0, 1.0, 2.0], atol=0.5)
    assert np.allclose(w, [2, -1, 0, 0, 1], atol=0.5)


def test_sample_is_bounded(spark):
    from logloom.llm.common import bounded_sample

    got = bounded_sample(spark.range(20000).withColumnRenamed("id", "doc_id"), "doc_id", 500).count()
    assert 350 < got < 650


def test_a_rare_language_is_learned(spark):
    """Five rows among thousands: a sample of the whole table would hold none of them."""
    common = [(k, f"the words of row {k} are plain english ones and more of them", "en") for k in range(3000)]
    rare = [(10_000 + k, "kaikki sanat ovat suomea ja niitä on monta lisää tässä", "fi") for k in range(5)]
    docs = spark.createDataFrame(common + rare, "doc_id long, text string, lang string")
    model = language.fit(docs, train_rows=50)
    assert model.langs == ["en", "fi"]
    assert model.predict("sanat ovat suomea ja monta")[0] == "fi"
    assert model.predict("plain words and more of them")[0] == "en"


def test_empty_tables_repeated_rows_and_clashing_names(spark):
    docs = documents(spark, 200)
    labels = docs.select("doc_id", "quality", "toxic")
    grader = quality.fit(docs, labels)
    judge = toxicity.fit(docs, labels)
    twice = docs.unionByName(docs.limit(20)).selectExpr("*", "'x' Kept", "'y' expected_grade", "'z' Toxicity")
    graded, judged = quality.grade(twice, grader), toxicity.score(twice, judge)
    assert graded.count() == judged.count() == twice.count()
    assert graded.groupBy("text").agg(F.countDistinct("expected_grade").alias("n")).filter("n > 1").isEmpty()
    assert judged.groupBy("text").agg(F.countDistinct("toxicity").alias("n")).filter("n > 1").isEmpty()
    none = docs.limit(0)
    assert quality.grade(none, grader).count() == toxicity.score(none, judge).count() == 0
    for empty in (quality.fit(none, labels.limit(0)), quality.fit(none, labels)):
        assert quality.grade(docs, empty).count() == docs.count()
    for empty in (toxicity.fit(none, labels.limit(0)), toxicity.fit(none, labels)):
        assert all(0 <= r["toxicity"] <= 1 for r in toxicity.score(docs, empty).collect())


def test_ids_and_sources_are_no_input(spark):
    docs = documents(spark, 200)
    labels = docs.select("doc_id", "quality", "toxic")
    judge = toxicity.fit(docs, labels)
    a = {r["text"]: r["toxicity"] for r in toxicity.score(docs, judge).collect()}
    b = {r["text"]: r["toxicity"] for r in toxicity.score(docs.withColumn("doc_id", -F.col("doc_id")), judge).collect()}
    assert a == b


DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    known = docs.join(labels, "doc_id")
    model = quality.fit(docs, labels.filter("doc_id % 5 != 0"))
    got = quality.grade(known.filter("doc_id % 5 = 0"), model).select("quality", "kept").collect()
    assert sum(bool(r["quality"]) == r["kept"] for r in got) >= 0.95 * len(got)
    names = language.fit(docs.filter("doc_id % 4 != 2"))
    said = language.identify(docs.filter("doc_id % 4 = 2 and lang is not null and length(text) > 100"), names).select("lang", "lang_pred").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in said) >= 0.97 * len(said)
