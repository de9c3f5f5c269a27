"""The lenient comparison's rewrites, each to its end, against a plain loop."""

import random
import re
import time

from logloom.functions import normalise
from pyspark.sql import functions as F


def looped(t):
    for pattern, to in normalise.RULES:
        while True:
            n = re.sub(pattern, to.replace("\\", "\\\\"), t)
            if n == t:
                break
            t = n
    return t


def test_rewrites_go_on_until_nothing_changes(spark):
    rnd = random.Random(1)
    parts = ["<*>", "##", "#", "(", ")", "((", "[", "]", "<", ">", "'", '"', " ", "a", "ms", ".", ",", ":", "-", "<*", "@", "{", "|"]
    texts = [">##>##>", ">##>##>##>", "<*>##<*>##<*>", "(((<*>)))", "[[<*>]", "<<<*>>>", '""<*>""', "##<*>##", ""]
    texts += ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["n"] for r in df.select("t", normalise.comparable(F.col("t")).alias("n")).collect()}
    assert got == {t: looped(t) for t in texts}


def test_long_text_takes_as_many_steps_as_it_nests(spark):
    long = "word (<*>) " * 10_000
    df = spark.createDataFrame([(long,)], "t string")
    began = time.perf_counter()
    got = df.select(normalise.comparable(F.col("t")).alias("n")).first()["n"]
    assert time.perf_counter() - began < 20 and "(" not in got
