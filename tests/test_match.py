"""The match join against compiled patterns, on texts and templates that differ in hard places."""

import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from logloom.functions import align, shared
from logloom.operators import match

LAST = chr(0x10FFFF)


def made(seed, n=120):
    """Messages of words, signs and line ends of all kinds but \\n; and templates with the classes that some of them show."""
    rnd = random.Random(seed)
    words = ["user", "left", "a.b", "x=1", "12", "v7", "Ünï", "日本", "(3)", "[x]", "½", "a\rb", "c\x85d", "e f", "g\th", "$^", "&&", "a-b"]
    messages = {" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6))) for _ in range(n)} | {"", " ", "user  left", "12 12"}
    templates: dict[str, list[set[str]]] = {}
    for m in sorted(messages):
        for _ in range(2):
            t = "".join("<*>" if rnd.random() < 0.3 and x != " " else x for x in align.words(m))
            p = align.realign(t, m)
            known = templates.setdefault(p.template, [set() for _ in p.classes])
            for have, more in zip(known, p.classes, strict=True):
                have |= more if rnd.random() < 0.9 else set()
    return sorted(messages), templates | {"<*>": [{"alpha", "digit", " ", "-"}], "<*>.": [{"alpha"}]}


def frames(spark, messages, templates):
    lines = spark.createDataFrame([(m,) for m in messages] + [(None,), (messages[0],)], "content string").repartition(3)
    return lines, spark.createDataFrame([(t, [sorted(c) for c in k]) for t, k in templates.items()] + [(None, None)], "template string, classes array<array<string>>")


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_decide_as_in_the_catalog(spark, seed):
    messages, templates = made(seed)
    lines, table = frames(spark, messages, templates)
    got = {r["content"]: r["template"] for r in match.match_join(lines, table, classes_col="classes").collect()}
    names = sorted(templates)
    catalog = match.Catalog([match.Entry(k, t, templates[t]) for k, t in enumerate(names)])
    want = {m: names[k] for m in messages if (k := catalog.match(m)) != -1}
    assert got == want and len(want) > 50
    anything = match.match_join(lines, table).collect()
    assert {r["content"] for r in anything} == set(messages)  # <*> takes all


def test_line_ends_inside(spark):
    lines = spark.createDataFrame([("user a\rb left",), ("user a\x85b left",), ("user a b left",), ("user a left\n",), ("user a left",)], "content string")
    got = match.match_join(lines, spark.createDataFrame([("user <*> left",)], "template string")).collect()
    assert sorted(r["content"] for r in got) == sorted(["user a\rb left", "user a\x85b left", "user a b left", "user a left"])


def test_best_template_of_all(spark):
    """Against every template: literal ends of all lengths, texts that are templates, and the greatest character itself."""
    rnd = random.Random(5)
    words = ["connection", "from", "x", "12", "", LAST, "closed after", "(3)", "<*>", "the listening socket", "a.b"]
    messages = {" ".join(rnd.choices(words, k=rnd.randint(1, 7))) for _ in range(250)}
    templates = {"".join("<*>" if rnd.random() < p else x for x in re.findall("<.>|[^ ]+| ", m)) for m in sorted(messages) for p in (0, 0.1, 0.3)}
    rx = {t: re.compile("(?s)" + ".*".join(map(re.escape, t.split("<*>")))) for t in templates}
    key = lambda t: t.replace("<*>", LAST).encode()
    fits = {m: [key(t) for t in templates if rx[t].fullmatch(m)] for m in messages}
    lines = spark.createDataFrame([(m,) for m in messages], "content string").repartition(3)
    got = {r["content"]: key(r["template"]) for r in match.match_join(lines, spark.createDataFrame([(t,) for t in templates], "template string")).collect()}
    assert got == {m: min(k) for m, k in fits.items() if k}


def test_a_text_is_read_once(spark):
    """Going back over the places of six parts took a time with the sixth power of the length."""
    lines = spark.createDataFrame([("start of it " + "x " * 4000 + "end of it",)], "content string")
    table = spark.createDataFrame([("start of it <*> x <*> x <*> x <*> x <*> x <*> y <*> end of it",)], "template string")
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    late.start()
    assert match.match_join(lines, table).count() == 0
    late.cancel()


def test_texts_that_are_templates_are_not_looked_up(spark, monkeypatch):
    """Only the others meet templates with wildcards: copies of a long text for each of its words filled the disk."""
    lines = spark.createDataFrame([("rare words of a long text",), ("page 7 of a long text",)], "content string")
    table = spark.createDataFrame([("rare words of a long text",), ("page <*> of a long text",), ("rare words <*>",)], "template string")
    seen = []
    monkeypatch.setattr(match, "join_in_blocks", lambda few, many, *a: (seen.extend(r["content"] for r in many.collect()), shared.join_in_blocks(few, many, *a))[1])
    assert {(r["content"], r["template"]) for r in match.match_join(lines, table).collect()} == {("rare words of a long text",) * 2, ("page 7 of a long text", "page <*> of a long text")}
    assert seen == ["page 7 of a long text"]


def test_frequent_keys_go_in_blocks(spark, monkeypatch):
    """Every content has the only word of every template."""
    monkeypatch.setattr(shared.join_in_blocks, "__defaults__", (20,))
    lines = spark.range(500).select(F.concat(F.lit("n"), F.col("id") % 50, F.lit(" the "), F.col("id").cast("string")).alias("content"))
    table = spark.createDataFrame([(f"n{k} the <*>",) for k in range(50)] + [("<*> the <*>",), ("<*>:<*>",), ("<*>",)], "template string")
    got = match.match_join(lines, table).groupBy("template").count().collect()
    assert {r["template"]: r["count"] for r in got} == {f"n{k} the <*>": 10 for k in range(50)}


def test_empty(spark):
    none = spark.createDataFrame([], "content string, template string")
    one = spark.createDataFrame([("a", "<*>")], "content string, template string")
    assert match.match_join(none, one).count() == 0 and match.match_join(one, none).count() == 0
