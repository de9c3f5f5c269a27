"""Pairs of templates that the merge rule can take: candidates that miss none of them.

`align.judge` merges two templates that are equal but for wildcards in a row,
that differ in a fifth of their tokens at most, or whose differences wildcards
cover on one side. Each case bounds how many words of a template can be without
a partner in the other, so a template needs to meet others by its rarest words
only: one more than may lack a partner.

* Equal but for wildcards: both have one form.
* A fifth: at most a tenth of both token counts together lacks a partner, and the
  counts differ by no more than that. Both templates are met by their rarest
  words, repeats counted, in one order by frequency.
* Covered: a difference has a blank at most on its worded side and a wildcard on
  the other, and a wildcard covers two differences at most. So at most four words
  of the larger template lack a partner for each wildcard of the smaller; it is
  met by the rarest run of letters and digits in so many of its words, and one
  more, or by all its runs where it has no more words than that.

Merged templates keep a word, so in the last two cases some run is common to both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import align, text
from logloom.functions.shared import checkpoint, join_in_blocks

#: Templates with so many wildcards or more are met as one class.
CLASSES = 12
#: Templates of one key that meet in one group; larger groups are dealt out in blocks of it.
BLOCK = 1000


def _runs(words: Column) -> Column:
    return F.filter(F.regexp_extract_all(words, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: t.rlike("[a-zA-Z0-9]"))


def _described(templates: DataFrame, template_col: str) -> tuple[DataFrame, DataFrame]:
    """Templates numbered, with their sizes; and their runs (n, word, run) with the number of templates that hold each (df)."""
    t = templates.select(F.col(template_col).alias("template")).filter("template is not null").distinct().withColumn("n", F.monotonically_increasing_id())
    t = t.withColumn("form", text.collapse_wildcards(F.col("template"))).withColumn("wild", F.regexp_count("template", F.lit(r"<\*"))).withColumn("tokens", F.size(text.words(F.col("template"))))
    t = checkpoint(t)
    words = t.select("n", F.posexplode(F.split("template", " ", -1)).alias("word", "w"))
    runs = words.select("n", "word", F.explode(_runs(F.col("w"))).alias("run"))
    df = runs.groupBy("run").agg(F.countDistinct("n").alias("df"))
    return t, checkpoint(runs.join(df, "run"))


def rule_pairs(templates: DataFrame, template_col: str = "template") -> DataFrame:
    """(a, b), a < b: distinct pairs of different templates, among them all that `align.judge` merges.

    Null templates are left out, repeated ones count once; a template without a
    word meets those of its form only. Work grows with the templates that share
    one of their rarest words, of which there may be many where templates are
    short and full of wildcards: the rule itself merges those widely.
    """
    t, runs = _described(templates, template_col)
    sizes = t.select("n", "wild", "tokens")

    same = t.select("form", F.col("n").alias("l")).join(t.select("form", F.col("n").alias("r")), "form").filter("l < r").select("l", "r")

    # repeats of a run are told apart; a template's are in one array, sorted by how rare they are
    each = runs.groupBy("n", "run", "df").agg(F.count("*").alias("k")).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))))
    ranked = each.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("df", "run", "nth"))).alias("x")).select("n", F.posexplode("x").alias("rank", "x"))
    ranked = ranked.join(sizes, "n").filter(F.expr("rank * 10 <= tokens + (tokens * 11) div 9")).select("n", "tokens", F.col("x.run").alias("run"), F.col("x.nth").alias("nth"))
    few = join_in_blocks(ranked.withColumnRenamed("n", "l").withColumnRenamed("tokens", "lt"), ranked.withColumnRenamed("n", "r").withColumnRenamed("tokens", "rt"), ["run", "nth"], "r", BLOCK)
    few = few.filter("l < r and abs(lt - rt) * 10 <= lt + rt").select("l", "r")

    # of each word its rarest run, those in one array; a run that is not the rarest of its word helps small templates only
    best = runs.groupBy("n", "word").agg(F.min(F.struct("df", "run")).alias("x"))
    best = best.groupBy("n").agg(F.array_sort(F.collect_list("x")).alias("x"), F.count("*").alias("words")).select("n", "words", F.posexplode("x").alias("rank", "x"))
    count = best.select("n", "words").distinct()
    # the fewest wildcards of the other template with which a run of this one has to be met
    whole = F.expr("(words + 3) div 4")
    probes = best.select("n", "words", F.col("x.run").alias("run"), F.least(F.expr("(rank + 3) div 4"), whole).alias("from"))
    probes = probes.unionByName(runs.select("n", "run").join(count, "n").select("n", "words", "run", whole.alias("from")))
    probes = probes.groupBy("n", "words", "run").agg(F.min("from").alias("from"))
    probes = probes.withColumn("class", F.explode(F.sequence(F.least("from", F.lit(CLASSES)).cast("int"), F.lit(CLASSES))))
    held = runs.select("n", "run").distinct().join(count, "n").join(sizes, "n").select(F.col("n").alias("r"), F.col("words").alias("rw"), "run", "wild", F.least("wild", F.lit(CLASSES)).cast("int").alias("class"))
    covers = join_in_blocks(probes.withColumnRenamed("n", "l").withColumnRenamed("words", "lw"), held, ["run", "class"], "r", BLOCK)
    covers = covers.filter("l <> r and (lw > rw or lw = rw and l < r) and wild >= `from`").select("l", "r")

    pairs = same.unionByName(few).unionByName(covers).select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")).distinct()
    name = t.select("n", "template")
    named = pairs.join(name.select(F.col("n").alias("l"), F.col("template").alias("x")), "l").join(name.select(F.col("n").alias("r"), F.col("template").alias("y")), "r")
    return named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def contained_pairs(templates: DataFrame, template_col: str = "template") -> DataFrame:
    """(a, b), a < b: distinct pairs of different templates, among them all whose merge is one of the two.

    Such a merge keeps all runs of the one that it is, so those are in the other,
    its rarest too, unless both have one form. What is met by the rarest run and
    lacks another run goes before any alignment.
    """
    t, runs = _described(templates, template_col)
    own = runs.groupBy("n").agg(F.collect_set("run").alias("runs"), F.min(F.struct("df", "run")).getField("run").alias("rarest"))
    own = checkpoint(t.select("n", "template", "form").join(own, "n", "left"))
    small = own.filter("rarest is not null").select(F.col("n").alias("l"), F.col("template").alias("x"), F.col("runs").alias("lr"), F.col("rarest").alias("run"))
    large = own.select(F.col("n").alias("r"), F.col("template").alias("y"), F.col("runs").alias("rr"), F.explode("runs").alias("run"))
    met = join_in_blocks(small, large, ["run"], "r", BLOCK).filter((F.col("l") != F.col("r")) & (F.size(F.array_except("lr", "rr")) == 0)).select("x", "y")
    same = own.select("form", F.col("template").alias("x")).join(own.select("form", F.col("template").alias("y")), "form").filter("x < y").select("x", "y")
    return met.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def mergeable_pairs(templates: DataFrame, template_col: str = "template") -> DataFrame:
    """(a, b, merged): all pairs of templates that the rule merges, and to what."""
    got = rule_pairs(templates, template_col).withColumn("v", align.judged("a", "b"))
    return got.filter("v.mergeable").select("a", "b", "v.merged")
