"""Scores of a grouping against labelled data, all from one contingency table.

The rows are counted once, into a table of a row for each pair of parsed and
true id, which is materialised; every score is taken from that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.normalise import comparable
from logloom.functions.shared import checkpoint
from logloom.functions.text import pair_count


def aligned(truth: DataFrame, parsed: DataFrame, on: str = "LineId", size: int = 0) -> DataFrame:
    """(on, g, p): rows with a truth id, and the parsed id of the same position; size > 0 keeps the first positions only."""
    t = truth.filter(F.col("EventId").isNotNull())
    if size:
        t = t.filter(F.col(on) <= size)
    return t.select(on, F.col("EventId").alias("g")).join(parsed.select(on, F.col("EventId").alias("p")), on)


def contingency(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, p, g, n) with n_p and n_g, the sizes of the parsed and the true group.

    Rows are counted once and the counts materialised; the group sizes are sums
    over that small table.
    """
    by = by or []
    c = checkpoint(pairs.groupBy(*by, "p", "g").agg(F.count("*").alias("n")))
    one, other = Window.partitionBy(*by, "p"), Window.partitionBy(*by, "g")
    return c.withColumns({"n_p": F.sum("n").over(one), "k": F.count("*").over(one)}).withColumn("n_g", F.sum("n").over(other)).filter("p is not null and g is not null")


def correct_groups(table: DataFrame) -> DataFrame:
    """Parsed groups that are one true group, all of it. A parsed id of null is no group."""
    return table.filter((F.col("k") == 1) & (F.col("n_p") == F.col("n_g")) & F.col("p").isNotNull())


def _side_by_side(parts: list[DataFrame], by: list[str], columns: list[str]) -> DataFrame:
    """One row for each group with the columns of all parts, which have a row for a group at most."""
    rows = None
    for part in parts:
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return rows.groupBy(*by).agg(*[F.max(c).alias(c) for c in columns])


def scores(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pairwise precision, recall and F1, and grouping accuracy (GA).

    Null where a score has no pairs to be taken over.
    """
    return scores_of(contingency(pairs, by), by)


def scores_of(t: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The scores of a contingency table."""
    by = by or []
    known = F.col("p").isNotNull()
    right = F.when((F.col("k") == 1) & (F.col("n_p") == F.col("n_g")) & known, F.col("n"))
    # group sizes stand in every row of their group: the first row of each stands for it
    first_p = F.row_number().over(Window.partitionBy(*by, "p").orderBy("g")) == 1
    first_g = F.row_number().over(Window.partitionBy(*by, "g").orderBy("p")) == 1
    t = t.withColumn("__parsed", F.when(first_p & known, pair_count(F.col("n_p")))).withColumn("__real", F.when(first_g, pair_count(F.col("n_g"))))
    one = t.groupBy(*by).agg(F.sum(F.when(known, pair_count(F.col("n")))).alias("accurate"), F.coalesce(F.sum(right), F.lit(0)).alias("correct"), F.sum("n").alias("rows"), F.sum("__parsed").alias("parsed"), F.sum("__real").alias("real"))
    p, r = F.try_divide("accurate", "parsed"), F.try_divide("accurate", "real")
    return one.select(*by, "accurate", "parsed", "real", "correct", "rows", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"), F.try_divide("correct", "rows").alias("ga"))


def parsing_accuracy(pairs: DataFrame, truth_templates: DataFrame, parsed_templates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of rows in correct groups whose template equals the true one after the lenient rewrites.

    The rewrites run on one template pair for each correct group.
    """
    return parsing_accuracy_of(contingency(pairs, by), truth_templates, parsed_templates, by)


def parsing_accuracy_of(t: DataFrame, truth_templates: DataFrame, parsed_templates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The parsing accuracy of a contingency table."""
    by = by or []
    rows = t.groupBy(*by).agg(F.sum("n").alias("rows"))
    right = correct_groups(t)
    named = right.join(truth_templates.select(*by, F.col("EventId").alias("g"), F.col("EventTemplate").alias("gt")), [*by, "g"]).join(parsed_templates.select(*by, F.col("EventId").alias("p"), F.col("EventTemplate").alias("pt")), [*by, "p"])
    same = named.filter(comparable(F.col("gt")) == comparable(F.col("pt"))).groupBy(*by).agg(F.sum("n").alias("same"))
    one = _side_by_side([rows, same], by, ["rows", "same"])
    return one.select(*by, F.coalesce("same", F.lit(0)).alias("same"), "rows", F.try_divide(F.coalesce("same", F.lit(0)), "rows").alias("pa"))


def evaluate(truth: DataFrame, parsed: DataFrame, truth_templates: DataFrame, parsed_templates: DataFrame, size: int = 0) -> DataFrame:
    """One row: precision, recall, f1, ga, pa."""
    pairs = aligned(truth, parsed, size=size)
    t = contingency(pairs)
    s = scores_of(t)
    p = parsing_accuracy_of(t, truth_templates, parsed_templates)
    return _side_by_side([s.select("precision", "recall", "f1", "ga"), p.select("pa")], [], ["precision", "recall", "f1", "ga", "pa"])
