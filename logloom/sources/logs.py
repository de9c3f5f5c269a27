"""Raw log text to tables of header fields with dense line numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions.shared import checkpoint
from logloom.sources.formats import LineFormat, compile_format


def parse_lines(lines: DataFrame, fmt: LineFormat | str, value: str = "value") -> DataFrame:
    """lines with the format's fields; lines that do not match are left out.

    Fields are strings; one in an optional group is null where it is absent.
    A field named like a column of lines replaces it.
    """
    fmt = compile_format(fmt) if isinstance(fmt, str) else fmt
    text = F.regexp_replace(F.col(value), r"^\s+|\s+$", "")
    made = {}
    for name, group, optional in zip(fmt.fields, fmt.groups, fmt.optional, strict=True):
        got = F.regexp_extract(text, fmt.pattern, group)
        made[name] = F.nullif(got, F.lit("")) if optional else got
    return lines.filter(text.rlike(fmt.pattern)).withColumns(made)


def number_lines(df: DataFrame, *order: str | Column, name: str = "LineId") -> DataFrame:
    """Dense numbers from 1 along the order, without gathering the rows in one task.

    Rows are range-partitioned and sorted; a count for each partition gives the
    offsets. Ties in the order are numbered in either order.
    """
    made = df.repartitionByRange(*order).sortWithinPartitions(*order)
    made = checkpoint(made.withColumn("__p", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id()))
    size = made.groupBy("__p").agg(F.count("*").alias("n"), F.min("__k").alias("__first"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    size = size.withColumn("__offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = made.join(F.broadcast(size), "__p")
    return numbered.withColumn(name, F.col("__offset") + F.col("__k") - F.col("__first") + 1).drop("__p", "__k", "__first", "__offset")


def read_log(spark: SparkSession, path: str, fmt: LineFormat | str) -> DataFrame:
    """LineId and the header fields of the matching lines, in file order.

    LineId counts matching lines only, from 1. Files follow each other by path;
    within a file the splits do by position.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at"))
    fields = compile_format(fmt).fields if isinstance(fmt, str) else fmt.fields
    numbered = number_splits(parse_lines(raw, fmt), ["__file", "__at"], [])
    return numbered.select("LineId", *[F.col(f"`{f}`") for f in fields])


def number_splits(rows: DataFrame, split: list[str], by: list[str], name: str = "LineId") -> DataFrame:
    """Dense numbers from 1, for each value of `by`, of rows as they come from file splits, which follow each other by their columns.

    A split is a group of bounded size: rows are ranked inside it, and splits are
    counted. Rows keep the order that their scan gives them.
    """
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    block = [*by, *split]
    ranked = rows.withColumn("__k", F.row_number().over(Window.partitionBy(*block).orderBy("__row")))
    before = Window.partitionBy(*by).orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    size = rows.groupBy(*block).agg(F.count("*").alias("n")).withColumn("__offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return ranked.join(size, block).withColumn(name, F.col("__offset") + F.col("__k")).drop("__offset", "__k", "__row")


def document_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, line): free text as log lines; a null text has none."""
    return docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))
