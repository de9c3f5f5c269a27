"""Structured output: ids and templates back on the lines, and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def occurrences(structured: DataFrame) -> DataFrame:
    """(EventId, EventTemplate, Occurrences)."""
    return structured.groupBy("EventId", "EventTemplate").agg(F.count("*").alias("Occurrences"))


def attach(lines: DataFrame, ids: DataFrame, catalog: DataFrame, on: str = "content") -> DataFrame:
    """lines with EventId and EventTemplate; -1 and an empty text where there is none."""
    named = ids.join(catalog.select("EventId", "EventTemplate"), "EventId", "left")
    out = lines.join(named, on, "left")
    return out.withColumn("EventId", F.coalesce("EventId", F.lit(-1))).withColumn("EventTemplate", F.coalesce("EventTemplate", F.lit("")))
