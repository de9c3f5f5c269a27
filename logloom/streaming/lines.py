"""Header fields and dense line numbers over a stream of log files.

A batch's lines are numbered by their splits, as `logs.read_log` does, after the
lines that earlier batches left of the same source. What is carried on is a count
for each source, written as a version with every batch; a batch that runs again
reads the version before it and writes the same numbers again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.sources.formats import LineFormat, compile_format
from logloom.sources.logs import number_splits, parse_lines

COUNTS = "source string, lines long"


class LineStream:
    """foreachBatch state: numbered lines, and how many each source has, below `path`."""

    def __init__(self, spark: SparkSession, path: str, fmt: LineFormat | str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.format = compile_format(fmt) if isinstance(fmt, str) else fmt

    def counts(self, before: int) -> DataFrame:
        """(source, lines) left by the batches before one."""
        if before == 0:
            return self.spark.createDataFrame([], COUNTS)
        return self.spark.read.schema(COUNTS).parquet(f"{self.path}/counts/v={before - 1}")

    def lines(self) -> DataFrame:
        fields = ", ".join(f"`{f}` string" for f in self.format.fields)
        return self.spark.read.schema(f"source string, LineId long, {fields}").parquet(f"{self.path}/lines/v=*")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        old = self.counts(batch_id)
        numbered = number_splits(parse_lines(batch, self.format), ["__file", "__at"], ["source"], "__n")
        placed = numbered.join(old, "source", "left").withColumn("LineId", F.col("__n") + F.coalesce("lines", F.lit(0)))
        placed.select("source", "LineId", *[F.col(f"`{f}`") for f in self.format.fields]).write.mode("overwrite").parquet(f"{self.path}/lines/v={batch_id}")
        done = self.spark.read.parquet(f"{self.path}/lines/v={batch_id}").groupBy("source").agg(F.count("*").alias("n"))
        total = old.join(done, "source", "full").select("source", (F.coalesce("lines", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("lines"))
        total.write.mode("overwrite").parquet(f"{self.path}/counts/v={batch_id}")


def number_stream(files: DataFrame, path: str, checkpoint: str, fmt: LineFormat | str, **trigger) -> tuple[StreamingQuery, LineStream]:
    """Start numbering a streaming table of text files with columns `value` and `source`, which is not null.

    LineId counts the matching lines of a source, from 1: batch after batch, in a
    batch by path, and by position in a file. Lines that do not match the format
    are left out and not counted.
    """
    state = LineStream(files.sparkSession, path, fmt)
    src = files.select("value", F.col("source").cast("string").alias("source"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at"))
    return src.writeStream.foreachBatch(state).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(), state
