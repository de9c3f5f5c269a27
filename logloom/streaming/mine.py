"""Template matching and mining on a stream of lines.

Every micro-batch is matched against the newest catalog version; what it misses
is mined, as masks that a rule merges, and makes the next version. Versions are
numbered by the batch, so a batch that runs again writes the same version again.
A version holds the templates of its batch's lines with their counts, the catalog
is the sum of the versions: what is written for a batch does not grow with those before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.functions import text
from logloom.functions.shared import checkpoint
from logloom.operators.match import match_join
from logloom.operators.mine import merged_masks

CATALOG = "template string, first_batch long, lines long"


class StreamMiner:
    """foreachBatch state: catalog versions below `path`, one folder for each batch.

    merge: whether a batch's new masks are merged by rule, as in mine_scalable;
    for free text, whose lines share words but no statements, they are better left.
    """

    def __init__(self, spark: SparkSession, path: str, merge: bool = True) -> None:
        self.spark, self.path, self.merge = spark, path.rstrip("/"), merge

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        done = [n for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[2:]) for n in done)

    def _read(self, versions: list[int]) -> DataFrame:
        return self.spark.read.schema(CATALOG).parquet(*[f"{self.path}/v={v}" for v in versions])

    def catalog(self, before: int | None = None) -> DataFrame:
        """The newest version, or the newest before a batch."""
        known = [v for v in self._versions() if before is None or v < before]
        if not known:
            return self.spark.createDataFrame([], CATALOG)
        if len(known) == 1:
            return self._read(known)  # a version has each template once
        return self._read(known).groupBy("template").agg(F.min("first_batch").alias("first_batch"), F.sum("lines").alias("lines"))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        content = batch.select(text.content(F.col("value")).alias("content")).filter("content != ''")
        mask = text.mask(F.col("content"))
        known = [v for v in self._versions() if v < batch_id]
        if known:
            counts = checkpoint(content.groupBy("content").agg(F.count("*").alias("n")))  # bounded by the trigger
            hit = match_join(counts, self._read(known))
            named = counts.join(hit, "content", "left").withColumn("missed", F.col("template").isNull()).withColumn("template", F.coalesce("template", mask))
        else:  # there is nothing to meet: masks are counted in one shuffle, whatever the batch's size
            named = content.groupBy(mask.alias("template")).agg(F.count("*").alias("n")).withColumn("missed", F.lit(True))
        if self.merge:
            named = checkpoint(named)
            groups = merged_masks(named.filter("missed").select("template").distinct())
            named = named.join(groups, "template", "left").withColumn("template", F.when(F.col("missed"), F.col("merged")).otherwise(F.col("template")))
        seen = named.groupBy("template").agg(F.lit(batch_id).cast("long").alias("first_batch"), F.sum("n").alias("lines"))
        seen.write.mode("overwrite").parquet(f"{self.path}/v={batch_id}")


def mine_stream(lines: DataFrame, path: str, checkpoint: str, merge: bool = True, **trigger) -> tuple[StreamingQuery, StreamMiner]:
    """Start mining a streaming table with a `value` column; give the query and its state."""
    miner = StreamMiner(lines.sparkSession, path, merge)
    return lines.writeStream.foreachBatch(miner).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(), miner
