"""Checkpoints through the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which Spark takes itself. Where none is set, a temporary
    folder in local mode; an error on a cluster, whose machines do not share one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="logloom-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; never through executors' own disks."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4()}"


#: A table up to this size (bytes, by Spark's estimate) in fewer files than there are cores is dealt out before work.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """A small table in a file or two has one scan task with rows; give every core some.

    Larger tables, and those with a file for each core, are left as they are:
    their scans are parallel and need no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= SPREAD_BYTES and len(df.inputFiles()) < cores else df


#: Rows of one key that meet in one group of `join_in_blocks`, in expectation.
BLOCK_ROWS = 10_000


def join_in_blocks(few: DataFrame, many: DataFrame, keys: list[str], by: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """An inner join by equal keys, for keys that a large part of one side has.

    `many` rows of a key are dealt by the hash of a column to blocks of so many
    rows; the key's rows of `few` go to every block. No task gets a whole
    frequent key, and a rare one stays one block.
    """
    size = many.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(rows)).cast("int").alias("__blocks"))
    spread = few.join(size, keys).withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))).drop("__blocks")
    dealt = many.join(size, keys).withColumn("__block", F.pmod(F.xxhash64(by), F.col("__blocks")).cast("int")).drop("__blocks")
    return spread.join(dealt, [*keys, "__block"]).drop("__block")
