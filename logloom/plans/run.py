"""Whole runs: parse one log, or score all data sets in one job.

    python -m logloom.plans.run parse HDFS logs/HDFS_2k.log out/
    python -m logloom.plans.run score truth/ mined/ out/ [dataset ...]
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from logloom.functions import text
from logloom.functions.shared import checkpoint
from logloom.operators import evaluate, mine, output
from logloom.operators.oracle import Oracle
from logloom.sources import formats, logs, tables


def parse(spark: SparkSession, dataset: str, path: str, out: str | None = None, oracle: Oracle | None = None, scalable: bool = False) -> tuple[DataFrame, DataFrame]:
    """(structured, catalog) of a log in a known format; written below `out` if given."""
    lines = checkpoint(logs.read_log(spark, path, formats.FORMATS[dataset]).withColumn("__content", text.content(F.col("Content"))))
    mined = mine.mine_scalable(lines, "__content") if scalable else mine.mine_exact(lines, "__content", oracle=oracle)
    structured, catalog = mined[0].drop("__content"), mined[1]
    if out:
        tables.write_structured(structured, f"{out}/{dataset}_structured.csv")
        tables.write_templates(catalog, f"{out}/{dataset}_templates.csv")
    return structured, catalog


_IDS = T.StructType([T.StructField("LineId", T.LongType()), T.StructField("EventId", T.StringType())])
_TEMPLATES = tables.TRUTH


def score(spark: SparkSession, truth_dir: str, mined_dir: str, datasets: list[str]) -> DataFrame:
    """(Dataset, precision, recall, f1, GA, PA) of all data sets, in one job.

    Each folder holds <dataset>_ids.csv (LineId, EventId) and
    <dataset>_templates.csv (EventId, EventTemplate); a truth without an id is
    left out, as is its line on the other side.
    """

    def table(folder: str, kind: str, schema: T.StructType, gaps: bool = False) -> DataFrame:
        rows = None
        for d in datasets:
            one = tables.read_csv(spark, f"{folder}/{d}_{kind}.csv", schema, empty_is_null=gaps).withColumn("Dataset", F.lit(d))
            rows = one if rows is None else rows.unionByName(one)
        return rows

    truth, parsed = table(truth_dir, "ids", _IDS, True), table(mined_dir, "ids", _IDS, True)
    known = truth.filter("EventId is not null").withColumnRenamed("EventId", "g")
    pairs = checkpoint(known.join(parsed.withColumnRenamed("EventId", "p"), ["Dataset", "LineId"]).select("Dataset", "g", "p"))
    s = evaluate.scores(pairs, ["Dataset"]).select("Dataset", "precision", "recall", "f1", F.col("ga").alias("GA"))
    pa = evaluate.parsing_accuracy(pairs, table(truth_dir, "templates", _TEMPLATES), table(mined_dir, "templates", _TEMPLATES), ["Dataset"])
    return s.join(pa.select("Dataset", F.col("pa").alias("PA")), "Dataset", "left")


class Progress(StreamingQueryListener):
    """Prints the rows of each micro-batch: spark.streams.addListener(Progress())."""

    def onQueryStarted(self, event) -> None:  # noqa: N802
        print(f"stream {event.id} started")

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        print(f"batch {p.batchId}: {p.numInputRows} rows, {p.processedRowsPerSecond:.0f} a second")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        print(f"stream {event.id} ended")


def main(args: list[str]) -> None:
    spark = SparkSession.builder.appName("logloom").getOrCreate()
    if args[:1] == ["parse"] and len(args) == 4:
        structured, catalog = parse(spark, *args[1:])
        output.occurrences(structured).orderBy(F.desc("Occurrences")).show(50, False)
    elif args[:1] == ["score"] and len(args) >= 4:
        datasets = args[4:] or list(formats.FORMATS)
        result = score(spark, args[1], args[2], datasets)
        result.orderBy("Dataset").show(len(datasets), False)
        tables.write_scores(result, datasets, f"{args[3]}/scores.csv")
    else:
        sys.exit(__doc__)


if __name__ == "__main__":
    main(sys.argv[1:])
