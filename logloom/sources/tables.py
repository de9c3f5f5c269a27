"""CSV tables of templates, structured logs and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRUTH = T.StructType([T.StructField("EventId", T.StringType()), T.StructField("EventTemplate", T.StringType())])
MINED = T.StructType([T.StructField("EventId", T.IntegerType()), T.StructField("EventTemplate", T.StringType()), T.StructField("Occurrences", T.LongType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, empty_is_null: bool = False) -> DataFrame:
    """Doubled quotes inside quotes; every text is literal, so `null` and `NA` stay words.

    An empty text is one unless empty_is_null, as in labels with gaps.
    """
    df = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("nullValue", "\x00").option("emptyValue", "").csv(path)
    return df if empty_is_null else df.na.fill("")


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """The same dialect; single_file is for small results only."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_structured(df: DataFrame, path: str, single_file: bool = False) -> None:
    write_csv(df, path, single_file)


def write_templates(catalog: DataFrame, path: str, single_file: bool = True) -> None:
    write_csv(catalog.select("EventId", "EventTemplate", "Occurrences").orderBy("EventId"), path, single_file)


def transpose_scores(scores: DataFrame, datasets: list[str]) -> DataFrame:
    """(Dataset, GA, PA) rows -> a row for each metric, a column for each data set."""
    long = scores.select("Dataset", F.explode(F.array(F.struct(F.lit("GA").alias("metric"), F.col("GA").alias("v")), F.struct(F.lit("PA").alias("metric"), F.col("PA").alias("v")))).alias("x")).select("Dataset", "x.*")
    return long.groupBy("metric").pivot("Dataset", datasets).agg(F.first("v"))


def write_scores(scores: DataFrame, datasets: list[str], path: str) -> None:
    write_csv(transpose_scores(scores, datasets), path, single_file=True)
