"""Corpus pipeline: five filtering and packing stages over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents and only take rows away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import decontam, language, packing, simhash, toxicity
from logloom.llm.common import checkpoint, table

#: A document whose language is less sure than this is rejected, as is one without a letter.
LEAST_SURE = 0.5
#: A document at least this likely to be toxic is rejected.
TOXIC_AT = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs)
    out = language.identify(docs, model, pred_col="__lang", score_col="__sure")
    return out.filter((F.col("__lang") != language.UNDETERMINED) & (F.col("__sure") >= LEAST_SURE)).select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, score_col="__toxic").filter(F.col("__toxic") < TOXIC_AT).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Rows that repeat an id stay or go together; rows without an id stay.
    """
    gone = simhash.near_copies(docs).filter("id != component_id").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.flag(docs, table(spark, sf_dir, "benchmark")).filter(~F.col("contaminated")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = packing.pack(packing.pieces(docs))
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each but the last keeps is materialised, as models and links are made from it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
