"""The op<N>_ queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import decontam, html_text, interpolation, language, lexical, licenses, packing, quality, simhash, toxicity, upsert, vectors, warc
from logloom.llm.common import crc_mod, shared_folder, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(packing.pieces(table(spark, sf_dir, "documents")))
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    out = warc.read(spark, path, with_payload=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), columns=["page_id", "url"])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded ratings: 0 junk, 1 well-formed but toxic, 2 well-formed and clean."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(crc_mod("doc_id", 5) != 0), rating=F.col("quality") * (F.lit(2) - F.col("toxic")))
    out = quality.grade(docs, model, least=1, columns=["doc_id"])
    return out.withColumn("held_out", crc_mod("doc_id", 5) == 0)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(crc_mod("doc_id", 5) != 0))
    out = toxicity.score(docs, model, score_col="score", columns=["doc_id"])
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(crc_mod("doc_id", 4) != 2))
    out = language.identify(docs, model, score_col="score", columns=["doc_id"])
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.flag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), columns=["doc_id"])


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients, changes = table(spark, sf_dir, "clients"), table(spark, sf_dir, "client_changes")
    rows = 1 + clients.count() // 1000
    path = shared_folder(spark, "clients")
    upsert.create(clients.filter(crc_mod("client_id", 7) > 3), path, "client_id", rows)
    h = crc_mod("__first", 16)
    deletes = F.coalesce(F.col("op") == "D", F.lit(False)) | (crc_mod("change_id", 8) < h)
    _, kept = upsert.upsert(spark, path, changes, "client_id", ["seq", "change_id"], ["source", "segment", "city", "balance"], rows, deletes=deletes, ignores=h > 7)
    said = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("source", "segment", "city")])
    cents = F.coalesce(F.floor(100 * F.col("balance") + 0.5), F.lit(0)).cast("long")
    out = upsert.digests(spark, path, "client_id", [F.sum(cents).alias("cents"), F.sum(F.crc32(said.cast("binary"))).alias("rows_crc")])
    old = F.broadcast(spark.createDataFrame([(p, False) for p in kept], "path string, rewritten boolean"))  # a row for each file
    return out.join(old, "path", "left").withColumn("rewritten", F.coalesce("rewritten", F.lit(True))).select("first_id", "n_rows", "cents", "rows_crc", "ids_sha256", "columns", "path", "rewritten")


def op13_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = crc_mod("doc_id", 7)
    out, _ = interpolation.score(table(spark, sf_dir, "documents"), part != 2, part == 5)
    return out.select(F.col("id").alias("doc_id"), (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op1_simhash": op1_simhash, "op2_packing": op2_packing, "op3_warc": op3_warc, "op4_html": op4_html, "op5_quality": op5_quality, "op6_licenses": op6_licenses, "op7_embeddings": op7_embeddings, "op8_toxicity": op8_toxicity, "op9_language": op9_language, "op10_decontamination": op10_decontamination, "op11_lexical": op11_lexical, "op12_upsert": op12_upsert, "op13_interpolation": op13_interpolation}

ORACLE_SQL: dict[str, str] = {"op6_licenses": licenses.oracle_sql(), "op11_lexical": lexical.oracle_sql()}
