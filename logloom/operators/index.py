"""Inverted index over templates: containment scores and the k best candidates."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions.shared import checkpoint
from logloom.functions.text import alpha_tokens

#: Different tokens of queries, counted for each query, that are sent to every task.
MAX_SENT = 200_000


def postings(templates: DataFrame, id_col: str = "tid", template_col: str = "template") -> DataFrame:
    """(token, tid, tf): how often each letters-only token stands in each template. Ids stand once.

    A template's tokens are sorted and counted in its row: ids, which may be long
    texts, are not shuffled for each token.
    """
    own = templates.select(F.col(id_col).alias("tid"), F.sort_array(alpha_tokens(F.col(template_col))).alias("own"))
    starts = F.filter(F.transform("own", lambda t, k: F.when((k == 0) | (F.get("own", k - 1) != t), k)), lambda k: k.isNotNull())
    own = own.withColumn("starts", starts)
    runs = F.transform("starts", lambda at, k: F.struct(F.get("own", at).alias("token"), (F.coalesce(F.get("starts", k + 1), F.size("own")) - at).cast("long").alias("tf")))
    return own.select("tid", F.inline(runs)).select("token", "tid", "tf")


def lengths(templates: DataFrame, id_col: str = "tid", template_col: str = "template") -> DataFrame:
    """(tid, n_tokens): letters-only tokens of each template; 0 for none."""
    return templates.groupBy(F.col(id_col).alias("tid")).agg(F.sum(F.size(alpha_tokens(F.col(template_col)))).cast("long").alias("n_tokens"))


def index_rows(posting: DataFrame) -> DataFrame:
    """(tid, n_tokens, terms): each template's tokens with how often they stand in it, the rarest of the index first."""
    df = posting.groupBy("token").agg(F.count("*").alias("df"))
    terms = F.array_sort(F.collect_list(F.struct("df", "token", "tf")))
    return posting.join(df, "token").groupBy("tid").agg(F.sum("tf").alias("n_tokens"), terms.alias("terms"))


def rare_tokens(least: float) -> Column:
    """Of index_rows: just so many of the rarest tokens that a query without any of
    them cannot contain `least` of the template."""
    most = F.col("n_tokens") - F.ceil(F.lit(least) * F.col("n_tokens"))
    start = F.struct(F.lit(0).cast("long").alias("before"), F.array().cast("array<string>").alias("got"))
    walked = F.aggregate("terms", start, lambda s, e: F.struct((s.before + e.tf).alias("before"), F.when(s.before <= most, F.array_append(s.got, e.token)).otherwise(s.got).alias("got")))
    return walked.got


class IndexStore:
    """An inverted index that grows by versions below `path`.

    A version holds the postings of the templates that came or changed, and its
    heads: a row for each of their ids, and for ids that were removed. The newest
    version of an id counts. `compact` writes all that counts as a base; later
    reads take it as it is but for ids that changed since, so a change costs its
    own postings and not the index. A version that is written again replaces itself.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, version: int, changes: DataFrame, id_col: str = "tid", template_col: str = "template") -> None:
        """Index templates under their ids, in place of what those stood for; a null template removes its id. Ids are not null and stand once."""
        src = checkpoint(changes.select(F.col(id_col).cast("string").alias("tid"), F.col(template_col).alias("template")))
        heads = src.select("tid", F.col("template").isNotNull().alias("live"), F.lit(version).alias("version"))
        heads.write.mode("overwrite").parquet(f"{self.path}/heads/v={version}")
        postings(src.filter("template is not null")).withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{self.path}/postings/v={version}")

    def _versions(self, kind: str) -> list[int]:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        done = [n for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{n}/_SUCCESS"))]
        return sorted(int(n[2:]) for n in done)

    def _read(self, kind: str, versions: list[int], schema: str) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}/v={v}" for v in versions])

    def postings(self, version: int | None = None) -> DataFrame:
        """(token, tid, tf) after a version, the last by default."""
        upto = [v for v in self._versions("heads") if version is None or v <= version]
        base = max((v for v in self._versions("base") if version is None or v <= version), default=None)
        since = [v for v in upto if base is None or v > base]
        heads = self._read("heads", since, "tid string, live boolean, version int")
        newest = heads.groupBy("tid").agg(F.max_by("live", "version").alias("live"), F.max("version").alias("version"))
        fresh = self._read("postings", since, "token string, tid string, tf long, version int")
        fresh = fresh.join(newest.filter("live").drop("live"), ["tid", "version"]).select("token", "tid", "tf")
        if base is None:
            return fresh
        kept = self._read("base", [base], "token string, tid string, tf long").join(newest, "tid", "left_anti")
        return kept.unionByName(fresh)

    def compact(self) -> None:
        """Write what counts after the last version as a base."""
        upto = self._versions("heads")
        if upto and upto[-1] not in self._versions("base"):
            self.postings().write.mode("overwrite").parquet(f"{self.path}/base/v={upto[-1]}")


def _overlaps(have: DataFrame, templates: DataFrame, least: float) -> DataFrame:
    """(qid, tid, score) for queries few enough to be sent to every task: their tokens are looked up for each template, in one pass without a shuffle."""
    rows = [(r["token"], r["qid"], r["qtf"]) for r in have.collect()]  # MAX_SENT bounds it
    place = {t: k for k, t in enumerate(sorted({t for t, _, _ in rows}))}
    names = sorted({q for _, q, _ in rows})
    number = {q: k for k, q in enumerate(names)}
    token, query, qtf = np.array(sorted((place[t], number[q], n) for t, q, n in rows), dtype=np.int64).reshape(-1, 3).T
    shared = have.sparkSession.sparkContext.broadcast((place, np.searchsorted(token, np.arange(len(place) + 1)), query, qtf, len(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, start, query, qtf, n = shared.value
        for b in batches:
            found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for r, tokens in enumerate(b.column(1).to_pylist()):
                count = Counter(tokens)
                known = [(place[t], c) for t, c in count.items() if t in place]
                if sum(c for _, c in known) < least * len(tokens) or not known:
                    continue
                at, tf = np.array(known, dtype=np.int64).T
                size = start[at + 1] - start[at]
                rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[at], size)
                score = np.bincount(query[rows], weights=np.minimum(qtf[rows], np.repeat(tf, size)), minlength=n) / len(tokens)
                hit = np.flatnonzero((score >= least) & (score > 0))
                found.append((np.full(len(hit), r), hit, score[hit]))
            row, hit, score = (np.concatenate(c) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(hit.astype(np.int32)), pa.array(score)], names=["tid", "q", "score"])

    kinds, src = dict(have.dtypes), templates.select("tid", alpha_tokens(F.col("template")).alias("tokens"))
    got = src.mapInArrow(run, f"tid {dict(src.dtypes)['tid']}, q int, score double")
    named = have.sparkSession.createDataFrame(list(enumerate(names)), f"q int, qid {kinds['qid']}")
    return got.join(F.broadcast(named), "q").select("qid", "tid", "score")


def _met_by_rare_tokens(have: DataFrame, templates: DataFrame, least: float) -> DataFrame:
    """(qid, tid, score) for any number of queries: a template is met by its rarest tokens only, so common words bring no pairs together."""
    # ids may be long texts: rows are numbered, and get their ids back at the end
    numbered = checkpoint(templates.select(F.col("tid").alias("id"), "template", F.monotonically_increasing_id().alias("n")))
    rows = checkpoint(index_rows(postings(numbered, "n", "template")))  # the index: built once, read for each step
    rare = rows.select("tid", F.explode(rare_tokens(least)).alias("token"))
    met = have.select("qid", "token").join(rare, "token").select("qid", "tid").distinct()
    asked = have.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("token", "qtf"))).alias("asked"))
    common = F.aggregate("terms", F.lit(0).cast("long"), lambda s, e: s + F.least(e.tf, F.coalesce(F.col("asked")[e.token], F.lit(0))))
    scored = met.join(rows, "tid").join(asked, "qid").select("qid", "tid", (common / F.col("n_tokens")).alias("score")).filter(F.col("score") >= least)
    return scored.join(numbered.select(F.col("n").alias("tid"), "id"), "tid").select("qid", F.col("id").alias("tid"), "score")


def candidates(queries: DataFrame, templates: DataFrame, k: int = 3, least: float = 0.5, qid: str = "qid", query_col: str = "template", id_col: str = "tid", template_col: str = "template", most_sent: int = MAX_SENT) -> DataFrame:
    """(qid, tid, score, rank): the k templates that the query's tokens contain best.

    score is the overlap, counting repeats, over the template's tokens; ties
    rank by tid. Candidates below `least` are left out. Queries with `most_sent`
    different tokens in all, or fewer, go to every task; for more, queries and
    templates are joined by the templates' rarest tokens. Queries and templates
    without a letters-only token, and queries without an id, meet none.
    """
    have = queries.filter(F.col(qid).isNotNull()).select(F.col(qid).alias("qid"), F.explode(alpha_tokens(F.col(query_col))).alias("token")).groupBy("qid", "token").agg(F.count("*").alias("qtf"))
    have = checkpoint(have)
    templates = templates.select(F.col(id_col).alias("tid"), F.col(template_col).alias("template")).filter("template is not null")
    scored = (_overlaps if have.count() <= most_sent else _met_by_rare_tokens)(have, templates, least)
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "tid")))
    return best.filter(F.col("rank") <= k).select("qid", "tid", "score", F.col("rank").cast("long").alias("rank"))
