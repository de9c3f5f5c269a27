"""Ranked lexical search: three-phase uniform thresholding (TPUT) over term-partitioned postings.

A query's score of a document is a sum over its terms, each of which has a list
of postings with their impact. Phase one fetches the head of every list; the
documents found there give each query a score that its k-th best reaches at
least. A document that reaches it too has one term at least with its share, the
bound over the number of lists; phase two fetches from every list what is not
below that, which leaves as candidates the documents whose fetched part, with
all that their other terms could add, reaches the bound. Phase three looks up
the candidates' whole scores.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import map_arrow, written

#: Terms, counted for each query, that are answered in one pass over the documents; more take more passes.
TERMS_A_PASS = 200_000
#: Part of an even share of its bound from which a query fetches entries.
SHARE = 0.6
#: Postings of a term that one piece of its list holds, in expectation.
PIECE_ROWS = 1_000_000
#: ASCII letters in lower case and digits stay, other ASCII becomes a blank; bytes of longer characters stay.
_SPLIT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(128)).lower() + bytes(range(128, 256))


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, in lower case, ASCII digits and all other characters beyond ASCII."""
    return text.translate(_SPLIT).split() if text else []


def wanted_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, term): the different terms of each row of items, which is numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sorted(set(terms(t))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.binary()))], names=["item_id", "terms"])

    src = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    listed = map_arrow(src, run, "item_id long, terms array<binary>").withColumn("item", F.monotonically_increasing_id())
    return written(listed.select("item", "item_id", F.explode("terms").alias("term")))


def forward_rows(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, doc_id, n, found): for each row its number, how many terms it has, and the
    place in the vocabulary and frequency of those of its terms that stand there."""
    shared = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            n, found = [], []
            for text in b.column(1).to_pylist():
                got = terms(text)
                n.append(len(got))
                count = Counter(got)
                found.append(sorted((known[t], count[t]) for t in count.keys() & known.keys()))
            flat = [x for row in found for x in row]
            pairs = pa.StructArray.from_arrays([pa.array([t for t, _ in flat], pa.int32()), pa.array([c for _, c in flat], pa.int64())], names=["term", "tf"])
            at = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found], dtype=np.int32)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pairs)], names=["doc_id", "n", "found"])

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    got = map_arrow(src, run, "doc_id long, n long, found array<struct<term: int, tf: long>>")
    return written(got.withColumn("doc", F.monotonically_increasing_id()))


def impact(tf: Column, n: Column, docs: int, all_terms: int) -> Column:
    """What a term of weight one adds to a document's score, in millionths."""
    long = lambda c: c.cast("long")
    div = lambda a, b: F.call_function("div", a, b)
    m = F.lit(10).cast("long") + div(F.lit(90).cast("long") * n * F.lit(docs).cast("long"), F.lit(all_terms).cast("long"))
    return div(F.lit(1_000_000_000).cast("long") * long(tf), F.lit(1000).cast("long") * long(tf) + F.lit(8).cast("long") * m)


@dataclass
class Asked:
    """The queries of a pass by term: for the term at place t the rows start[t]..start[t + 1]-1 of the others."""

    start: np.ndarray
    item: np.ndarray  # numbers of queries from 0
    weight: np.ndarray
    least: np.ndarray  # impact from which an entry is fetched
    cap: np.ndarray  # what an entry that is not fetched adds at most
    bound: np.ndarray  # of each query: what its k-th best document scores at least
    rest: np.ndarray  # of each query: all its caps

    def rows(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of some terms, and for each the place of its term among them."""
        size = self.start[term + 1] - self.start[term]
        of = np.repeat(np.arange(len(term)), size)
        return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[term], size), of

    def sums(self, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Summed for each query; below 2**53, so doubles hold them exactly."""
        return np.bincount(self.item[rows], weights=values, minlength=len(self.bound)).astype(np.int64)


def _top(cols: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of columns item, score, known id, id, doc the k best rows of each item."""
    item, score, known, doc_id, doc = cols
    order = np.lexsort((doc, doc_id, known, -score, item))
    item = item[order]
    first = np.searchsorted(item, item)
    return [c[order[np.arange(len(order)) - first < k]] for c in cols]


def _score(rows: DataFrame, asked: Broadcast, k: int, docs: int, all_terms: int, screened: bool) -> DataFrame:
    """(item, score, doc_id, doc): whole scores of rows with their queries' terms; each task keeps the k best of a query.

    screened: whether the rows hold the queries that they are candidates of; else they are of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = asked.value
        best = [np.zeros(0, dtype=np.int64)] * 5
        for b in batches:
            found = [best]
            ids, n, doc = b.column("doc_id"), b.column("n").to_numpy(), b.column("doc").to_numpy()
            known, ids = ids.is_valid().to_numpy(False).astype(np.int64), ids.fill_null(0).to_numpy()
            for r, (terms_of, tfs) in enumerate(zip(b.column("term"), b.column("tf"), strict=True)):
                tf = tfs.values.to_numpy()
                g = 1_000_000_000 * tf // (1000 * tf + 8 * (10 + 90 * int(n[r]) * docs // all_terms))
                at, of = q.rows(terms_of.values.to_numpy())
                total = q.sums(at, q.weight[at] * g[of])
                items = b.column("items")[r].values.to_numpy() if screened else np.flatnonzero(total)
                items = items[total[items] > 0].astype(np.int64)
                found.append([items, total[items], *(np.full(len(items), x[r]) for x in (known, ids, doc))])
            best = _top([np.concatenate(c) for c in zip(*found, strict=True)], k)
        item, score, known, ids, doc = best
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(score), pa.array(ids, mask=known == 0), pa.array(doc)], names=["item", "score", "doc_id", "doc"])

    have = rows.select("doc", "doc_id", "n", "found.term", "found.tf", *["items"] * screened)
    return map_arrow(have, run, "item long, score long, doc_id long, doc long")


def _screen(lists: DataFrame, asked: Broadcast) -> DataFrame:
    """(doc, items): the queries for which a document's fetched entries, and what its others could add, reach the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = asked.value
        for b in batches:
            doc, out = [], []
            for d, entries in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = entries.values
                g = got.field("g").to_numpy()
                at, of = q.rows(got.field("term").to_numpy())
                fetched = g[of] >= q.least[at]
                at, of = at[fetched], of[fetched]
                part, seen = q.sums(at, q.weight[at] * g[of]), q.sums(at, q.cap[at])
                items = np.flatnonzero((part > 0) & (part + q.rest - seen >= q.bound))
                if len(items):
                    doc.append(d)
                    out.append(items.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(out, pa.list_(pa.int32()))], names=["doc", "items"])

    return map_arrow(lists.groupBy("doc").agg(F.collect_list(F.struct("term", "g"))), run, "doc long, items array<int>")


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "doc")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _answer(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str, share: float) -> DataFrame:
    """One pass over the documents for queries whose terms are bounded in number, and so may be collected and sent to tasks."""
    spark = docs.sparkSession
    pairs = sorted((r["item"], r["item_id"], bytes(r["term"])) for r in wanted.collect())
    vocabulary = sorted({t for _, _, t in pairs})
    rows = forward_rows(docs, vocabulary, id_col, text_col)
    total = rows.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"]
    df = np.zeros(len(vocabulary), dtype=np.int64)
    met = rows.select("doc", "n", F.inline("found"))
    for r in met.groupBy("term").agg(F.count("*").alias("df")).collect():
        df[r["term"]] = r["df"]
    if not df.any():
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    # the lists: a term's postings lie together, those of a frequent one in several pieces
    pieces = F.broadcast(spark.createDataFrame([(t, 1 + int(n) // PIECE_ROWS) for t, n in enumerate(df)], "term int, pieces long"))
    dealt = met.join(pieces, "term").withColumn("piece", F.pmod(F.xxhash64("doc"), "pieces").cast("int"))
    dealt = dealt.select("term", "piece", "doc", impact(F.col("tf"), F.col("n"), n_docs, n_terms).alias("g"))
    lists = written(dealt.repartition("term", "piece").sortWithinPartitions("term", "piece", F.desc("g")))

    place = {t: i for i, t in enumerate(vocabulary)}
    number = {i: k for k, i in enumerate(sorted({i for i, _, _ in pairs}))}
    names = {number[i]: item_id for i, item_id, _ in pairs}
    term, item = np.array(sorted((place[t], number[i]) for i, _, t in pairs), dtype=np.int64).T
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) if n else 0 for n in df.tolist()], dtype=np.int64)[term]
    zero = np.zeros(len(number), dtype=np.int64)
    q = Asked(np.searchsorted(term, np.arange(len(vocabulary) + 1)), item, weight, weight, weight, zero, zero)

    # phase one: the heads of all lists, and what their documents score
    head = lists.withColumn("k", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("g"), "doc"))).filter(F.col("k") <= k)
    head = written(head.select("term", "doc", "g"))
    first = _best(_score(rows.join(head.select("doc").distinct(), "doc", "left_semi"), spark.sparkContext.broadcast(q), k, n_docs, n_terms, False), k)
    bound = zero + 1
    for r in first.groupBy("item").agg(F.min("score").alias("low"), F.count("*").alias("n")).filter(F.col("n") == k).collect():
        bound[r["item"]] = r["low"]
    most = np.zeros(len(vocabulary), dtype=np.int64)
    for r in head.groupBy("term").agg(F.max("g").alias("g")).collect():
        most[r["term"]] = r["g"]

    # phase two: from every list what reaches the query's share of its bound
    n_lists = np.bincount(item[weight > 0], minlength=len(number))
    asks = np.maximum(1, np.floor(share * bound / np.maximum(1, n_lists)).astype(np.int64))[item]
    cap = np.minimum(asks - 1, weight * most[term])
    least = np.where(weight > 0, -(-asks // np.maximum(1, weight)), np.iinfo(np.int64).max)
    q = Asked(q.start, item, weight, least, cap, bound, np.bincount(item, weights=cap, minlength=len(number)).astype(np.int64))
    loosest = np.minimum.reduceat(least, q.start[:-1])  # every place of the vocabulary has a query
    loosest = F.broadcast(spark.createDataFrame(list(enumerate(loosest.tolist())), "term int, loosest long"))
    shared = spark.sparkContext.broadcast(q)
    kept = _screen(lists.join(loosest, "term").filter("g >= loosest").select("doc", "term", "g"), shared)

    # phase three: whole scores of what is left
    best = _best(_score(rows.join(kept, "doc"), shared, k, n_docs, n_terms, True), k)
    named = F.broadcast(spark.createDataFrame(list(names.items()), "item long, item_id long"))
    return best.join(named, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = SHARE, terms_a_pass: int = TERMS_A_PASS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items the k best rows of docs with a score above 0.

    Every row is a document, and a query, of its own, also where ids repeat or
    are null. Equal scores rank by id, null first. A null or empty text has no
    term, is found by nothing and finds nothing; terms count once in a query,
    and as often as they stand in a document. Queries with more than
    `terms_a_pass` terms in all are dealt by hash to passes over the documents.
    `share`, above 0 and at most 1, is the part of an even share of the bound
    from which entries are fetched: any gives the same result, a smaller one
    fetches more and leaves fewer candidates. Result columns come from the two
    tables only, whatever else those hold.
    """
    wanted = wanted_terms(items, item_col, item_text_col)
    passes = max(1, -(-wanted.count() // terms_a_pass))
    best = None
    for p in range(passes):
        got = _answer(docs, wanted.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == p), k, id_col, text_col, share)
        best = got if best is None else best.unionByName(got)
    return best


def oracle_sql() -> str:
    """The same scores by joining all postings of the queries' terms."""
    found = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""WITH row_terms AS (SELECT row_number() OVER () AS doc, doc_id, {found} AS t FROM documents WHERE text IS NOT NULL),
    doc AS (SELECT doc, doc_id, t, len(t) AS n FROM row_terms WHERE len(t) > 0),
    total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM doc),
    item AS (SELECT row_number() OVER () AS item, item_id, list_distinct({found}) AS t FROM benchmark WHERE text IS NOT NULL),
    asked AS (SELECT item, item_id, unnest(t) AS term FROM item),
    posting AS (SELECT doc, doc_id, n, term, count(*) AS tf FROM (SELECT doc, doc_id, n, unnest(t) AS term FROM doc) x WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM posting GROUP BY term) y, total),
    part AS (SELECT doc, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) AS s FROM posting JOIN weight USING (term), total),
    scored AS (SELECT item, item_id, doc, doc_id, CAST(sum(s) AS BIGINT) AS score FROM asked JOIN part USING (term) GROUP BY ALL HAVING sum(s) > 0),
    ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST, doc) AS INTEGER) AS rank, doc_id, score FROM scored)
    SELECT * FROM ranked WHERE rank <= 10"""
