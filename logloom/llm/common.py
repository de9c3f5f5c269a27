"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.shared import checkpoint, shared_folder, spread  # noqa: F401

#: Rows, and bytes, of whole texts handed to a Python worker at once; a single longer row goes alone. Bounds the worker's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; whole texts in fewer files than there are cores are dealt out first."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small, in rows and in bytes. A value the session set itself wins."""
    for key, default, value in (("maxRecordsPerBatch", "10000", str(BATCH_ROWS)), ("maxBytesPerBatch", "67108864b", f"{BATCH_BYTES}b")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


def written(df: DataFrame, free: bool = False) -> DataFrame:
    """The rows as a table in the shared folder, read back.

    For what a loop makes anew from itself: a checkpoint keeps the constraints
    known of its columns, which grow with each round until planning takes minutes.
    free: drop the shuffle files of this write when it is done, instead of when
    the driver happens to collect its garbage.
    """
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = shared_folder(spark, "written"), spark.conf.get(key, "false")
    spark.conf.set(key, "true" if free else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % m


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    prepare(df.sparkSession)
    return df.mapInArrow(fn, schema)


def bounded_sample(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """`rows` rows at most in expectation, chosen by a hash of the id.

    Only for fitting models; the bound is the operators' documented parameter.
    """
    total = df.select(id_col).count()
    if total <= rows:
        return df
    return df.filter(F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col(id_col)), 2) < int(rows / total * 2**62))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: Column, rows: int, parts: int = 8) -> DataFrame:
    """(id, text, y): at most about `rows` labelled rows for each value of the label.

    The choice is made on the narrow label table, so what is broadcast to the
    scan of the texts is no larger than the documented bound. Rows without a
    label, text or matching id are left out.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), label.cast("int").alias("y")).filter("id is not null and y is not null").distinct()
    size = sorted(r["y"] for r in known.groupBy("y").count().collect())
    if not size:
        size = [0]
    chosen = None
    for y in size:
        one = bounded_sample(known.filter(F.col("y") == y), "id", rows)
        chosen = one if chosen is None else chosen.unionByName(one)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    return checkpoint(texts.join(F.broadcast(chosen), "id").repartition(parts))


def map_texts(docs: DataFrame, text_col: str, new: list[tuple[str, str, pa.DataType]], score: Callable[[list], list[list]], columns: list[str] | None = None) -> DataFrame:
    """docs with new columns made from whole texts; score(texts) gives a list of values for each new column.

    columns: those of docs that return; all where None. Columns of docs named
    like a new one (in any case) are replaced.
    """
    taken = {n.lower() for n, _, _ in new}
    kept = [c for c in (docs.columns if columns is None else columns) if c.lower() not in taken]
    src = docs.select(F.col(f"`{text_col}`").cast("string").alias("__text"), *[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = score(b.column(0).to_pylist())
            made = [pa.array(v, t) for v, (_, _, t) in zip(got, new, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *made], names=[*b.schema.names[1:], *(n for n, _, _ in new)])

    kinds = dict(src.dtypes)
    return map_arrow(src, run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *(f"`{n}` {k}" for n, k, _ in new)]))


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges (i, j): the smallest node of each node's component."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        keep = a != b
        if not keep.any():
            break
        i, j, a, b = i[keep], j[keep], a[keep], b[keep]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def split_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20000) -> Iterator[pa.Table]:
    """Runs of equal keys arrive together (sorted input); yield tables that end at a key's end."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        held.append(t)
        size += t.num_rows
        if size < rows:
            continue
        whole = pa.concat_tables(held).combine_chunks()
        change = np.zeros(whole.num_rows, dtype=bool)
        change[0] = True
        for k in keys:
            v = whole.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        at = int(np.flatnonzero(change)[-1])
        if at:
            yield whole.slice(0, at)
        held = [whole.slice(at)]
        size = whole.num_rows - at
    if size:
        yield pa.concat_tables(held).combine_chunks()
