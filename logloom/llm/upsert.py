"""Copy-on-write keyed upsert into a folder of sorted Parquet files.

Files hold ascending, adjacent ranges of keys. Of a log of changes the newest
of each key wins and goes to its home, the file whose range the key is in. Only
homes with winners are read: one task for each takes the file's rows and its
part of the log, joins them fully and compares every set column. A file whose
rows do not differ is left alone; else its rows are cut anew, small neighbours
that were both rewritten are put together, and each new file is written by one
task. What the driver and broadcasts hold is a row for each file, of which
there may be MOST_FILES at most; rows of the table or the log never go there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import map_arrow, shared_folder
from logloom.sources.logs import number_lines

#: Files of a table, at most: a row for each, of some hundred bytes, is planned on the driver.
MOST_FILES = 100_000
#: What one task's full join may hold in memory; beyond that it spills to its own disk, and cleans that up.
JOIN_MEMORY = "512MB"
_SLOT, _SIDE, _PIECE = "__slot", "__side", "__piece"
_BASE, _SET, _DELETE = 0, 1, 2


def _write(rows: DataFrame, names: list[str], path: str, files: int, file: str, order: list[str], mode: str = "error") -> None:
    """One file for each value 0..files-1 of a column, each by one task, in the order of others; columns c0, c1 ... get their names."""
    named = [F.col(f"c{k}").alias(c) for k, c in enumerate(names)]
    rows.repartitionById(files, file).sortWithinPartitions(*order).select(*named).write.mode(mode).parquet(path)


def _plain(rows: DataFrame) -> DataFrame:
    """The columns as c0, c1 ..., so that no name of theirs clashes with one of this module."""
    return rows.toDF(*[f"c{k}" for k in range(len(rows.columns))])


def _order(names: list[str], key: str) -> list[str]:
    at = names.index(key)
    return [f"c{at}", *(f"c{k}" for k in range(len(names)) if k != at)]


def create(rows: DataFrame, path: str, key: str, rows_per_file: int) -> None:
    """Write a table of files of `rows_per_file` rows, the last with the rest, sorted by key and then by the other columns.

    An empty table becomes one file without rows.
    """
    numbered = number_lines(_plain(rows), *_order(rows.columns, key), name="n")
    files = max(1, -(-numbered.count() // rows_per_file))
    if files > MOST_FILES:
        raise ValueError(f"{files} files, at most {MOST_FILES}: take more rows a file")
    _write(numbered.withColumn("file", F.expr(f"(n - 1) div {rows_per_file}").cast("int")), rows.columns, path, files, "file", ["n"])


def files_of(spark: SparkSession, path: str, key: str) -> list[tuple[str, object, int]]:
    """(path, first key, rows) of a table's files that have rows, in the order of their keys."""
    table = spark.read.parquet(path)
    got = table.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min(F.col(f"`{key}`")).alias("first"), F.max(F.col(f"`{key}`")).alias("last"), F.count("*").alias("n"))
    if got.limit(MOST_FILES + 1).count() > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} files")
    return [(r["path"], r["first"], r["n"]) for r in sorted(got.collect(), key=lambda r: (r["first"], r["last"], r["path"]))]


def winners(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each key the row that is last by the order's columns, nulls first; ties go by the other columns. Rows without a key are left out."""
    ranked = [*order, *(c for c in changes.columns if c not in {key, *order})]
    best = changes.filter(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`")).agg(F.max(F.struct(*[F.col(f"`{c}`") for c in ranked])).alias("__best"))
    return best.select(F.col(f"`{key}`"), *[F.col("__best")[c].alias(c) for c in ranked])


def at_home(rows: DataFrame, key: str, firsts: list) -> DataFrame:
    """rows with their home's place (`__slot`) and first key (`__first`); keys before the first file are at home there."""
    starts = rows.sparkSession.sparkContext.broadcast(np.array(firsts))
    kind = dict(rows.dtypes)[key]

    @F.pandas_udf("int")
    def home(keys: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(starts.value, keys.to_numpy(), side="right") - 1, 0), dtype="int32")

    first = rows.sparkSession.createDataFrame([(k, f) for k, f in enumerate(firsts)], f"{_SLOT} int, __first {kind}")
    return rows.withColumn(_SLOT, home(F.col(f"`{key}`"))).join(F.broadcast(first), _SLOT)


def _joined(rows: DataFrame, schema: T.StructType, key: str, sets: list[str], rows_per_file: int) -> DataFrame:
    """For each slot whose rows differ from its file's: a mark (piece 0), and the new rows with the piece they go to."""
    order = _order(schema.names, key)
    changing = {f"c{schema.names.index(c)}" for c in sets}
    names = [f"c{k}" for k in range(len(schema))]
    taken = ", ".join(f"CASE WHEN l.{_SIDE} IS NULL THEN b.{c} ELSE l.{c} END AS {c}" if c in {order[0], *changing} else f"b.{c}" for c in names)
    differs = " OR ".join(f"b.{c} IS DISTINCT FROM l.{c}" for c in sorted(changing)) or "false"
    joined = f"SELECT {taken}, b.{_SIDE} AS had, l.{_SIDE} AS got, ({differs}) AS differs FROM base b FULL JOIN log l ON b.{order[0]} = l.{order[0]}"
    fields = [T.StructField(_SLOT, T.IntegerType()), T.StructField(_PIECE, T.LongType()), *(T.StructField(c, f.dataType) for c, f in zip(names, schema, strict=True))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con, slot, target = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            if con is None:
                slot, target = b.column(0)[0].as_py(), pa.schema([pa.field(_SLOT, pa.int32()), pa.field(_PIECE, pa.int64()), *(b.schema.field(c) for c in names)])
                con = duckdb.connect(config={"threads": 1, "memory_limit": JOIN_MEMORY})
                con.register("batch", b)
                con.execute("CREATE TABLE base AS SELECT * FROM batch LIMIT 0")
                con.execute("CREATE TABLE log AS SELECT * FROM batch LIMIT 0")
            con.register("batch", b)
            con.execute(f"INSERT INTO base SELECT * FROM batch WHERE {_SIDE} = {_BASE}")
            con.execute(f"INSERT INTO log SELECT * FROM batch WHERE {_SIDE} <> {_BASE}")
        if con is None:
            return
        con.execute(f"CREATE TABLE merged AS {joined}")
        changed = con.execute(f"SELECT count(*) FROM merged WHERE CASE WHEN got = {_DELETE} THEN had IS NOT NULL WHEN got = {_SET} THEN had IS NULL OR differs ELSE false END").fetchall()[0][0]
        if changed:
            stays = f"FROM merged WHERE got IS DISTINCT FROM {_DELETE}"
            cuts = max(1, -(-con.execute(f"SELECT count(*) {stays}").fetchall()[0][0] // rows_per_file))
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([slot, 0, *[None] * len(names)], target, strict=True)], schema=target)
            by = ", ".join(f"{c} NULLS FIRST" for c in order)
            out = con.execute(f"SELECT CAST({slot} AS INTEGER) AS {_SLOT}, ntile({cuts}) OVER (ORDER BY {by}) AS {_PIECE}, {', '.join(names)} {stays}").to_arrow_reader(10_000)
            for piece in out:
                yield from pa.Table.from_batches([piece]).cast(target).to_batches()
        con.close()

    return map_arrow(rows, run, T.StructType(fields))


def together(pieces: list[tuple[bool, int]], most: int) -> list[int]:
    """For files in order (rewritten, rows): the number of the file each goes to, a rewritten one to
    its left neighbour as it has grown so far, if that is rewritten too and both have `most` rows at most."""
    out: list[int] = []
    last, size = False, 0
    for rewritten, n in pieces:
        joins = bool(out) and last and rewritten and size + n <= most
        out.append((out[-1] if joins else out[-1] + 1) if out else 0)
        size = size + n if joins else n
        last = rewritten
    return out


def upsert(spark: SparkSession, path: str, changes: DataFrame, key: str, order: list[str], sets: list[str], rows_per_file: int, deletes: Column | None = None, ignores: Column | None = None) -> tuple[list[str], list[str]]:
    """Apply a log of changes to the table below `path`; give the paths of files removed, and kept as they were.

    key: not null in the table; changes without one are left out. Equal keys in
    the table all change, if they are in the file that is their home.
    order: columns of changes by which the last row of a key wins. sets: columns
    that a change sets, nulls too; an absent key is inserted, its other columns
    null. deletes, ignores: conditions over the columns of changes and `__first`,
    the first key of a row's home; null counts as false. Other columns of changes
    are not looked at. A table without rows has no homes and stays empty. New
    files are complete before old ones go; a reader in between sees both, so
    concurrent readers need a table format's log on top.
    """
    schema = spark.read.parquet(path).schema
    before = files_of(spark, path, key)
    if not before:
        return [], []
    log = at_home(winners(changes.drop(_SLOT, "__first"), key, order), key, [first for _, first, _ in before])
    if ignores is not None:
        log = log.filter(~F.coalesce(ignores, F.lit(False)))
    side = F.when(F.coalesce(deletes if deletes is not None else F.lit(False), F.lit(False)), _DELETE).otherwise(_SET)
    value = lambda f: F.col(f"`{f.name}`") if f.name in {key, *sets} else F.lit(None)
    staged = log.select(_SLOT, side.cast("tinyint").alias(_SIDE), *[value(f).cast(f.dataType).alias(f"c{k}") for k, f in enumerate(schema)])
    where = shared_folder(spark, "upsert")
    staged.write.parquet(f"{where}/log")
    staged = spark.read.schema(staged.schema).parquet(f"{where}/log")
    touched = sorted(r[0] for r in staged.select(_SLOT).distinct().collect())  # homes, so files at most
    if not touched:
        return [], [p for p, _, _ in before]
    dense = spark.createDataFrame([(s, k, before[s][0]) for k, s in enumerate(touched)], f"{_SLOT} int, home int, path string")
    base = spark.read.schema(schema).parquet(*[before[s][0] for s in touched])
    base = base.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(schema.names)], F.col("_metadata.file_path").alias("path")).join(F.broadcast(dense), "path")
    base = base.withColumn(_SIDE, F.lit(_BASE).cast("tinyint")).select(*staged.columns, "home")
    met = base.unionByName(staged.join(F.broadcast(dense.drop("path")), _SLOT))
    joined = _joined(met.repartitionById(len(touched), "home").drop("home"), schema, key, sets, rows_per_file)
    joined.write.parquet(f"{where}/merged")
    merged = spark.read.schema(joined.schema).parquet(f"{where}/merged")

    found = {(r[_SLOT], r[_PIECE]): r["n"] for r in merged.groupBy(_SLOT, _PIECE).agg(F.count("*").alias("n")).collect()}
    changed = {s for s, p in found if p == 0}
    pieces = sorted([(s, p, n) for (s, p), n in found.items() if p] + [(s, 0, n) for s, (_, _, n) in enumerate(before) if s not in changed])
    if len(pieces) > MOST_FILES:
        raise ValueError(f"{len(pieces)} files, at most {MOST_FILES}: take more rows a file")
    to = together([(p > 0, n) for _, p, n in pieces], rows_per_file)
    new = sorted({t for t, (_, p, _) in zip(to, pieces, strict=True) if p})
    number = {t: k for k, t in enumerate(new)}
    if new:
        plan = spark.createDataFrame([(s, p, number[t]) for t, (s, p, _) in zip(to, pieces, strict=True) if p], f"{_SLOT} int, {_PIECE} long, file int")
        rows = merged.join(F.broadcast(plan), [_SLOT, _PIECE])
        _write(rows, schema.names, path, len(new), "file", [_SLOT, _PIECE, *_order(schema.names, key)], "append")
    removed = [before[s][0] for s in sorted(changed)]
    jvm = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    for p in removed:
        at = jvm.Path(spark._jvm.java.net.URI(p))
        if not at.getFileSystem(conf).delete(at, False):
            raise OSError(f"cannot delete {p}")
    return removed, [p for s, (p, _, _) in enumerate(before) if s not in changed]


def digests(spark: SparkSession, path: str, key: str, totals: list[Column]) -> DataFrame:
    """(path, first key, n_rows, ids_sha256, columns, totals) of each file of a table: hash of the keys in the file's order, joined by commas."""
    table = spark.read.parquet(path)
    rows = table.withColumn("__path", F.col("_metadata.file_path")).withColumn("__row", F.col("_metadata.row_index"))
    sums = rows.groupBy("__path").agg(F.min_by(F.col(f"`{key}`"), "__row").alias("first_id"), F.count("*").alias("n_rows"), *totals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h = None, None
        for b in batches:
            paths, keys = b.column(0).to_pylist(), b.column(1).to_pylist()
            starts = [0, *(k for k in range(1, len(paths)) if paths[k] != paths[k - 1]), len(paths)]
            for lo, hi in zip(starts, starts[1:], strict=False):
                if lo == hi:
                    continue
                if paths[lo] != at:
                    if h is not None:
                        yield pa.RecordBatch.from_pydict({"__path": [at], "ids_sha256": [h.hexdigest()]})
                    at, h = paths[lo], hashlib.sha256()
                else:
                    h.update(b",")
                h.update(",".join(keys[lo:hi]).encode())
        if h is not None:
            yield pa.RecordBatch.from_pydict({"__path": [at], "ids_sha256": [h.hexdigest()]})

    # one task goes through a file's keys in their order, streaming
    ordered = rows.select("__path", F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("__key"), "__row").repartition("__path").sortWithinPartitions("__path", "__row")
    hashed = map_arrow(ordered.select("__path", "__key"), run, "__path string, ids_sha256 string")
    return sums.join(hashed, "__path").withColumnRenamed("__path", "path").withColumn("columns", F.lit(",".join(table.columns)))
