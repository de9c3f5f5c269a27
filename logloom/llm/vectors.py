"""Near-duplicate vectors by sorted projection passes.

Equal vectors collapse into one first. Each pass hashes a vector with HASHES
random rotations, whose largest coordinate is the hash, orders all vectors
lexicographically by the concatenated hashes (a range partitioning, so equal or
crowded keys spread over tasks) and compares every vector with its `window`
successors, across the ends of partitions too. Cosines are taken in single
precision, those near the threshold again in double. Verified pairs are folded
into a forest inside each task; the forests of all passes are united into
components. The number of passes follows the number of vectors; then passes go
on until one joins next to nothing more, so crowded regions get as many as they
need. Links are counted inside components: in one block if a component has few
members, else block against block, dealt to tasks. Blocks whose members' angles
to the centre prove them all linked, or not linked at all, are counted without
comparing anything.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import checkpoint, local_components, map_arrow, split_groups, written
from logloom.llm.components import connected_components

#: Hashes concatenated to a key of at most KEY_BITS bits.
HASHES = 6
KEY_BITS = 62
WINDOW = 256
#: Share of isolated pairs just above a cosine of 0.95 that the first passes may leave.
MISS = 0.02
#: Passes go on until one joins no more than this share of all that were joined; and their number at most.
SETTLED = 0.003
MOST_PASSES = 40
#: Vectors of an ordering that are compared as one block with themselves and the window that follows.
SPAN = 512
#: Members of a component that are compared as one block.
BLOCK = 1024
#: Bins of the angle to a component's centre, over half a turn.
ANGLE_BINS = 4096
#: Slack on cosines near the threshold, beyond the rounding of double precision.
EPS = 1e-9


def matrix(col: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Rows of a binary column of numbers of that kind; all rows have one length."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros((0, 0), dtype=kind)
    wide = pa.types.is_large_binary(col.type)
    at = np.frombuffer(col.buffers()[1], dtype="<i8" if wide else "<i4", count=len(col) + 1 + col.offset)[col.offset :]
    flat = np.frombuffer(col.buffers()[2], dtype=np.uint8)[at[0] : at[-1]]
    return np.ascontiguousarray(flat).view(kind).reshape(len(col), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kind_of(vectors: DataFrame, vec_col: str) -> str:
    """Numbers are packed as the column has them: single precision, or double for all else."""
    return "<f4" if dict(vectors.dtypes)[vec_col] == "array<float>" else "<f8"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, h1, h2, v): vectors that can link, packed, and a hash of their value.

    Left out: null ids, null or empty vectors, any null or non-finite component,
    zero vectors. Rows that repeat an id count once, by their first value.
    """
    kind = kind_of(vectors, vec_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, packed = [], []
            lists = b.column(1)
            flat = lists.values.to_numpy(zero_copy_only=False)
            at = lists.offsets.to_numpy()
            size = np.diff(at)
            good = np.asarray(b.column(0).is_valid()) & np.asarray(lists.is_valid()) & (size > 0)
            holes = np.concatenate([[0], np.cumsum(~np.isfinite(flat) if len(flat) else [])])
            some = np.concatenate([[0], np.cumsum(flat != 0 if len(flat) else [])])
            good &= (holes[at[1:]] == holes[at[:-1]]) & (some[at[1:]] > some[at[:-1]])
            flat = (flat + 0).astype(kind)  # one zero
            id_ = b.column(0).to_pylist()
            for k in np.flatnonzero(good).tolist():
                ids.append(id_[k])
                packed.append(flat[at[k] : at[k + 1]].tobytes())
            h = np.array([divmod(xxhash.xxh3_128_intdigest(v), 1 << 64) for v in packed], dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(packed, pa.binary())], names=["id", "h1", "h2", "v"])

    v = F.col(vec_col)
    rows = map_arrow(vectors.select(F.col(id_col).cast("long").alias("id"), (v if kind == "<f4" else v.cast("array<double>")).alias("v")), run, "id long, h1 long, h2 long, v binary")
    if vectors.groupBy(F.col(id_col).cast("long").alias("id")).count().filter("id is not null and count > 1").isEmpty():
        return rows
    return rows.groupBy("id").agg(F.min(F.struct("v", "h1", "h2")).alias("x")).select("id", "x.h1", "x.h2", "x.v")


def rotation(dim: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))[0].astype(np.float32)


def hash_keys(x: np.ndarray, seed: int) -> np.ndarray:
    """The concatenated hashes of unit vectors, the first as the most significant, as a
    non-negative long: under each rotation the largest coordinate and its sign."""
    bits = (2 * x.shape[1] - 1).bit_length()
    key = np.zeros(len(x), dtype=np.int64)
    for k in range(max(1, min(HASHES, KEY_BITS // bits))):
        y = x @ rotation(x.shape[1], seed * HASHES + k)
        top = np.abs(y).argmax(axis=1)
        key = key << np.int64(bits) | (2 * top + (y[np.arange(len(x)), top] > 0))
    return key


def _by_dimension(t: pa.Table, kind: str, name: str = "v") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) for each length."""
    col = t.column(name)
    dims = np.array([len(x) for x in col.to_pylist()]) if t.num_rows else np.zeros(0, dtype=int)
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield at, matrix(col if len(at) == len(dims) else col.take(pa.array(at)), kind)


def with_keys(classes: DataFrame, seeds: list[int], kind: str) -> DataFrame:
    """classes with `keys`: one sort key for each pass."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            keys = np.zeros((t.num_rows, len(seeds)), dtype=np.int64)
            for at, x in _by_dimension(t, kind):
                x = unit(x).astype(np.float32)
                for k, seed in enumerate(seeds):
                    keys[at, k] = hash_keys(x, seed)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(t.num_rows + 1, dtype=np.int32) * len(seeds)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["id", "v", "keys"])

    return map_arrow(classes.select("id", "v"), keyed, "id long, v binary, keys array<long>")


def near_pairs(x: np.ndarray, threshold: float, window: int, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of unit rows with the cosine: all within `window` places, and some further apart."""
    slim = x.astype(np.float32)
    doubt = 1e-5 + 4e-7 * x.shape[1]  # beyond the rounding of single precision
    us, vs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for a in range(0, len(x), span):
        cos = slim[a : a + span] @ slim[a : a + span + window].T
        i, j = np.nonzero(cos >= threshold - doubt)
        later = i < j
        i, j = i[later], j[later]
        close = np.flatnonzero(cos[i, j] <= threshold + doubt)
        if len(close):
            sure = np.einsum("ij,ij->i", x[a + i[close]], x[a + j[close]]) >= threshold
            i, j = np.delete(i, close[~sure]), np.delete(j, close[~sure])
        us.append(i + a)
        vs.append(j + a)
    return np.concatenate(us), np.concatenate(vs)


def one_pass(keyed: DataFrame, p: int, threshold: float, window: int, kind: str, parts: int) -> DataFrame:
    """(u, v) long: a forest of the pairs that one ordering brings together, materialised."""

    def forest(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        label = local_components(len(x), *near_pairs(x, threshold, window))
        got = np.flatnonzero(label != np.arange(len(x)))
        return ids[got], ids[label[got]]

    names = ["u", "w", "part", "pos", "v"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links (u, w) of a partition, and its first and last rows with their place."""
        part, pos = TaskContext.get().partitionId(), 0
        tail_id, tail = np.zeros(0, dtype=np.int64), {}
        last: list[tuple[int, int, bytes]] = []
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            ids_all = t.column("id").to_numpy()
            us, vs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for at, x in _by_dimension(t, kind):
                ids, x = ids_all[at], unit(x)
                if x.shape[1] in tail:
                    tail_id, before = tail[x.shape[1]]
                    ids, x = np.concatenate([tail_id, ids]), np.concatenate([before, x])
                u, v = forest(ids, x)
                us.append(u)
                vs.append(v)
                tail[x.shape[1]] = ids[-window:], x[-window:]
            rows = t.column("v")
            head = list(range(min(b.num_rows, max(0, window - pos))))
            first = [(pos + k, int(ids_all[k]), rows[k].as_py()) for k in head]
            last += [(pos + k, int(ids_all[k]), rows[k].as_py()) for k in range(max(len(head), b.num_rows - window), b.num_rows)]
            last = last[-window:]
            pos += b.num_rows
            u, v = np.concatenate(us), np.concatenate(vs)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), *(pa.nulls(len(u), k) for k in (pa.int32(), pa.int64(), pa.binary()))], names=names)
            yield edge_rows(part, first)
        yield edge_rows(part, last)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([pos], pa.int64()), pa.array([part], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary())], names=names)

    def edge_rows(part: int, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.nulls(len(rows), pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=names)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in split_groups(batches, ["run"], rows=2 * window):
            b = t.column("run").to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]]))
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                one = t.slice(lo, hi - lo)
                for at, x in _by_dimension(one, kind):
                    u, v = forest(one.column("id").to_numpy()[at], unit(x))
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    placed = keyed.select(F.element_at("keys", p + 1).alias("key"), "id", "v").repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id").select("id", "v")
    found = checkpoint(map_arrow(placed, compare, "u long, w long, part int, pos long, v binary"))
    # the ends of partitions: a row near an end meets the rows within the window beyond it
    size = found.filter("u is null").select("part", F.col("w").alias("n"))
    after = F.sum("n").over(Window.orderBy("part"))  # one row for each partition
    ends = checkpoint(size.withColumn("end", after).withColumn("start", F.col("end") - F.col("n")))
    edge = found.filter("v is not null").join(F.broadcast(ends.select("part", "start")), "part").select((F.col("start") + F.col("pos")).alias("rank"), F.col("u").alias("id"), "v")
    span = max(SPAN, window)
    run = F.floor(F.col("rank") / span)
    runs = F.when((run > 0) & (F.col("rank") % span < window), F.array(run, run - 1)).otherwise(F.array(run))
    dealt = edge.select(F.explode(runs).alias("run"), "rank", "id", "v").repartition("run").sortWithinPartitions("run", "rank").select("run", "id", "v")
    links = found.filter("w is not null and u is not null").select("u", F.col("w").alias("v"))
    return checkpoint(links.unionByName(map_arrow(dealt, across, "u long, v long")).distinct())


def release(df: DataFrame) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def count_block(x: np.ndarray, y: np.ndarray | None, threshold: float, w: np.ndarray, z: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Weight that each row links with: within x, itself included, or between x and y (for both)."""
    if y is None:
        hit = (x @ x.T) >= threshold
        np.fill_diagonal(hit, True)
        return hit @ w, None
    hit = (x @ y.T) >= threshold
    return hit @ z, w @ hit


def centres(members: DataFrame, kind: str) -> DataFrame:
    """(root, p): the sum of each component's unit vectors, added up where they lie first."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            roots, at = np.unique(b.column("root").to_numpy(), return_inverse=True)
            total: dict[int, np.ndarray] = {}
            t = pa.Table.from_batches([b])
            for same, x in _by_dimension(t, kind):  # members of a component have one length
                x = unit(x)
                for k in np.unique(at[same]):
                    total[int(roots[k])] = x[at[same] == k].sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["root", "v"])

    parts = map_arrow(members.select("root", "v"), sums, "root long, v array<double>").select("root", F.posexplode("v").alias("k", "x"))
    whole = parts.groupBy("root", "k").agg(F.sum("x").alias("x")).groupBy("root").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("l"))
    return whole.select("root", F.transform("l", lambda e: e.x).alias("p"))


def exact_links(members: DataFrame, threshold: float, kind: str, block: int = BLOCK) -> DataFrame:
    """(id, w, v, root) -> (id, n): the weight of all that a member links with inside its component, itself included.

    Components of up to `block` members are one group. The members of larger ones
    are put into bins by their angle to the centre. The triangle inequality shows
    for most pairs of bins that all their members link, or none; the members of the
    remaining pairs are compared, block against block.
    """
    # small aggregates are checkpointed: a component with a third of the rows is then split in the joins with them
    size = checkpoint(members.groupBy("root").agg(F.count("*").alias("m")))
    sized = members.join(size, "root")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in split_groups(batches, ["root"], rows=2000):
            root, w = t.column("root").to_numpy(), t.column("w").to_numpy()
            n = np.zeros(t.num_rows, dtype=np.int64)
            cut = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1], [True]]))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                n[a:b], _ = count_block(unit(matrix(t.column("v").slice(a, b - a), kind)), None, threshold, w[a:b])
            yield pa.RecordBatch.from_arrays([t.column("id").combine_chunks(), pa.array(n)], names=["id", "n"])

    small = sized.filter(F.col("m") <= block).select("root", "id", "w", "v").repartition("root").sortWithinPartitions("root")
    few = map_arrow(small, within, "id long, n long")
    large = size.filter(F.col("m") > block)
    if large.isEmpty():
        return few

    # the members of a large component in bins by their angle to its centre
    giant = checkpoint(sized.filter(F.col("m") > block).select("root", "id", "w", "v"))
    centre = checkpoint(centres(giant, kind))

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            angle = np.full(t.num_rows, np.pi / 2)  # without a centre all are put at a right angle, which decides nothing
            roots = t.column("root").to_numpy()
            for at, x in _by_dimension(t, kind):
                x = unit(x)
                for r in np.unique(roots[at]):
                    own = np.flatnonzero(roots[at] == r)
                    p = np.array(t.column("p")[int(at[own[0]])].as_py())
                    if np.linalg.norm(p) > 0:
                        angle[at[own]] = np.arccos(np.clip(x[own] @ (p / np.linalg.norm(p)), -1.0, 1.0))
            yield pa.RecordBatch.from_arrays([*(t.column(k).combine_chunks() for k in ("root", "id", "w", "v")), pa.array(angle)], names=["root", "id", "w", "v", "angle"])

    placed = map_arrow(giant.join(centre, "root").select("root", "id", "w", "v", "p"), angles, "root long, id long, w long, v binary, angle double")
    placed = checkpoint(placed.withColumn("bin", F.floor(F.col("angle") / F.lit(np.pi) * ANGLE_BINS)))
    bins = placed.groupBy("root", "bin").agg(F.sum("w").alias("c"), F.count("*").alias("m"), F.min("angle").alias("lo"), F.max("angle").alias("hi"))
    bins = checkpoint(bins.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("m") / block)).cast("int")).drop("m"))
    dealt = placed.join(bins.select("root", "bin", "parts"), ["root", "bin"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    # pairs of bins, of which a component has a bounded number: those too far apart are left out
    limit = float(np.arccos(min(1.0, threshold)))
    a, b = bins.alias("a"), bins.alias("b")
    both = a.join(b, (F.col("a.root") == F.col("b.root")) & (F.col("a.bin") <= F.col("b.bin")) & (F.col("b.lo") - F.col("a.hi") <= limit + EPS))
    sure = F.col("a.hi") + F.col("b.hi") < limit - EPS
    both = checkpoint(both.select(F.col("a.root").alias("root"), F.col("a.bin").alias("abin"), F.col("b.bin").alias("bbin"), F.col("a.c").alias("ac"), F.col("b.c").alias("bc"), F.col("a.parts").alias("ap"), F.col("b.parts").alias("bp"), sure.alias("sure")))
    # decided by the angles: every member of the one bin links with every member of the other
    known = both.filter("sure").select(F.explode(F.expr("if(abin = bbin, array(struct(root, abin as bin, ac as n)), array(struct(root, abin as bin, bc as n), struct(root, bbin as bin, ac as n)))")).alias("x")).select("x.*")
    known = checkpoint(known.groupBy("root", "bin").agg(F.sum("n").alias("n")))
    counted = dealt.select("root", "bin", "id").join(known, ["root", "bin"]).select("id", "n")
    # the others are compared, each pair of blocks a group of its own
    open_ = both.filter("not sure").select("root", "abin", "bbin", F.explode(F.expr("sequence(0, ap - 1)")).alias("pa"), "bp").select("root", "abin", "bbin", "pa", F.explode(F.expr("sequence(0, bp - 1)")).alias("pb")).filter("abin < bbin or pa <= pb")
    open_ = open_.withColumn("pair", F.monotonically_increasing_id()).select(F.explode(F.expr("if(abin = bbin and pa = pb, array(struct(root, abin as bin, pa as part, pair, 2 as side)), array(struct(root, abin as bin, pa as part, pair, 0 as side), struct(root, bbin as bin, pb as part, pair, 1 as side)))")).alias("x")).select("x.*")
    sides = checkpoint(open_).join(dealt, ["root", "bin", "part"]).select("pair", "side", "id", "w", "v").repartition("pair").sortWithinPartitions("pair", "side")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in split_groups(batches, ["pair"], rows=2000):
            pair, side, w = (t.column(k).to_numpy() for k in ("pair", "side", "w"))
            n = np.zeros(t.num_rows, dtype=np.int64)
            cut = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1], [True]]))
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                x = unit(matrix(t.column("v").slice(lo, hi - lo), kind))
                m = int((side[lo:hi] == 0).sum())
                if side[lo] == 2:  # a block with itself; one of two blocks may be empty
                    n[lo:hi], _ = count_block(x, None, threshold, w[lo:hi])
                else:
                    n[lo : lo + m], n[lo + m : hi] = count_block(x[:m], x[m:], threshold, w[lo : lo + m], w[lo + m : hi])
            yield pa.RecordBatch.from_arrays([t.column("id").combine_chunks(), pa.array(n)], names=["id", "n"])

    many = counted.unionByName(map_arrow(sides, across, "id long, n long")).groupBy("id").agg(F.sum("n").alias("n"))
    return few.unionByName(many)


def passes_for(rows: int, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes after which about `miss` of isolated pairs of cosine 0.95 are not found yet.

    A pass finds such a pair among n vectors with a probability of about
    (n / window) ** -0.11, measured from 10,000 to 1,000,000 vectors of 64
    components; one pass meets all pairs of a table that fits a window.
    """
    found = min(1.0, (max(rows, 1) / window) ** -0.11)
    return 1 if found >= 1 - miss else math.ceil(math.log(miss) / math.log(1 - found))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, passes: int | None = None, window: int = WINDOW, seed: int = 7, settled: float = SETTLED) -> DataFrame:
    """One row per input row: (id, n_links, component_id, kept).

    Vectors link if their cosine in double precision is at least threshold;
    vectors of different lengths never do. Null, empty and zero vectors, and
    those with a null or non-finite component, link with nothing. component_id
    is the smallest id reachable; kept says that it is the row's own. Ids are
    taken as unique: rows that repeat an id count as one vector of that id
    (its first by value), and each returns. A null id has null component_id and is
    not kept. Other columns are ignored; an empty table gives an empty result.
    Links between two components that no pass connects are missed, in n_links too;
    `passes` are made (by the number of rows where None), then more until one
    joins at most `settled` of all that was joined.
    """
    kind = kind_of(vectors, vec_col)
    rows = checkpoint(usable(vectors, id_col, vec_col))
    classes = checkpoint(rows.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("w"), F.first("v").alias("v")))
    n = classes.count()
    first = passes_for(n, window) if passes is None else passes
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(max(cores, n // 200_000), n // (4 * window)))
    keyed = checkpoint(with_keys(classes, list(range(seed, seed + first)), kind))
    edges = None
    for p in range(first):
        found = one_pass(keyed, p, threshold, window, kind, parts)
        release(found)
        edges = found if edges is None else edges.unionByName(found)
    roots = written(connected_components(edges))
    for p in range(first, MOST_PASSES if n > window and settled >= 0 else first):
        more = one_pass(with_keys(classes, [seed + p], kind), 0, threshold, window, kind, parts)
        for end in ("u", "v"):
            at = roots.select(F.col("node").alias(end), F.col("root").alias("r"))
            more = more.join(at, end, "left").withColumn(end, F.coalesce("r", end)).drop("r")
        more = checkpoint(more.filter("u != v").distinct())
        joined, linked = more.count(), roots.count()
        if joined:
            up = connected_components(more)
            old = roots.join(up.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
            roots = written(old.unionByName(up.join(roots, "node", "left_anti").select("node", "root")))
        release(more)
        if joined <= settled * linked:
            break
    members = checkpoint(classes.select("id", "w", "v").join(roots.withColumnRenamed("node", "id"), "id"))
    links = members.select("id", "root").join(exact_links(members, threshold, kind), "id")
    named = classes.select("h1", "h2", "id", "w").join(links, "id", "left").select("h1", "h2", F.coalesce("root", "id").alias("component_id"), (F.coalesce("n", "w") - 1).alias("n_links"))
    own = rows.select("id", "h1", "h2").join(checkpoint(named), ["h1", "h2"]).select("id", "component_id", "n_links")
    every = vectors.select(F.col(id_col).cast("long").alias("id"))
    out = every.join(own, "id", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
