"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are 64-bit majority votes over XXH64 of words or word shingles.
Linking works on the distinct fingerprints only, so copies collapse first. Two
tries walked together drop a pair of nodes as soon as their differing bits
exceed the error budget. The bits are cut into three blocks; a pair within the
budget has at most a third of it in some block, so each arrangement of the bits
puts one block on top, where only that third may be spent. Where that third is
not zero, the block is cut in turn, so that every arrangement begins with bits
that agree: they are the shuffle key. A key with more than `hot` fingerprints
is dealt out further: its node pairs SPLIT_BITS lower become groups of their
own, so no task gets a whole hot key. Each group gives the shortest links that
join its components, at most one for a fingerprint, and skips node pairs whose
members are all joined already; a dense group never becomes all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import checkpoint, local_components, map_arrow, split_groups
from logloom.llm.components import connected_components

BITS = 64
SPLIT_BITS = 8
HOT = 1 << 18
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_AT = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes | None, k: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of one UTF-8 text; null or wordless text gives 0."""
    words = text.lower().split() if text else []  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(joined, seed)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(joined[a:b], seed) for a, b in zip(start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)], dtype="<u8")
    seen = np.bincount((h.view(np.uint8).reshape(-1, 8) + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int.from_bytes(np.packbits((seen * 2 > len(h)).ravel(), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, k, seed) for t in b.column(1).to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return map_arrow(src, run, "id long, fp long")


@dataclass(frozen=True)
class Arrangement:
    """An order of the fingerprint's bits, as segments (first bit, length)."""

    segments: tuple[tuple[int, int], ...]
    exact: int  # leading bits that must agree: the shuffle key
    limits: tuple[int, ...]  # errors allowed after each number of bits

    def sql(self) -> str:
        at, parts = 0, []
        for first, n in self.segments:
            at += n
            part = f"(shiftrightunsigned(fp, {BITS - first - n}) & {(1 << n) - 1}L)"
            parts.append(f"shiftleft({part}, {BITS - at})")
        return "(" + " | ".join(parts) + ")"

    def undo(self, v: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(v), dtype=np.uint64), 0
        for first, n in self.segments:
            at += n
            out |= ((v >> np.uint64(BITS - at)) & np.uint64((1 << n) - 1)) << np.uint64(BITS - first - n)
        return out


def arrangements(budget: int) -> list[Arrangement]:
    """Arrangements that together meet every pair within the budget."""
    blocks = [(0, 22), (22, 21), (43, 21)]
    top = budget // 3
    made = []
    for k, (first, n) in enumerate(blocks):
        rest = [x for m, x in enumerate(blocks) if m != k]
        m = top + 1
        subs = [(first + n * i // m, n * (i + 1) // m - n * i // m) for i in range(m)]
        for i, sub in enumerate(subs):
            limits = tuple(0 if d <= sub[1] else top if d <= n else budget for d in range(BITS + 1))
            made.append(Arrangement((sub, *(x for j, x in enumerate(subs) if j != i), *rest), sub[1], limits))
    return made


def _expand(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the members of each node pair; within a node each pair once."""
    nb = b1 - b0
    n = (a1 - a0) * nb
    at = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    i, j = a0[at] + k // nb[at], b0[at] + k % nb[at]
    ok = (a0[at] != b0[at]) | (i < j)
    return i[ok], j[ok]


class Forest:
    """Shortest links that join the components found so far."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.change = np.arange(n)  # number of label changes up to each place

    def add(self, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        for step in np.unique(d):
            x, y = i[d == step], j[d == step]
            while len(x):
                a, b = self.label[x], self.label[y]
                open_ = a != b
                if not open_.any():
                    break
                x, y, a, b = x[open_], y[open_], a[open_], b[open_]
                high, at = np.unique(np.maximum(a, b), return_index=True)
                self.links.append((x[at], y[at]))
                up = np.arange(len(self.label))
                up[high] = np.minimum(a, b)[at]
                while (up[up] != up).any():
                    up = up[up]
                self.label = up[self.label]
        self.change = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])]) if len(self.label) else self.label

    def joined(self, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
        """Node pairs whose members all lie in one component."""
        c = self.change
        return (c[a0] == c[a1 - 1]) & (c[b0] == c[b1 - 1]) & (self.label[a0] == self.label[b0])

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate([none, *(x for x, _ in self.links)]), np.concatenate([none, *(y for _, y in self.links)])


def _strips(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The node pairs in runs of about `most` pairs of members; larger ones cut into strips."""
    size = (a1 - a0) * (b1 - b0)
    for k in np.flatnonzero(size > most).tolist():
        step = max(1, most // int(b1[k] - b0[k]))
        for x in range(int(a0[k]), int(a1[k]), step):
            y = min(x + step, int(a1[k]))
            if a0[k] != b0[k]:
                yield np.array([x]), np.array([y]), b0[k : k + 1], b1[k : k + 1]
            else:  # within one node: the strip with itself, and with what follows
                yield np.array([x, x]), np.array([y, y]), np.array([x, y]), np.array([y, int(b1[k])])
    at = np.flatnonzero(size <= most)
    run = np.cumsum(size[at]) // most
    for part in np.split(at, np.flatnonzero(run[1:] != run[:-1]) + 1):
        if len(part):
            yield a0[part], a1[part], b0[part], b1[part]


def trie_walk(values: np.ndarray, starts: list[tuple[int, int, int, int, int]], depth: int, limits: tuple[int, ...], forest: Forest, check: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, chunk: int = 1 << 17, leaf: int = 24, most: int = 1 << 21) -> None:
    """Walk node pairs of the trie over `values` and add links to the forest.

    values: uint64, ascending within each start range; values may repeat.
    starts: node pairs (a0, a1, b0, b1, errors so far) whose members agree above
    `depth` but for those errors. Node pairs of up to `leaf` pairs of members
    are compared outright. check(i, j) tells which pairs within the budget may
    link: only those enter the forest, so a pair that fails joins nothing. Work
    is done in parts of bounded size, deepest first.
    """
    budget = limits[-1]
    ones: dict[int, np.ndarray] = {}
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def below(d: int) -> np.ndarray:
        if d not in ones:
            bit = (values >> np.uint64(BITS - 1 - d)) & np.uint64(1)
            ones[d] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        return ones[d]

    def fold() -> None:
        nonlocal held
        if found:
            forest.add(*(np.concatenate(x) for x in zip(*found, strict=True)))
        found.clear()
        held = 0

    stack = [(depth, np.array(starts, dtype=np.int64))] if starts else []
    while stack:
        d, f = stack.pop()
        if len(f) > chunk:
            stack.append((d, f[chunk:]))
            f = f[:chunk]
        a0, a1, b0, b1, e = f.T
        open_ = ~forest.joined(a0, a1, b0, b1)
        a0, a1, b0, b1, e = a0[open_], a1[open_], b0[open_], b1[open_], e[open_]
        small = ((a1 - a0) * (b1 - b0) <= leaf) | (d >= BITS)
        if small.any():
            for strip in _strips(a0[small], a1[small], b0[small], b1[small], most):
                i, j = _expand(*strip)
                n = np.bitwise_count(values[i] ^ values[j])
                ok = (n <= budget) & (forest.label[i] != forest.label[j])
                i, j, n = i[ok], j[ok], n[ok]
                if check is not None:
                    ok = check(i, j)
                    i, j, n = i[ok], j[ok], n[ok]
                found.append((i, j, n))
                held += len(i)
                if held > 1 << 16:
                    fold()
            go = ~small
            a0, a1, b0, b1, e = a0[go], a1[go], b0[go], b1[go], e[go]
        if not len(a0):
            continue
        c = below(d)
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        other = a0 != b0
        parts = [
            np.stack([a0, am, b0, bm, e]),
            np.stack([am, a1, bm, b1, e]),
            np.stack([a0, am, bm, b1, e + 1]),
            np.stack([am, a1, b0, bm, e + 1])[:, other],
        ]
        nxt = np.concatenate(parts, axis=1)
        nxt = nxt[:, (nxt[1] > nxt[0]) & (nxt[3] > nxt[2]) & (nxt[4] <= limits[d + 1])]
        nxt = nxt[:, (nxt[0] != nxt[2]) | (nxt[1] - nxt[0] > 1)]
        if nxt.shape[1]:
            stack.append((d + 1, nxt.T))
    fold()


def _walk(plan: list[Arrangement], named: bool, similar: float):
    """Links of each group: between fingerprints, or between the named texts whose sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in split_groups(batches, ["r", "bucket", "na", "nb"]):
            r, bucket, na, nb, node = (t.column(k).to_numpy() for k in ("r", "bucket", "na", "nb", "node"))
            v = t.column("v").to_numpy().view(np.uint64)
            key = np.lexsort((v, node, nb, na, bucket, r))
            r, bucket, na, nb, node, v = r[key], bucket[key], na[key], nb[key], node[key], v[key]
            check = None
            if named:
                sketch = np.stack([t.column(k).to_numpy().view(np.uint64)[key] for k in SKETCH], axis=1)
                check = partial(may_be_similar, sketch, similar=similar)
            new = np.ones(len(v), dtype=bool)
            new[1:] = (r[1:] != r[:-1]) | (bucket[1:] != bucket[:-1]) | (na[1:] != na[:-1]) | (nb[1:] != nb[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(v))
            todo: dict[tuple[int, int], list] = {}
            for a, b in zip(first[last - first > 1].tolist(), last[last - first > 1].tolist(), strict=True):
                k, x, y = int(r[a]), int(na[a]), int(nb[a])
                if x == y:
                    todo.setdefault((k, plan[k].exact + (SPLIT_BITS if x >= 0 else 0)), []).append((a, b, a, b, 0))
                else:
                    m = a + int(np.searchsorted(node[a:b], x, side="right"))
                    if a < m < b:
                        todo.setdefault((k, plan[k].exact + SPLIT_BITS), []).append((a, m, m, b, (x ^ y).bit_count()))
            forest = Forest(len(v))
            for (k, depth), starts in todo.items():
                trie_walk(v, starts, depth, plan[k].limits, forest, check)
            i, j = forest.edges()
            if named:
                c = t.column("c").to_numpy()[key]
                yield pa.RecordBatch.from_arrays([pa.array(c[i]), pa.array(c[j])], names=["u", "v"])
                continue
            plain = np.zeros(len(v), dtype=np.uint64)
            for k, arranged in enumerate(plan):
                at = np.flatnonzero(r == k)
                plain[at] = arranged.undo(v[at])
            yield pa.RecordBatch.from_arrays([pa.array(plain[i].view(np.int64)), pa.array(plain[j].view(np.int64))], names=["u", "v"])

    return run


def trie_links(fps: DataFrame, budget: int = 2, hot: int = HOT, similar: float | None = None) -> DataFrame:
    """Distinct fingerprints (fp long) -> links (u, v) of at most `budget` bits that
    join all that such links join: the shortest ones found in each group.

    With `similar`, rows are texts (fp, c long, and the words of SKETCH), links
    are between their c, and texts link only if their sketches allow the similarity.
    """
    plan = arrangements(budget)
    own = [] if similar is None else ["c", *SKETCH]

    def text(values: list) -> str:
        return f"array({', '.join(map(str, values))})"

    roots = [f"named_struct('r', {k}, 'bucket', shiftrightunsigned({x.sql()}, {BITS - x.exact}), 'v', {x.sql()})" for k, x in enumerate(plan)]
    nodes = fps.select(*own, F.explode(F.expr(text(roots))).alias("x")).select("x.*", *own)
    crowd = nodes.groupBy("r", "bucket").count().filter(F.col("count") > 1)
    nodes = nodes.join(crowd, ["r", "bucket"])
    cut = F.expr(f"cast(shiftrightunsigned(v, {BITS - SPLIT_BITS} - element_at({text([x.exact for x in plan])}, r + 1)) & {2**SPLIT_BITS - 1} as int)")
    most = max(x.limits[x.exact + SPLIT_BITS] for x in plan)
    masks = [sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(SPLIT_BITS), n)]
    around = F.transform(F.array(*map(F.lit, masks)), lambda m: F.struct(F.least(cut, cut.bitwiseXOR(m)).alias("na"), F.greatest(cut, cut.bitwiseXOR(m)).alias("nb")))
    whole = F.array(F.struct(F.lit(-1).alias("na"), F.lit(-1).alias("nb")))
    nodes = nodes.select("r", "bucket", "v", cut.alias("node"), *own, F.explode(F.when(F.col("count") > hot, around).otherwise(whole)).alias("x")).select("r", "bucket", "x.na", "x.nb", "node", "v", *own)
    dealt = nodes.repartition("r", "bucket", "na", "nb").sortWithinPartitions("r", "bucket", "na", "nb")
    return map_arrow(dealt, _walk(plan, similar is not None, similar or 0.0), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, seed: int = 42, budget: int = 2, hot: int = HOT) -> DataFrame:
    """One row per input row: (id, fp, component_id).

    component_id is the smallest id reachable over links of at most `budget`
    differing bits. Null, empty and wordless texts have fingerprint 0 and link
    like any other. Rows with a null id keep their row; they never are a
    component_id unless a component has no other id. Repeated rows each return.
    Other columns are ignored, whatever their names.
    """
    sigs = checkpoint(fingerprints(docs, id_col, text_col, k, seed))
    uniq = checkpoint(sigs.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(trie_links(uniq.select("fp"), budget, hot))
    named = uniq.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = checkpoint(named.groupBy("root").agg(F.min("least").alias("component_id")))
    where = named.join(least, "root").select("fp", "component_id")
    return sigs.join(where, "fp", "left").select("id", "fp", "component_id")


#: Near copies: five-word shingles, this similarity; bits by which word-set fingerprints of such texts may differ.
SHINGLE = 5
SIMILAR = 0.8
COPY_BUDGET = 8
#: Texts, and shingles, of a component that are compared as one block, with themselves or with another block.
COPY_BLOCK = 1024
COPY_SHINGLES = 1 << 20
#: Texts of so many shingles or fewer are met by their first shingles, not by fingerprint, whose bits say little of short texts.
SHORT = 96
#: Words of a sketch: 64 bins of four bits.
SKETCH = ("s0", "s1", "s2", "s3")
#: Standard errors by which a sketch may fall short of the similarity: about one pair in 30,000 falls shorter.
SLACK = 4.0
_MUL = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0x1111111111111111)
_BINS = np.arange(64, dtype=np.int64) << np.int64(57)


def _shingles(h: np.ndarray, k: int) -> np.ndarray:
    """From the hashes of a text's words: those of its shingles, ascending, each once."""
    n = min(k, len(h))
    s = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        s = (s ^ h[i : i + len(s)]) * _MUL
        s ^= s >> np.uint64(31)
    return np.unique(s >> np.uint64(1)).view(np.int64)


def _word_hashes(text: bytes | None) -> tuple[list[bytes], np.ndarray]:
    words = text.lower().split() if text else []
    return words, np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def shingles(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Hashes of all shingles of the whole text, ascending, each once."""
    _, h = _word_hashes(text)
    return _shingles(h, k) if len(h) else np.zeros(0, dtype=np.int64)


def sketch_of(s: np.ndarray) -> np.ndarray:
    """Four words: for each of 64 bins four bits of its least shingle hash, 0 for an empty bin."""
    at = np.searchsorted(s, _BINS)
    least = s[np.minimum(at, len(s) - 1)] if len(s) else np.full(64, -1)
    here = (at < len(s)) & (least >> np.int64(57) == np.arange(64))
    bits = np.where(here, 1 + (least % 1_000_003) % 15, 0).astype(np.uint64).reshape(4, 16)
    return (bits << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)


def _nibbles(x: np.ndarray) -> np.ndarray:
    """How many groups of four bits are not zero."""
    x = x | (x >> np.uint64(2))
    return np.bitwise_count((x | (x >> np.uint64(1))) & _LOW).sum(axis=1).astype(np.int64)


def may_be_similar(sketch: np.ndarray, i: np.ndarray, j: np.ndarray, similar: float) -> np.ndarray:
    """Whether the sketches of each pair are as alike as texts of that similarity are, but for SLACK."""
    a, b = sketch[i], sketch[j]
    used = _nibbles(a | b)
    return used - _nibbles(a ^ b) >= similar * used - SLACK * np.sqrt(similar * (1 - similar) * used)


def first_shingles(s: np.ndarray, similar: float) -> np.ndarray:
    """Just so many of the least hashes that sets of this similarity share one of them: one more than either can lack of the other."""
    return s[: len(s) - math.ceil(similar * len(s) - 1e-9) + 1] if 0 < len(s) <= SHORT else s[:0]


def text_print(text: bytes | None, similar: float = SIMILAR) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    """(fingerprint of the set of words, hash of the word sequence, number of shingles, sketch of the shingles, first shingles of a short text)."""
    words, h = _word_hashes(text)
    if not words:
        return 0, 0, 0, np.zeros(4, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    one = np.unique(h)
    seen = np.bincount((one.view(np.uint8).reshape(-1, 8) + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    fp = int.from_bytes(np.packbits((seen * 2 > len(one)).ravel(), bitorder="little").tobytes(), "little")
    s = _shingles(h, SHINGLE)
    return fp, xxhash.xxh64_intdigest(b" ".join(words)), len(s), sketch_of(s), first_shingles(s, similar)


def similar_pairs(fp: np.ndarray, sets: list[np.ndarray], left: int, budget: int, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within `budget` bits whose sets have the similarity, as many as join all
    that such pairs join: of one of the first `left` members with one of the others,
    or of any two if `left` is their number. A member meets one of each group that is
    joined already, and the rest of the group only where that one does not pass."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    _, flat = np.unique(flat, return_inverse=True)
    start = np.cumsum(size) - size
    mark = np.zeros(int(flat.max()) + 1 if len(flat) else 0, dtype=np.int64)
    us, vs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    cross = left < len(sets)
    label = np.arange(len(sets))

    def passing(i: int, j: np.ndarray) -> np.ndarray:
        n = size[j]
        at = np.repeat(start[j] - np.cumsum(n) + n, n) + np.arange(n.sum())
        # no set is empty: texts without words are one text
        both = np.add.reduceat(mark[flat[at]], np.cumsum(n) - n)
        return j[both >= similar * (size[i] + n - both)]

    for i in range(left):
        j = np.arange(left if cross else i + 1, len(sets))
        j = j[np.bitwise_count(fp[j] ^ fp[i]) <= budget]
        j = j[(size[j] >= similar * size[i]) & (size[i] >= similar * size[j])]
        mine = flat[start[i] : start[i] + size[i]]
        mark[mine] = 1
        for step in (0, 1):
            j = j[label[j] != label[i]]
            if not len(j):
                break
            head = np.unique(label[j], return_index=True)[1] if step == 0 else np.arange(len(j))
            got = passing(i, j[head])
            if len(got):
                us.append(np.full(len(got), i))
                vs.append(got)
                label[np.isin(label, label[got])] = label[i]
            if step == 0:
                j = np.delete(j, head)
        mark[mine] = 0
    return np.concatenate(us), np.concatenate(vs)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = COPY_BUDGET, similar: float = SIMILAR, hot: int = HOT, block: int = COPY_BLOCK, weight: int = COPY_SHINGLES) -> DataFrame:
    """One row per input row: (id, component_id) of texts joined by near-copy links.

    Two different texts link if the sets of their five-word shingles (texts of
    fewer words: one shingle) have the similarity, exactly and over the whole
    texts, and either both have SHORT shingles or fewer, or the fingerprints of
    their word sets are within `budget` bits. Short texts that are similar share
    one of their first shingles, by hash, so none of their links is missed. For
    the others the trie join gives candidate components: its links are pairs
    within the budget whose sketches allow the similarity, so texts that only look
    alike by their fingerprints are not chained. Every link lies in a component,
    or with a first shingle, and each
    text of one is compared with each other one, block against block, dealt to
    tasks; blocks have a bounded number of texts and of shingles. Shingles are
    made again in a second pass, of one row of each text in a component of
    several. Texts without words are all alike; repeated texts and very long ones
    need nothing of their own. component_id is the smallest id of the component;
    null ids and repeated rows as in near_duplicates. Columns other than the two
    are ignored, whatever their names; an empty table gives an empty result.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [text_print(t, similar) for t in b.column(2).to_pylist()]
            fp, c = (pa.array(np.array([g[k] for g in got], dtype=np.uint64).view(np.int64)) for k in (0, 1))
            sketch = np.array([g[3] for g in got], dtype=np.uint64).reshape(-1, 4).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp, c, pa.array([g[2] for g in got], pa.int64()), *map(pa.array, sketch.T.copy()), pa.array([g[4] for g in got], pa.list_(pa.int64()))], names=["id", "row", "fp", "c", "n", *SKETCH, "first"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=["c", "s"])

    # `row` finds a row again: its key is crowded only where whole rows repeat
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("row"), F.col(text_col).cast("binary").alias("t"))
    sigs = checkpoint(map_arrow(src, prints, "id long, row long, fp long, c long, n long, " + ", ".join(f"{k} long" for k in SKETCH) + ", first array<long>"))
    classes = checkpoint(sigs.groupBy("c", "fp", "n", *SKETCH).agg(F.min("id").alias("least"), F.min("row").alias("row"), F.min("first").alias("first")))
    crowds = connected_components(trie_links(classes.select("fp", "c", *SKETCH), budget, hot, similar)).withColumnRenamed("node", "c")
    placed = classes.join(crowds, "c").select("row", "c", "fp", "n", "root", F.lit(False).alias("short"))
    placed = placed.unionByName(classes.select("row", "c", "fp", "n", F.explode("first").alias("root"), F.lit(True).alias("short")))
    # small aggregates are checkpointed: a crowd of very many texts is then split in the join
    crowd = checkpoint(placed.groupBy("short", "root").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / weight)).cast("int").alias("parts"), F.count("*").alias("texts")).filter("texts > 1").drop("texts"))
    members = checkpoint(placed.join(crowd, ["short", "root"]).withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int")))
    known = map_arrow(src.select("row", "t").join(members.select("row", "c").distinct(), "row").select("c", "t"), sets, "c long, s array<long>")
    known = checkpoint(known.groupBy("c").agg(F.first("s").alias("s")))  # whole rows may repeat
    whole = members.join(known, "c").select("short", "root", "parts", "part", "c", "fp", "s")
    sides = whole.select("short", "root", "part", "c", "fp", "s", F.explode(F.expr("sequence(0, parts - 1)")).alias("other"))
    sides = sides.select(F.col("short").cast("int").alias("short"), "root", F.least("part", "other").alias("pa"), F.greatest("part", "other").alias("pb"), "part", "c", "fp", "s").repartition("short", "root", "pa", "pb").sortWithinPartitions("short", "root", "pa", "pb", "part", "c")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in split_groups(batches, ["short", "root", "pa", "pb"], rows=512):
            short, root, first, second, part, c, fp = (t.column(k).to_numpy() for k in ("short", "root", "pa", "pb", "part", "c", "fp"))
            new = np.ones(len(c) + 1, dtype=bool)
            new[1:-1] = (short[1:] != short[:-1]) | (root[1:] != root[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])
            cut = np.flatnonzero(new)
            us, vs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                left = int((part[a:b] == first[a]).sum())
                if first[a] != second[a] and not 0 < left < b - a:
                    continue
                s = t.column("s").slice(a, b - a).combine_chunks()
                at, flat = s.offsets.to_numpy(), s.values.to_numpy()
                i, j = similar_pairs(fp[a:b].view(np.uint64), [flat[p:q] for p, q in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], left, 64 if short[a] else budget, similar)
                label = local_components(b - a, i, j)  # pairs that passed, as a forest
                got = np.flatnonzero(label != np.arange(b - a))
                us.append(c[a:b][got])
                vs.append(c[a:b][label[got]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    roots = connected_components(map_arrow(sides, compare, "u long, v long"))
    named = classes.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    least_id = checkpoint(named.groupBy("root").agg(F.min("least").alias("component_id")))
    where = named.join(least_id, "root").select("c", "component_id")
    return sigs.select("id", "c").join(where, "c", "left").select("id", "component_id")
