"""Packing token sequences into fixed windows by swap-based local search.

A document is its token ids and an end id. One longer than the window is cut;
its last pieces are full, only the first may be shorter. Full pieces are
sequences of their own. The rest, which only differ by length here, are dealt
by a hash into groups of about GROUP pieces. In a group, best fit in descending
length gives a start; then underfull bins trade: one item moves, one is
exchanged for one, or two for one, wherever that raises the sum of squared
fills, so that fill drains from the emptiest bins until they are empty. Bins
are indexed by room and by what they hold, so the receiver of a trade is the
best of all bins, not of a few. The search ends where no trade is left, where
the bins are as few as the tokens allow, or after EFFORT trades a bin.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import checkpoint, map_arrow, split_groups

WINDOW = 2048
END_ID = 0
#: Pieces packed together by one task.
GROUP = 60_000
#: Trades for each underfull bin after which the search ends, with trades left or not.
EFFORT = 20


class Encoder:
    """Ids of the byte-level BPE vocabulary files; made once in each worker process."""

    _made: dict[str, "Encoder"] = {}

    def __init__(self, json_path: str, ranks_path: str | None) -> None:
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def get(cls, json_path: str, ranks_path: str | None) -> "Encoder":
        key = f"{json_path}|{ranks_path}"
        if key not in cls._made:
            cls._made[key] = cls(json_path, ranks_path)
        return cls._made[key]

    def ids(self, text: str) -> np.ndarray:
        """The rank file holds the same vocabulary and is faster. Texts beyond Latin-1,
        where two regex engines could tell letters apart, and those with the string of
        a special token, which has an id of its own, take the tokenizer's file."""
        if self.fast is not None and not any(x in text for x in self.special):
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def vocabulary(json_path: str | None = None, ranks_path: str | None = None) -> tuple[str, str | None]:
    """Paths of the vocabulary files; both default to the public 50k byte-level BPE."""
    if json_path:
        return json_path, ranks_path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut(n: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens."""
    first = n % window or min(n, window)
    at = [0, *range(first, n, window)]
    return [(a, (first if a == 0 else window)) for a in at]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, json_path: str | None = None, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(id, row, piece, start, length, crc, [ids]): the cut token sequences of all rows.

    A null or empty text is the end id alone. row tells rows with equal ids
    apart, repeated rows too. crc is that of the ids as little-endian unsigned
    32-bit integers. Other columns are ignored, whatever their names; an empty
    table has no pieces.
    """
    paths = vocabulary(json_path, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.get(*paths)
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for id_, row, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.append(enc.ids(text) if text else np.zeros(0, dtype="<u4"), np.array([END_ID], dtype="<u4"))
                for k, (a, n) in enumerate(cut(len(ids), window)):
                    part = ids[a : a + n]
                    for col, v in zip(out, (id_, row, k, a, n, zlib.crc32(part.tobytes()), part if with_ids else None), strict=True):
                        col.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            m = 7 if with_ids else 6
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out[:m], kinds[:m], strict=True)], names=["id", "row", "piece", "start", "length", "crc", "ids"][:m])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(src, run, "id long, row long, piece int, start long, length long, crc long" + (", ids array<long>" if with_ids else ""))


def best_fit(lengths: np.ndarray, window: int) -> np.ndarray:
    """A bin number for each item: longest first, into the fullest bin with room."""
    order = np.argsort(-lengths, kind="stable")
    room: list[list[int]] = [[] for _ in range(window + 1)]
    have = 0  # bit g is set if some bin has room g
    bin_of = np.zeros(len(lengths), dtype=np.int64)
    n = 0
    for k, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = have >> size
        if fits:
            g = size + (fits & -fits).bit_length() - 1
            b = room[g].pop()
            if not room[g]:
                have &= ~(1 << g)
            g -= size
        else:
            b, g = n, window - size
            n += 1
        if g:
            room[g].append(b)
            have |= 1 << g
        bin_of[k] = b
    return bin_of


class _Bins:
    """Underfull bins, found by room, and by room and the length of an item or of two items they hold.

    Rooms are bits of an integer, so the least room that suffices is one shift away.
    """

    def __init__(self, lengths: np.ndarray, bin_of: np.ndarray, window: int) -> None:
        self.size, self.window = lengths.tolist(), window
        self.items: dict[int, list[int]] = {}
        fill = np.bincount(bin_of, weights=lengths).astype(np.int64)
        self.room: dict[int, int] = {}
        self.bins: dict[tuple[int, int, int], dict[int, None]] = {}  # (items, their length, room) -> bins
        self.rooms: dict[tuple[int, int], int] = {}  # (items, their length) -> rooms, as bits
        for k, b in enumerate(bin_of.tolist()):
            if fill[b] < window:
                self.items.setdefault(b, []).append(k)
        for b in self.items:
            self.room[b] = window - int(fill[b])
            self.enter(b)

    def _held(self, b: int) -> Iterator[tuple[int, int]]:
        count: dict[int, int] = {}
        for k in self.items[b]:
            count[self.size[k]] = count.get(self.size[k], 0) + 1
        yield 0, 0
        held = sorted(count)
        for x in held:
            yield 1, x
        yield from ((2, n) for n in {x + y for i, x in enumerate(held) for y in held[i:] if x != y or count[x] > 1})

    def enter(self, b: int) -> None:
        r = self.room[b]
        for kind in self._held(b):
            self.bins.setdefault((*kind, r), {})[b] = None
            self.rooms[kind] = self.rooms.get(kind, 0) | 1 << r

    def leave(self, b: int) -> None:
        r = self.room[b]
        for kind in self._held(b):
            same = self.bins[(*kind, r)]
            del same[b]
            if not same:
                del self.bins[(*kind, r)]
                self.rooms[kind] &= ~(1 << r)
                if not self.rooms[kind]:
                    del self.rooms[kind]

    def least(self, items: int, length: int, need: int, not_bin: int) -> tuple[int, int] | None:
        """(room, bin) of the fullest bin with such items and the room."""
        bits = self.rooms.get((items, length), 0) >> need
        at = need
        while bits:
            at += (bits & -bits).bit_length() - 1
            bits = self.rooms[items, length] >> at
            for b in self.bins[items, length, at]:
                if b != not_bin:
                    return at, b
            bits >>= 1
            at += 1
        return None

    def pick(self, b: int, items: int, length: int) -> list[int]:
        """Items of the bin, one or two, of that length together."""
        if items == 0:
            return []
        by = {}
        for k in self.items[b]:
            if items == 1 and self.size[k] == length:
                return [k]
            if items == 2 and length - self.size[k] in by:
                return [by[length - self.size[k]], k]
            by[self.size[k]] = k
        raise AssertionError("the index names a bin without such items")


def local_search(lengths: np.ndarray, bin_of: np.ndarray, window: int, effort: int = EFFORT) -> np.ndarray:
    """Trade between underfull bins while a trade raises the sum of squared fills.

    The emptiest bins give: an item moves to another bin, or is exchanged for a
    shorter one, or for two that together are shorter. The receiver is the bin
    that the trade fills most, of all bins. A receiver ends with more than the
    giver had, so each trade raises the sum of squares, and a giver that runs
    empty is a bin saved. Givers are looked at in rounds, until a round has no
    trade. No fewer bins than the tokens need ends the search at once, and so do
    `effort` trades for each underfull bin.
    """
    fewest = -(-int(lengths.sum()) // window)
    used = len(np.unique(bin_of))
    if used <= fewest:
        return bin_of
    s = _Bins(lengths, bin_of, window)
    left = effort * len(s.room)

    def trade(g: int) -> bool:
        fill = window - s.room[g]
        best = None  # (room left at the receiver, items that come back, their length, receiver, item)
        for size, k in sorted({s.size[k]: k for k in s.items[g]}.items(), reverse=True):
            for items, back in [(0, 0), *(kind for kind in s.rooms if kind[0] and kind[1] < size)]:
                gain = size - back
                got = s.least(items, back, gain, g)
                if got and window - got[0] + gain > fill and (best is None or got[0] - gain < best[0]):
                    best = (got[0] - gain, items, back, got[1], k)
                    if best[0] == 0:
                        break
            if best and best[0] == 0:
                break
        if best is None:
            return False
        _, items, back, b, k = best
        s.leave(g)
        s.leave(b)
        home = s.pick(b, items, back)
        s.items[b] = [x for x in s.items[b] if x not in home] + [k]
        s.items[g] = [x for x in s.items[g] if x != k] + home
        s.room[b] -= s.size[k] - back
        s.room[g] += s.size[k] - back
        for x in (g, b):
            for j in s.items[x]:
                bin_of[j] = x
            if s.items[x] and s.room[x]:
                s.enter(x)
            else:  # empty, or full: it trades no more
                del s.room[x], s.items[x]
        return True

    progress = True
    while progress and left > 0 and used > fewest:
        progress = False
        givers = [(-r, b) for b, r in s.room.items()]
        heapq.heapify(givers)
        while givers and left > 0 and used > fewest:
            r, g = heapq.heappop(givers)
            if s.room.get(g) != -r:
                continue
            if trade(g):
                progress = True
                left -= 1
                if g in s.room:
                    heapq.heappush(givers, (-s.room[g], g))
                else:
                    used -= 1
    return bin_of


def assign(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; bins are numbered from 0 without gaps."""
    bin_of = local_search(lengths, best_fit(lengths, window), window)
    _, bin_of = np.unique(bin_of, return_inverse=True)
    order = np.argsort(bin_of, kind="stable")
    end = np.cumsum(lengths[order])
    base = np.zeros(bin_of.max() + 1 if len(bin_of) else 0, dtype=np.int64)
    first = np.ones(len(order), dtype=bool)
    first[1:] = bin_of[order][1:] != bin_of[order][:-1]
    base[bin_of[order][first]] = (end - lengths[order])[first]
    offset = np.empty(len(order), dtype=np.int64)
    offset[order] = end - lengths[order] - base[bin_of[order]]
    return bin_of, offset


def pack(parts: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """pieces() rows with sequence_id and offset.

    Every piece is placed once. sequence_id is unique over the result; equal
    input gives equal numbers only for equal partitioning. Groups hold about
    `group` pieces, so a task's memory does not grow with the table; each group
    may leave one bin underfull.
    """
    parts = checkpoint(parts)
    n = parts.filter(F.col("length") < window).count()
    groups = max(1, -(-n // group))
    full = parts.filter(F.col("length") >= window).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = parts.filter(F.col("length") < window).select(F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).cast("int").alias("g"), *parts.columns)
    rest = rest.repartition("g").sortWithinPartitions("g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in split_groups(batches, ["g"]):
            gs = t.column("g").to_numpy()
            length = t.column("length").to_numpy()
            seq, off = np.zeros(len(gs), dtype=np.int64), np.zeros(len(gs), dtype=np.int64)
            for g in np.unique(gs):
                at = np.flatnonzero(gs == g)
                b, o = assign(length[at], window)
                seq[at], off[at] = (int(g) << 32) + b, o
            out = t.drop_columns(["g"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))
            yield from out.to_batches()

    fields = ", ".join(f"`{c}` {k}" for c, k in parts.dtypes)
    packed = map_arrow(rest, run, f"{fields}, sequence_id long, offset long")
    return packed.unionByName(full.select(packed.columns))
