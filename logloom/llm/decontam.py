"""Benchmark decontamination by template canonicalisation.

Texts become sequences of canonical tokens: lower-case words, with numbers,
names (capitalised words inside a sentence) and units (unit words after a
number) replaced by typed placeholders that remember their value. Windows of
WIDTH canonical tokens of every document are joined by hash with the windows of
the benchmark. Hits vote for an item and a diagonal; where a band of diagonals
has enough votes, the item's tokens are aligned with the document's inside it.
An item is found where enough of its tokens stand in runs along the alignment,
and where the slots agree: one value of the item always meets one value of the
document, as it does in a verbatim copy and in a question whose parameters were
exchanged throughout. Agreement says nothing where every value of an item stands
once: then words and shape decide, and an unrelated question of the very same
words and shape is found too. Without an ordinary word in the alignment the
values must be those of the item.

Windows that repeat, such as those of a table of numbers, are not paired one by
one: a window with many places on both sides votes by a correlation of its
places, so work grows with the lengths and not with their product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import checkpoint, map_texts

WIDTH = 5
#: Share of an item's tokens that must be found along one alignment, in runs of RUN tokens at least.
COVER = 0.8
RUN = 2
#: Share of an item's windows that a band of diagonals must have to be aligned.
SEED = 0.25
#: Share of an item's repeated slot values that must agree.
AGREE = 0.8
#: Tokens by which an alignment may shift from its main diagonal: words put in or left out.
DRIFT = 8
#: Benchmark windows that are broadcast at once; a larger benchmark takes several rounds.
BLOCK_WINDOWS = 500_000
#: Bits of the filter that a larger benchmark is first met by.
FILTER_BITS = 26

UNITS = frozenset("mm cm m km in ft yd mi mile miles meter meters metre metres mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh kph percent % dollar dollars cent cents euro euros usd eur gbp degree degrees celsius fahrenheit kelvin watt watts kw kwh volt volts amp amps hz khz mhz ghz kb mb gb tb byte bytes bit bits".split())
_TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?\n%]")
_NAME, _NUM, _END, _UNIT = 1, 2, 4, 8
_FLAGS = np.uint64(15)
_KIND_HASH = {k: np.uint64(xxhash.xxh64_intdigest(f"<{k}>") & ~15) for k in ("num", "name", "unit")}
_MUL = np.uint64(0x9E3779B97F4A7C15)


class _Tokens(dict):
    """Token -> hash of its lower-case form with flags in the low four bits; bounded."""

    def __missing__(self, token: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        flags = 0
        if token in ".!?\n":
            flags = _END
        elif token[0].isdigit():
            flags = _NUM
        else:
            low = token.lower()
            if low in UNITS:
                flags |= _UNIT
            if token[0].isupper() and token[1:] == low[1:]:
                flags |= _NAME
        value = (xxhash.xxh64_intdigest(token.lower()) & ~15) | flags
        self[token] = value
        return value


_TOKENS = _Tokens()


@dataclass
class Canonical:
    shape: np.ndarray  # hash of each canonical token
    value: np.ndarray  # hash of each token as written, case aside
    slot: np.ndarray  # whether it is a placeholder
    plain: np.ndarray  # shape with names as words: how a text without capitals has them


def canonical(text: str) -> Canonical:
    found = _TOKEN.findall(text)
    raw = np.fromiter(map(_TOKENS.__getitem__, found), dtype=np.uint64, count=len(found))
    flags = raw & _FLAGS
    value = raw & ~_FLAGS
    end = (flags & np.uint64(_END)) > 0
    num = (flags & np.uint64(_NUM)) > 0
    before_end = np.ones(len(raw), dtype=bool)
    before_end[1:] = end[:-1]
    after_num = np.zeros(len(raw), dtype=bool)
    after_num[1:] = num[:-1]
    name = ((flags & np.uint64(_NAME)) > 0) & ~before_end
    units = ((flags & np.uint64(_UNIT)) > 0) & after_num
    plain = value.copy()
    plain[num] = _KIND_HASH["num"]
    plain[units] = _KIND_HASH["unit"]
    shape = plain.copy()
    shape[name] = _KIND_HASH["name"]
    keep = ~end
    return Canonical(shape[keep], value[keep], (num | name | units)[keep], plain[keep])


def windows(tokens: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window; a sequence shorter than that is one window, an empty one none."""
    n = len(tokens)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    w = min(width, n)
    h = np.full(n - w + 1, w, dtype=np.uint64)
    for k in range(w):
        h = (h ^ tokens[k : k + n - w + 1]) * _MUL
        h ^= h >> np.uint64(31)
    return h


@dataclass
class Benchmark:
    """A bounded block of items, ready to broadcast."""

    ids: list
    items: list[Canonical]
    count: np.ndarray  # windows of each item
    keys: np.ndarray  # window hashes, ascending
    item: np.ndarray
    pos: np.ndarray
    width: int
    length: np.ndarray  # tokens of each item
    short: np.ndarray  # items with fewer than `width` tokens

    @classmethod
    def of(cls, ids: list, texts: list[str], width: int) -> "Benchmark":
        items = [canonical(t) for t in texts]
        hs = [windows(c.shape, width) for c in items]
        plain = [windows(c.plain, width) for c in items]
        keys = np.concatenate([np.zeros(0, dtype=np.uint64), *hs, *plain])
        item = np.tile(np.repeat(np.arange(len(hs)), [len(h) for h in hs]), 2)
        pos = np.tile(np.concatenate([np.zeros(0, dtype=np.int64), *(np.arange(len(h)) for h in hs)]), 2)
        once = np.ones(len(keys), dtype=bool)  # most windows have no name and are the same twice
        once[len(keys) // 2 :] = keys[len(keys) // 2 :] != keys[: len(keys) // 2]
        keys, item, pos = keys[once], item[once], pos[once]
        order = np.argsort(keys, kind="stable")
        return cls(ids, items, np.array([len(h) for h in hs]), keys[order], item[order], pos[order], width, np.array([len(c.shape) for c in items], dtype=np.int64), np.flatnonzero([0 < len(c.shape) < width for c in items]))

    def hits(self, text: str, cover: float, agree: float) -> list[tuple[int, float, int, int]]:
        """(item, share found, first and last token of the alignment) of each item in the text."""
        doc = canonical(text)
        out = []
        for width in {self.width, *(len(self.items[k].shape) for k in self.short)}:
            h, where = document_windows(doc, width)
            if not len(h) or not len(self.keys):
                continue
            lo = np.searchsorted(self.keys, h, side="left")
            hit = np.flatnonzero(self.keys[np.minimum(lo, len(self.keys) - 1)] == h)
            if not len(hit):
                continue
            # each window once, with its places in the document and its entries in the benchmark
            keys, first, of, times = np.unique(h[hit], return_index=True, return_inverse=True, return_counts=True)
            places = where[hit][np.argsort(of, kind="stable")]
            begin = np.cumsum(times) - times
            lo = lo[hit][first]
            n = np.searchsorted(self.keys, keys, side="right") - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            key, item, t = np.repeat(np.arange(len(keys)), n), self.item[at], self.pos[at]
            ok = self.length[item] == width if width < self.width else self.length[item] >= self.width
            order = np.flatnonzero(ok)[np.argsort(item[ok], kind="stable")]
            key, item, t = key[order], item[order], t[order]
            cut = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else []
            for a, b in zip(cut, [*cut[1:], len(item)], strict=True):
                k = int(item[a])
                if b - a < SEED * self.count[k]:
                    continue
                x = key[a:b]
                if width < self.width:
                    p = np.unique(np.concatenate([places[begin[y] : begin[y] + times[y]] for y in x.tolist()]))
                    found = self._short(doc, k, p, agree)
                else:
                    found = self._aligned(doc, k, t[a:b], [places[begin[y] : begin[y] + times[y]] for y in x.tolist()], x, cover, agree)
                if found:
                    out.append(found)
        return out

    def _short(self, doc: Canonical, k: int, p: np.ndarray, agree: float) -> tuple[int, float, int, int] | None:
        """An item shorter than a window, at places where all its tokens stand."""
        c = self.items[k]
        n = len(c.shape)
        same = (doc.value[p[:, None] + np.arange(n)] == c.value).sum(axis=1)
        if c.slot.all():
            good = np.flatnonzero(same >= agree * n)
        else:
            good = np.argsort(-same, kind="stable")
        for x in p[good].tolist():
            if self._consistent(doc, k, np.arange(x, x + n), np.arange(n), agree):
                return k, 1.0, x, x + n - 1
        return None

    def _aligned(self, doc: Canonical, k: int, t: np.ndarray, places: list[np.ndarray], key: np.ndarray, cover: float, agree: float) -> tuple[int, float, int, int] | None:
        """The fullest alignment of those with enough tokens and consistent slots.

        t, places, key: a window of the item, where it stands in the document, and
        a number for its hash.
        """
        c = self.items[k]
        n, m = len(c.shape), len(doc.shape)
        bands = []
        if not c.slot.all():
            votes = diagonals(t, places, key, n, m)
            for d in np.flatnonzero(votes >= self.count[k]).tolist() if sum(map(len, places)) <= 4 * (n + m) else []:
                tt = np.arange(n)  # straight and whole
                if 0 <= d - n and d <= m and self._matches(c, doc, tt, tt + d - n).all() and self._consistent(doc, k, tt + d - n, tt, agree):
                    return k, 1.0, d - n, d - 1
            worded = np.lib.stride_tricks.sliding_window_view(~c.slot, self.width).any(axis=1)[t]
            some = np.flatnonzero(worded).tolist()
            by_word = diagonals(t[some], [places[x] for x in some], key[some], n, m)
            bands.append(centres(votes, SEED * self.count[k], by_word))
        if c.slot.mean() >= cover:  # the alignment may be all slots: then values count
            v, of = np.unique(c.value, return_inverse=True)
            at = np.minimum(np.searchsorted(v, doc.value), len(v) - 1)
            held = np.flatnonzero(v[at] == doc.value)
            held = held[np.argsort(at[held], kind="stable")]
            ends = np.searchsorted(at[held], np.arange(len(v) + 1))
            met = np.flatnonzero((ends[1:] > ends[:-1])[of])
            values = diagonals(met, [held[ends[x] : ends[x + 1]] for x in of[met].tolist()], of[met], n, m)
            bands.append(centres(values, agree * cover * n))
        middle = np.concatenate([np.zeros(0, dtype=np.int64), *bands]) - n
        middle = middle[np.sort(np.unique(middle, return_index=True)[1])]
        best, done, step = None, 0, 4
        while done < len(middle) and (best is None or best[1] < 1.0):  # the fullest bands first
            part = middle[done : done + step]
            done, step = done + step, min(512, 4 * step)
            score = self._align(c, doc, part)[-1].max(axis=1)
            for x in np.argsort(-score, kind="stable").tolist():
                if score[x] // 1000 < cover * n or (best is not None and score[x] // 1000 <= best[1] * n):
                    break
                tt, pp = self._path(c, doc, int(part[x]))
                run = np.cumsum(np.append(True, (tt[1:] != tt[:-1] + 1) | (pp[1:] != pp[:-1] + 1)))[: len(tt)]
                long = np.bincount(run)[run] >= min(RUN, n)
                tt, pp = tt[long], pp[long]
                share = len(tt) / n
                if share >= cover and (best is None or share > best[1]) and self._consistent(doc, k, pp, tt, agree):
                    best = (k, share, int(pp[0]), int(pp[-1]))
        return best

    @staticmethod
    def _matches(c: Canonical, doc: Canonical, t: np.ndarray, p: np.ndarray) -> np.ndarray:
        return (c.shape[t] == doc.shape[p]) | (c.plain[t] == doc.plain[p])

    def _align(self, c: Canonical, doc: Canonical, middle: np.ndarray, whole: bool = False) -> list[np.ndarray]:
        """Scores of the longest common subsequence inside each band: 1000 for a token,
        1 more if as written. The last row, or all rows."""
        wide = DRIFT + DRIFT // 2
        off = middle[:, None] + np.arange(-wide, wide + 1)
        row = np.zeros(off.shape, dtype=np.int64)
        rows = [row]
        m = len(doc.shape)
        for t in range(len(c.shape)):
            p = off + t
            inside = (p >= 0) & (p < m)
            p = np.clip(p, 0, m - 1)
            hit = inside & ((doc.shape[p] == c.shape[t]) | (doc.plain[p] == c.plain[t]))
            nxt = row + np.where(hit, 1000 + (doc.value[p] == c.value[t]), 0)
            nxt[:, :-1] = np.maximum(nxt[:, :-1], row[:, 1:])
            row = np.maximum.accumulate(nxt, axis=1)
            if whole:
                rows.append(row)
        return rows if whole else [row]

    def _path(self, c: Canonical, doc: Canonical, middle: int) -> tuple[np.ndarray, np.ndarray]:
        """(places in the item, places in the document) of the best alignment of one band."""
        rows = self._align(c, doc, np.array([middle]), whole=True)
        wide, m = DRIFT + DRIFT // 2, len(doc.shape)
        t, o = len(c.shape), 2 * wide
        o = int(np.argmax(rows[t][0] == rows[t][0].max()))
        tt, pp = [], []
        while t > 0 and rows[t][0, o] > 0:
            here, p = rows[t][0, o], middle + o - wide + t - 1
            if o and rows[t][0, o - 1] == here:
                o -= 1
                continue
            if 0 <= p < m and (doc.shape[p] == c.shape[t - 1] or doc.plain[p] == c.plain[t - 1]) and rows[t - 1][0, o] + 1000 + int(doc.value[p] == c.value[t - 1]) == here:
                tt.append(t - 1)
                pp.append(p)
                t -= 1
            else:
                if not (rows[t - 1][0, o] == here):
                    o += 1
                t -= 1
        return np.array(tt[::-1], dtype=np.int64), np.array(pp[::-1], dtype=np.int64)

    def _consistent(self, doc: Canonical, k: int, pp: np.ndarray, tt: np.ndarray, agree: float) -> bool:
        """Whether each slot value of the item meets one value of the document.

        One place of the item meets one of the document. Without an ordinary word
        any numbers or names would fit: then the values must be those of the item.
        """
        c = self.items[k]
        same = c.value[tt] == doc.value[pp]
        if same.all():
            return True
        s = c.slot[tt]
        if s.all():
            return same.sum() >= agree * len(tt)
        theirs, ours = c.value[tt[s]], doc.value[pp[s]]
        _, theirs = np.unique(theirs, return_inverse=True)
        _, ours = np.unique(ours, return_inverse=True)
        pair, n = np.unique(theirs.astype(np.int64) << 32 | ours, return_counts=True)
        good = np.zeros(len(theirs), dtype=np.int64)  # most frequent partner of each value
        np.maximum.at(good, pair >> 32, n)
        return good.sum() >= agree * len(theirs)


def document_windows(doc: Canonical, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of a document's windows, with names as placeholders and as words."""
    if width > len(doc.shape):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    h = windows(doc.shape, width)
    where = np.arange(len(h))
    if (doc.plain != doc.shape).any():
        other = windows(doc.plain, width)
        new = np.flatnonzero(other != h)
        h, where = np.concatenate([h, other[new]]), np.concatenate([where, new])
    return h, where


def diagonals(t: np.ndarray, places: list[np.ndarray], key: np.ndarray, n: int, m: int) -> np.ndarray:
    """Votes for each diagonal, place in the document less place in the item, plus n.

    t[i] is a place in the item of the key key[i], places[i] its places in the
    document. A key with many places on both sides is counted by a correlation.
    """
    votes = np.zeros(n + m + 1, dtype=np.int64)
    if not len(t):
        return votes
    many = np.array([len(p) for p in places])
    pairs = np.zeros(int(key.max()) + 1, dtype=np.int64)
    np.add.at(pairs, key, many)
    hot = pairs > 32 * (n + m)
    few = np.flatnonzero(~hot[key])
    if len(few):
        step = np.repeat(t[few], many[few])
        votes += np.bincount(np.concatenate([places[x] for x in few.tolist()]) - step + n, minlength=n + m + 1)
    for y in np.flatnonzero(hot).tolist():
        own = np.flatnonzero(key == y)
        size = 1 << (n + m + 1).bit_length()
        a, b = np.zeros(size), np.zeros(size)
        a[places[own[0]]] = 1
        np.add.at(b, n - t[own], 1)
        votes += np.rint(np.fft.irfft(np.fft.rfft(a) * np.fft.rfft(b), size)).astype(np.int64)[: n + m + 1]
    return votes


def centres(votes: np.ndarray, need: float, also: np.ndarray | None = None) -> np.ndarray:
    """Diagonals around which bands with enough votes lie, the fullest first, none
    within half of DRIFT of a fuller one."""
    def band(v: np.ndarray) -> np.ndarray:
        wide = DRIFT + DRIFT // 2
        total = np.concatenate([[0], np.cumsum(v)])
        at = np.arange(len(v))
        return total[np.minimum(at + wide + 1, len(v))] - total[np.maximum(at - wide, 0)]

    ok = (band(votes) >= need) & (votes > 0)
    if also is not None:
        ok &= band(also) > 0
    left = np.flatnonzero(ok)
    left = left[np.argsort(-votes[left], kind="stable")]
    taken = np.zeros(len(votes), dtype=bool)
    out = []
    for d in left.tolist():
        if not taken[d]:
            out.append(d)
            taken[max(0, d - DRIFT // 2) : d + DRIFT // 2 + 1] = True
    return np.array(out, dtype=np.int64)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, width: int, limit: int) -> Iterator[Benchmark]:
    """The benchmark in blocks of bounded size, read row by row."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).filter("t is not null").distinct()
    for r in rows.toLocalIterator():
        n = len(r["t"]) // 2 + 1  # tokens, and so windows, at most
        if ids and size + n > limit:
            yield Benchmark.of(ids, texts, width)
            ids, texts, size = [], [], 0
        ids.append(r["i"])
        texts.append(r["t"])
        size += n
    if ids:
        yield Benchmark.of(ids, texts, width)


class Filter:
    """Which windows a benchmark of any size may hold: hashed bits of bounded number."""

    def __init__(self, width: int) -> None:
        self.bits = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
        self.widths = {width}

    def add(self, block: Benchmark) -> None:
        h = block.keys >> np.uint64(64 - FILTER_BITS)
        np.bitwise_or.at(self.bits, (h >> np.uint64(3)).astype(np.int64), (1 << (h & np.uint64(7))).astype(np.uint8))
        self.widths |= {len(block.items[k].shape) for k in block.short}

    def meets(self, text: str) -> bool:
        doc = canonical(text)
        for width in self.widths:
            h = document_windows(doc, width)[0] >> np.uint64(64 - FILTER_BITS)
            if (self.bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & 1).any():
                return True
        return False


def flag(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", columns: list[str] | None = None, width: int = WIDTH, cover: float = COVER, agree: float = AGREE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs (all columns, or those named) with bench_items, bench_share and contaminated.

    bench_items holds the ids of the items found in the row's text, ascending;
    bench_share the largest share of an item's windows found along one alignment
    (0 if no item is found). Null, empty and wordless texts, on either side,
    contain nothing; items shorter than a window are one window. Items whose id
    is null mark a document without being listed. Whole texts are read, very long
    and repetitive ones too. A benchmark of one block takes one pass. A larger one
    takes a pass that sets aside the documents without any of its windows, by a
    filter of bounded size; the others are checkpointed and meet block after
    block, so that one block at a time is in memory. Repeated rows each return;
    an empty table stays empty; columns named like the new ones are replaced.
    """
    new = ["bench_items", "bench_share"]
    taken = {*new, "contaminated"}
    kept = [c for c in (docs.columns if columns is None else columns) if c.lower() not in taken]
    sc = docs.sparkSession.sparkContext
    out = docs.select(F.col(f"`{text_col}`").cast("string").alias("__body"), *[F.col(f"`{c}`") for c in kept], F.array().cast("array<long>").alias("__items"), F.lit(0.0).alias("__share"))
    settled = None
    if len(list(islice(_blocks(benchmark, item_col, item_text_col, width, block_windows), 2))) > 1:
        known = Filter(width)
        for block in _blocks(benchmark, item_col, item_text_col, width, block_windows):
            known.add(block)
        sent = sc.broadcast(known)
        out = checkpoint(map_texts(out.withColumn("__text", F.col("__body")), "__text", [("__met", "boolean", pa.bool_())], lambda texts: [[bool(x) and sent.value.meets(x) for x in texts]], [c for c in out.columns]))
        settled, out = out.filter("not __met").drop("__met"), out.filter("__met").drop("__met")
    for k, block in enumerate(_blocks(benchmark, item_col, item_text_col, width, block_windows)):
        shared = sc.broadcast(block)

        def score(texts: list, shared=shared) -> list[list]:
            items, share = [], []
            for text in texts:
                got = shared.value.hits(text, cover, agree) if text else []
                items.append(sorted({shared.value.ids[i] for i, *_ in got if shared.value.ids[i] is not None}))
                share.append(max((s for _, s, *_ in got), default=0.0))
            return [items, share]

        if k:
            out = checkpoint(out)
        out = map_texts(out, "__body", [(new[0], "array<long>", pa.list_(pa.int64())), (new[1], "double", pa.float64())], score)
        joined = F.array_sort(F.array_distinct(F.concat("__items", new[0])))
        out = out.select("__body", *[F.col(f"`{c}`") for c in kept], joined.alias("__items"), F.greatest("__share", new[1]).alias("__share"))
    if settled is not None:
        out = out.unionByName(settled)
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col("__items").alias(new[0]), F.col("__share").alias(new[1]), (F.col("__share") > 0).alias("contaminated"))
