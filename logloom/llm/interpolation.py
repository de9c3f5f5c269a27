"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of all orders are mixed, each order's with what the
lower ones say, by weights that depend on how often its context was seen. The
weights come from a part of the training texts that is deleted from the counts:
expectation-maximisation makes that part likeliest. Afterwards counts are those
of all training texts.

Counting and looking up go by key, the 62-bit hash of an n-gram and its order.
Texts are gathered in chunks of a bounded number of tokens. A chunk asks for each
of its different keys once, adding how often its own texts hold it; keys are dealt
to buckets by their first bits, so that a bucket holds a bounded number of
different keys in expectation, and a frequent n-gram one row's entry for a chunk.
Each bucket sums up, and answers every chunk; the answers meet their chunk's
tokens again, and nothing else is joined. Keys of words have 62 bits, which hold
10^8 words apart but for a chance of a few in a thousand that any two meet. Those
of longer n-grams have as many bits as the texts' n-grams can be counted with and
20 more, 62 at most: one n-gram in a million shares its key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import map_arrow, written

ORDER = 3
#: Tokens of a chunk, unless one text has more; bounds a task's memory.
CHUNK_TOKENS = 1 << 20
#: Keys asked for in a bucket, in expectation, and the least number of buckets.
BUCKET_KEYS, LEAST_BUCKETS = 4_000_000, 64
#: Bits that keys of n-grams have beyond those that count them.
SPARE_BITS = 20
#: Contexts are as one if their counts have the same number of binary digits, up to this.
LEVELS = 24
#: Expectation-maximisation ends at a gain of less than this in log10 a token, or after so many rounds.
GAIN, ROUNDS = 1e-4, 15
KEPT, DELETED, UNSEEN = 0, 1, 2


def _pack(a: np.ndarray) -> bytes:
    """Compressed, equal bytes of the numbers together."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def _unpack(b: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def words(text: bytes | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z in lower case."""
    return text.lower().split() if text else []


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def chunks(docs: DataFrame, role: Column, id_col: str, text_col: str) -> DataFrame:
    """Chunks of texts: ids, roles and sizes of the texts, and the tokens as places in a vocabulary of hashes. Every text ends with the token at place 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, ids, roles, sizes, tokens = _Codes({None: 0}), [], [], [], []
        held = 0

        def chunk() -> pa.RecordBatch:
            names = iter(codes)
            next(names)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), dtype=np.uint64, count=len(codes) - 1)
            size, part = np.array(sizes, dtype=np.int64), np.array(roles, dtype=np.uint8)
            sums = [x for r in (KEPT, DELETED) for x in (int((part == r).sum()), int(size[part == r].sum()))]
            row = [ids, part.tobytes(), _pack(size.astype(np.uint32)), _pack(np.concatenate(tokens)), _pack(np.concatenate([[np.uint64(1)], hashes])), held, *sums]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t, _) in zip(row, _CHUNK, strict=True)], names=[n for n, _, _ in _CHUNK])

        for b in batches:
            for i, text, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                got = [codes[w] for w in words(text)]
                got.append(0)
                ids.append(i)
                roles.append(r)
                sizes.append(len(got))
                tokens.append(np.array(got, dtype=np.uint32))
                held += len(got)
                if held >= CHUNK_TOKENS:
                    yield chunk()
                    codes, ids, roles, sizes, tokens, held = _Codes({None: 0}), [], [], [], [], 0
        if ids:
            yield chunk()

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"), role.cast("int").alias("role"))
    got = map_arrow(src, run, ", ".join(f"{n} {k}" for n, _, k in _CHUNK))
    return written(got.withColumn("chunk", F.monotonically_increasing_id()))


_BLOB = (pa.binary(), "binary")
_LONG = (pa.int64(), "long")
_CHUNK = [("ids", pa.list_(pa.int64()), "array<long>"), *((n, *_BLOB) for n in ("roles", "sizes", "tokens", "hashes")), *((n, *_LONG) for n in ("held", "kept_docs", "kept_tokens", "deleted_docs", "deleted_tokens"))]


def _keys(tokens: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, order: int, width: int) -> np.ndarray:
    """A row of keys for each order: of the n-grams that end at each token. Before a text stand as many beginnings as there must."""
    word = hashes[tokens]
    kept = [~np.uint64(3), *[~np.uint64((1 << (64 - min(width, 62))) - 1)] * (order - 1)]
    starts = np.cumsum(sizes) - sizes
    out = np.empty((order, len(word)), dtype=np.uint64)
    before = np.zeros(len(word), dtype=np.uint64)
    for o in range(order):
        x = (before + np.uint64(o + 1)) * np.uint64(0x9E3779B97F4A7C15) + word
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        out[o] = (x & kept[o]) | np.uint64(o)
        before = np.roll(out[o], 1)
        before[starts] = np.uint64(o)  # the beginning as a context
    return out


def _different(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different keys, the order that sorts them, and where each sorted one is among the different."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new], order, np.cumsum(new) - 1


def _pieces(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one order's keys: the different ones, sorted; the order that sorts all; where each sorted one is among the different; and where buckets begin among those, with their end."""
    have, at, place = _different(keys)
    return have, at, place, np.searchsorted(have >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def _pack_keys(pieces: list[np.ndarray]) -> bytes:
    """Sorted keys of each order, as the steps between them; the order's bits are left out."""
    return _pack(np.concatenate([np.diff(p >> np.uint64(2), prepend=np.uint64(0)) for p in pieces]))


def _unpack_keys(b: bytes, sizes: list[int]) -> np.ndarray:
    steps = np.split(_unpack(b, np.uint64), np.cumsum(sizes)[:-1])
    return np.concatenate([(np.cumsum(x, dtype=np.uint64) << np.uint64(2)) | np.uint64(o) for o, x in enumerate(steps)])


def _pack_counts(kept: np.ndarray, deleted: np.ndarray) -> bytes:
    """Two small counts in one byte; a pair with a larger one apart."""
    small = (kept < 15) & (deleted < 15)
    code = _pack(np.where(small, kept + 16 * deleted, 255).astype(np.uint8))
    return len(code).to_bytes(4, "little") + code + _pack(np.concatenate([kept[~small], deleted[~small]]).astype(np.int64))


def _unpack_counts(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    cut = 4 + int.from_bytes(b[:4], "little")
    code, large = _unpack(b[4:cut], np.uint8).astype(np.int64), _unpack(b[cut:], np.int64)
    kept, deleted, apart = code & 15, code >> 4, code == 255
    kept[apart], deleted[apart] = np.split(large, 2)
    return kept, deleted


_ASK = [("bucket", pa.int32(), "int"), ("chunk", pa.int64(), "long"), ("sizes", pa.list_(pa.int32()), "array<int>"), ("keys", pa.binary(), "binary"), ("counts", pa.binary(), "binary")]


def _asks(chunked: DataFrame, order: int, width: int, bits: int) -> DataFrame:
    """(bucket, chunk, sizes, keys, counts): a chunk's different keys, order by order, with their counts in its own texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                sizes = _unpack(r["sizes"], np.uint32).astype(np.int64)
                role = np.repeat(np.frombuffer(r["roles"], dtype=np.uint8), sizes)
                made = []
                for keys in _keys(_unpack(r["tokens"], np.uint32), sizes, _unpack(r["hashes"], np.uint64), order, width):
                    have, at, place, cuts = _pieces(keys, bits)
                    counts = [np.bincount(place, weights=role[at] == x, minlength=len(have)).astype(np.int64) for x in (KEPT, DELETED)]
                    made.append((have, *counts, cuts))
                for k in range(1 << bits):
                    have, kept, deleted = ([m[x][m[3][k] : m[3][k + 1]] for m in made] for x in range(3))
                    row = [k, r["chunk"], [len(h) for h in have], _pack_keys(have), _pack_counts(np.concatenate(kept), np.concatenate(deleted))]
                    if sum(row[2]):
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t, _) in zip(row, _ASK, strict=True)], names=[n for n, _, _ in _ASK])

    return map_arrow(chunked.select("chunk", "roles", "sizes", "tokens", "hashes"), run, ", ".join(f"{n} {k}" for n, _, k in _ASK))


def _answer(asked: pa.Table) -> pa.Table:
    """Of one bucket: each row's keys with their counts in all texts; the first row says how many different words are known."""
    rows = asked.select(["sizes", "keys", "counts"]).to_pylist()
    keys = [_unpack_keys(r["keys"], r["sizes"]) for r in rows]
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    have, at, place = _different(np.concatenate(keys))
    del keys
    out = []
    for given in zip(*(_unpack_counts(r["counts"]) for r in rows), strict=True):
        total = np.bincount(place, weights=np.concatenate(given)[at], minlength=len(have)).astype(np.int64)
        mine = np.empty(len(at), dtype=np.int64)
        mine[at] = total[place]
        out.append((total, mine))
    known = int((((out[0][0] + out[1][0]) > 0) & ((have & np.uint64(3)) == 0)).sum())
    kept, deleted = ([_pack(x) for x in np.split(mine, cuts)] for _, mine in out)
    return pa.table({"chunk": asked.column("chunk"), "bucket": asked.column("bucket"), "kept": pa.array(kept, pa.binary()), "deleted": pa.array(deleted, pa.binary()), "known": pa.array([known] + [0] * (len(kept) - 1), pa.int64())})


def _counted(chunked: DataFrame, answers: DataFrame, order: int, width: int, bits: int) -> DataFrame:
    """(ids, roles, sizes, train, held): for the tokens of a chunk the training counts of their n-grams of each
    order; for those of its deleted texts the kept counts."""

    def meet(chunk: pa.Table, answer: pa.Table) -> pa.Table:
        r = chunk.to_pylist()[0]
        sizes = _unpack(r["sizes"], np.uint32).astype(np.int64)
        deleted_text = np.repeat(np.frombuffer(r["roles"], dtype=np.uint8) == DELETED, sizes)
        rows = {x["bucket"]: (_unpack(x["kept"], np.int64), _unpack(x["deleted"], np.int64)) for x in answer.select(["bucket", "kept", "deleted"]).to_pylist()}
        taken = dict.fromkeys(rows, 0)  # of each answer: what lower orders took
        train, held = [], []
        for keys in _keys(_unpack(r["tokens"], np.uint32), sizes, _unpack(r["hashes"], np.uint64), order, width):
            _, at, place, cuts = _pieces(keys, bits)
            mine: list[list[np.ndarray]] = [[], []]
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                lo = taken[k]
                taken[k] = hi = lo + int(cuts[k + 1] - cuts[k])
                for x in (0, 1):
                    mine[x].append(rows[k][x][lo:hi])
            kept, deleted = (np.concatenate(m) for m in mine)
            counts = np.empty(len(keys), dtype=np.int64)
            counts[at] = kept[place]
            held.append(counts[deleted_text])
            counts = np.empty(len(keys), dtype=np.int64)
            counts[at] = (kept + deleted)[place]
            train.append(counts)
        blobs = (_pack(np.concatenate(train)), _pack(np.concatenate(held)))
        return pa.table({n: pa.array([v], t) for n, v, t in (("ids", r["ids"], pa.list_(pa.int64())), ("roles", r["roles"], pa.binary()), ("sizes", r["sizes"], pa.binary()), ("train", blobs[0], pa.binary()), ("held", blobs[1], pa.binary()))})

    left = chunked.select("chunk", "ids", "roles", "sizes", "tokens", "hashes")
    right = answers.select("chunk", "bucket", "kept", "deleted")
    return left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(meet, "ids array<long>, roles binary, sizes binary, train binary, held binary")


@dataclass
class Model:
    """Mixture weights by order and level of the context's count; order one has one weight."""

    tokens: int = 0  # in training texts
    texts: int = 0
    types: int = 0
    order: int = ORDER
    weights: np.ndarray = field(default_factory=lambda: np.zeros((ORDER, LEVELS)))

    def parts(self, counts: np.ndarray, sizes: np.ndarray, tokens: int, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """For each order and token its maximum-likelihood estimate and the level of its context."""
        starts = np.cumsum(sizes) - sizes
        share, level = np.zeros(counts.shape), np.zeros(counts.shape, dtype=np.int64)
        for o in range(self.order):
            if o:
                context = np.roll(counts[o - 1], 1).astype(np.float64)
                context[starts] = texts
            else:
                context = np.full(counts.shape[1], float(tokens))
            share[o] = np.divide(counts[o], context, out=np.zeros(len(context)), where=context > 0)
            level[o] = np.minimum(np.frexp(context)[1], LEVELS - 1) if o else int(tokens > 0)
        return share, level

    def mixed(self, share: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Probabilities by order; the last row is the model's."""
        out = np.empty_like(share)
        lower = 1.0 / (self.types + 1)
        for o in range(self.order):
            w = self.weights[o][level[o]]
            out[o] = lower = w * share[o] + (1 - w) * lower
        return out

    def shares(self, share: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, float]:
        """By order and level: expected uses of the order's own estimate, and of it or a lower one; and the log10 likelihood."""
        p = self.mixed(share, level)
        out = np.zeros((2, self.order, LEVELS))
        reaches = np.ones(share.shape[1])
        for o in reversed(range(self.order)):
            own = reaches * self.weights[o][level[o]] * share[o] / p[o]
            out[0, o] = np.bincount(level[o], weights=own, minlength=LEVELS)
            out[1, o] = np.bincount(level[o], weights=reaches, minlength=LEVELS)
            reaches = np.maximum(reaches - own, 0.0)
        return out, float(np.log10(p[-1]).sum())


def _weigh(counted: DataFrame, model: Model, tokens: int, texts: int, n_held: int) -> None:
    """Expectation-maximisation over all deleted texts; each round is one pass, of which sums by order and level come back."""
    model.weights[:, 1:] = 0.5  # an unseen context has no estimate of its own
    last = None
    for _ in range(ROUNDS if n_held else 0):
        shared = counted.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m, total, score = shared.value, 0.0, 0.0
            for b in batches:
                for r in b.to_pylist():
                    sizes = _unpack(r["sizes"], np.uint32).astype(np.int64)[np.frombuffer(r["roles"], dtype=np.uint8) == DELETED]
                    if len(sizes):
                        got, s = m.shares(*m.parts(_unpack(r["held"], np.int64).reshape(m.order, -1), sizes, tokens, texts))
                        total, score = total + got, score + s
            flat = [score, *np.broadcast_to(total, (2, m.order, LEVELS)).reshape(-1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat, pa.float64())], names=["k", "v"])

        rows = map_arrow(counted.select("roles", "sizes", "held"), run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        got = np.array([r["v"] for r in sorted(rows, key=lambda r: r["k"])])
        shared.unpersist()
        own, all_uses = got[1:].reshape(2, model.order, LEVELS)
        model.weights = (own + 0.5) / (all_uses + 1.0)
        model.weights[:, 0] = 0.0
        if last is not None and got[0] - last < GAIN * n_held:
            break
        last = got[0]


def score(docs: DataFrame, learn: Column, deleted: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> tuple[DataFrame, Model]:
    """(id, learned, n_tokens, n_known, train_tokens, base_score, score) of each row, and the model.

    learn: which rows are learned from; deleted: which of them tell the weights.
    A condition that is null is false. Tokens are words and one end for each
    text; a null text is empty, so has one token. n_known: tokens that training
    texts hold. base_score, score: log10 of the text's probability by add-one
    unigrams, and by the model; both 0 where nothing was learned. Rows that
    repeat, and ids that do or are null, count and return each for itself; an
    empty table gives no rows. order is 1 to 4. Other columns of docs, whatever
    their names, are not looked at.
    """
    spark = docs.sparkSession
    false = F.lit(False)
    role = F.when(~F.coalesce(learn, false), UNSEEN).when(F.coalesce(deleted, false), DELETED).otherwise(KEPT)
    chunked = chunks(docs, role, id_col, text_col)
    names = ["held", "kept_docs", "kept_tokens", "deleted_docs", "deleted_tokens"]
    n = chunked.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    bits = max((LEAST_BUCKETS - 1).bit_length(), (order * n["held"] // BUCKET_KEYS).bit_length())
    width = (order * n["held"]).bit_length() + SPARE_BITS
    answers = written(_asks(chunked, order, width, bits).groupBy("bucket").applyInArrow(_answer, "chunk long, bucket int, kept binary, deleted binary, known long"), free=True)
    types = answers.agg(F.coalesce(F.sum("known"), F.lit(0)).alias("v")).first()["v"]
    counted = written(_counted(chunked, answers, order, width, bits), free=True)
    model = Model(n["kept_tokens"] + n["deleted_tokens"], n["kept_docs"] + n["deleted_docs"], types, order, np.zeros((order, LEVELS)))
    _weigh(counted, model, n["kept_tokens"], n["kept_docs"], n["deleted_tokens"])
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for r in b.to_pylist():
                sizes = _unpack(r["sizes"], np.uint32).astype(np.int64)
                starts = np.cumsum(sizes) - sizes
                counts = _unpack(r["train"], np.int64).reshape(m.order, -1)
                p = m.mixed(*m.parts(counts, sizes, m.tokens, m.texts))[-1]
                base = np.log10((counts[0] + 1.0) / (m.tokens + m.types + 1))
                each = [np.add.reduceat(x, starts) for x in ((counts[0] > 0).astype(np.int64), base, np.log10(p))]
                role_of = np.frombuffer(r["roles"], dtype=np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(role_of != UNSEEN), pa.array(sizes), *map(pa.array, each)], names=["id", "learned", "n_tokens", "n_known", "base_score", "score"])

    out = map_arrow(counted.select("ids", "roles", "sizes", "train"), run, "id long, learned boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(model.tokens).cast("long")), model
