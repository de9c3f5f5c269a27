"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text becomes the set of its hashed character n-grams (letters lower-cased,
runs of anything but letters turned into one blank, so n-grams know where words
begin and end). A feature's value is the log ratio of its smoothed document
frequencies among toxic and clean rows; a logistic regression weights them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import labelled_sample, map_arrow, map_texts
from logloom.llm.ngrams import code_points, text_buckets

ORDERS = (4, 5, 6)
HASH_BITS = 20
#: Rows of each class that a model is fitted on, at most.
TRAIN_ROWS = 3000
#: Features kept: those whose log-count ratios are the most standard errors from zero.
FEATURES = 4000
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def normalise(text: str) -> str:
    return " " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " "


def buckets(text: str, orders: tuple[int, ...], bits: int, keep: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of the text; with keep (a flag for each bucket) only those."""
    found = []
    for ids in text_buckets(code_points(normalise(text)), orders, bits):
        found.append(np.unique(ids if keep is None else ids[keep[ids]]))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)


@dataclass
class ToxicityModel:
    ids: np.ndarray  # buckets with a weight, ascending
    weights: np.ndarray  # ratio times learned weight
    bias: float
    orders: tuple[int, ...] = ORDERS
    bits: int = HASH_BITS

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        keep = np.zeros(1 << self.bits, dtype=bool)
        dense = np.zeros(1 << self.bits)
        keep[self.ids] = True
        dense[self.ids] = self.weights
        return keep, dense

    def score(self, text: str | None, keep: np.ndarray, dense: np.ndarray) -> float:
        z = self.bias + (float(dense[buckets(text, self.orders, self.bits, keep)].sum()) if text else 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -50, 50))))


def _logistic(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam over all rows at once; features are scale where present."""
    n, m = len(rows), len(scale)
    col = np.concatenate(rows) if n else np.zeros(0, dtype=np.int64)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    x = scale[col]
    w, b = np.zeros(m), 0.0
    mw, vw, mb, vb = np.zeros(m), np.zeros(m), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=x * w[col], minlength=n) + b
        g = (1.0 / (1.0 + np.exp(-np.clip(z, -50, 50))) - y) / n
        gw = np.bincount(col, weights=x * g[row], minlength=m) + l2 * w
        gb = g.sum()
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.05 * (mw / a) / (np.sqrt(vw / c) + 1e-8)
        b -= 0.05 * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, features: int = FEATURES, orders: tuple[int, ...] = ORDERS, bits: int = HASH_BITS, alpha: float = 0.5, l2: float = 1e-3, steps: int = 150) -> ToxicityModel:
    """Fit on at most about `train_rows` rows of each class.

    The frequencies of the buckets are counted in the tasks; the driver picks
    the features and gets the rows as short lists of them. With one class or
    none, the model scores every text by the class alone (0 without any).
    """
    part = labelled_sample(docs, labels, id_col, text_col, F.col(label_col) > 0, train_rows)
    size = {r["y"]: r["count"] for r in part.groupBy("y").count().collect()}
    if len(size) < 2:
        return ToxicityModel(np.zeros(0, dtype=np.int64), np.zeros(0), 50.0 if size.get(1) else -50.0, orders, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(1 << bits, dtype=np.int32) for _ in range(2)]
        n = [0, 0]
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[y][buckets(text, orders, bits)] += 1
                n[y] += 1
        for y in range(2):
            at = np.flatnonzero(seen[y]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([n[y]], pa.int64()), pa.array([at.tobytes()], pa.binary()), pa.array([seen[y][at].tobytes()], pa.binary())], names=["y", "n", "at", "counts"])

    freq, n = np.zeros((2, 1 << bits)), np.zeros(2)
    for r in map_arrow(part.select("text", "y"), count, "y int, n long, at binary, counts binary").collect():
        freq[r["y"], np.frombuffer(r["at"], dtype=np.int32)] += np.frombuffer(r["counts"], dtype=np.int32)
        n[r["y"]] += r["n"]
    ratio = np.log((freq[1] + alpha) / (n[1] + 2 * alpha)) - np.log((freq[0] + alpha) / (n[0] + 2 * alpha))
    worth = np.abs(ratio) / np.sqrt((1.0 / (freq + alpha)).sum(axis=0))
    worth[freq.sum(axis=0) == 0] = 0.0
    order = np.lexsort((np.arange(1 << bits), -worth))[:features]
    ids = np.sort(order[worth[order] > 0])
    keep = np.zeros(1 << bits, dtype=bool)
    keep[ids] = True
    shared = docs.sparkSession.sparkContext.broadcast(keep)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [buckets(t, orders, bits, shared.value).astype(np.int32).tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(got, pa.binary())], names=["y", "at"])

    got = sorted((r["y"], bytes(r["at"])) for r in map_arrow(part.select("text", "y"), vectors, "y int, at binary").collect())
    w, b = _logistic([np.searchsorted(ids, np.frombuffer(at, dtype=np.int32)) for _, at in got], np.array([y for y, _ in got], dtype=float), ratio[ids], l2, steps)
    return ToxicityModel(ids, w * ratio[ids], b, orders, bits)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "toxicity", columns: list[str] | None = None) -> DataFrame:
    """docs (all columns, or those named) with a score from 0 to 1 of the whole text.

    Null and empty texts get the score of a text without known n-grams. Every
    row returns once, repeated rows too; an empty table stays empty. A column
    named like the score is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tables: list = []

    def run(texts: list) -> list[list]:
        if not tables:
            tables.extend(shared.value.tables())
        return [[shared.value.score(t, *tables) for t in texts]]

    return map_texts(docs, text_col, [(score_col, "double", pa.float64())], run, columns)
