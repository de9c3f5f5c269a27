"""Quality by ordinal cumulative-link regression on graded ratings.

A text is the Hellinger vector (square root of relative frequency) of its
hashed character n-grams and of a few hashed statistics tokens. All grades
share the weights w; ordered thresholds t_1 < t_2 < ... cut the scale:
P(grade <= k) = sigmoid(t_k - w.x). The expected grade ranks texts, the tail
probability P(grade >= k) selects them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import labelled_sample, map_arrow, map_texts
from logloom.llm.ngrams import code_points, hashed, text_buckets

ORDERS = (1, 2, 3)
HASH_BITS = 12
#: Rows of each grade that a model is fitted on, at most.
TRAIN_ROWS = 1500


def _statistics(text: str) -> list[str]:
    """Tokens for what n-grams cannot see: repetition, word length, case, line length."""
    words = text.split()
    if not words:
        return ["empty"]
    lines = [x for x in text.split("\n") if x.strip()]
    share = len(set(words)) / len(words)
    upper = sum(w.isupper() for w in words) / len(words)
    marks = sum(not w[-1].isalnum() for w in words) / len(words)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
    lone = sum(len(w) == 1 for w in words) / len(words)
    repeats = 1 - len(set(lines)) / max(1, len(lines))
    return [f"{n}:{int(v * 10)}" for n, v in (("share", share), ("upper", upper), ("marks", marks), ("again", again), ("lone", lone), ("lines", repeats))] + [f"mean:{min(20, sum(map(len, words)) // len(words))}", f"size:{len(words).bit_length()}"]


def features(text: str, orders: tuple[int, ...] = ORDERS, bits: int = HASH_BITS) -> np.ndarray:
    """Unit vector of the whole text; zero for the empty one."""
    x = np.zeros(1 << bits, dtype=np.float64)
    if not text:
        return x.astype(np.float32)
    cp = code_points(text)
    for ids in text_buckets(cp, orders, bits):
        x += np.bincount(ids, minlength=1 << bits)
    x = np.sqrt(x / x.sum())
    for token in _statistics(text):
        c = code_points("\x00" + token)
        x[hashed(c, len(c), bits)[0]] += 0.25
    return (x / np.linalg.norm(x)).astype(np.float32)


@dataclass
class QualityModel:
    grades: list[int]
    weights: np.ndarray
    cuts: np.ndarray  # one fewer than grades, ascending
    orders: tuple[int, ...] = ORDERS
    bits: int = HASH_BITS

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k]) for k = 1..; columns fall from left to right."""
        return 1.0 / (1.0 + np.exp(-np.clip(z[:, None] - self.cuts[None, :], -50, 50)))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        step = np.diff(np.array(self.grades, dtype=float))
        return self.grades[0] + tails @ step


def _fit_cumulative(x: np.ndarray, y: np.ndarray, levels: int, l2: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood by Adam; thresholds are a first one and positive steps."""
    n = len(y)
    below = np.array([(y <= k).mean() for k in range(levels - 1)])
    start = np.log(np.clip(below, 1e-3, 1 - 1e-3) / (1 - np.clip(below, 1e-3, 1 - 1e-3)))
    theta = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    w = np.zeros(x.shape[1], dtype=np.float32)
    m1, v1, m2, v2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(theta), np.zeros_like(theta)
    rows = np.arange(n)
    for t in range(1, steps + 1):
        cuts = np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))
        z = x @ w
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        s = 1.0 / (1.0 + np.exp(-np.clip(edge[None, :] - z[:, None], -50, 50)))
        s[:, 0], s[:, -1] = 0.0, 1.0
        p = np.maximum(s[rows, y + 1] - s[rows, y], 1e-12)
        d = s * (1 - s)
        gz = (d[rows, y + 1] - d[rows, y]) / p / n  # of the negative log likelihood
        gw = x.T @ gz.astype(np.float32) + l2 * w
        gc = np.zeros(levels - 1)
        for k in range(levels - 1):
            gc[k] = -(d[y == k, k + 1] / p[y == k]).sum() / n + (d[y == k + 1, k + 1] / p[y == k + 1]).sum() / n
        gt = np.concatenate([[gc.sum()], [gc[k:].sum() * np.exp(theta[k]) for k in range(1, levels - 1)]])
        m1, v1 = 0.9 * m1 + 0.1 * gw, 0.999 * v1 + 0.001 * gw * gw
        m2, v2 = 0.9 * m2 + 0.1 * gt, 0.999 * v2 + 0.001 * gt * gt
        a, c = 1 - 0.9**t, 1 - 0.999**t
        w -= (0.2 * (m1 / a) / (np.sqrt(v1 / c) + 1e-8)).astype(np.float32)
        theta -= 0.05 * (m2 / a) / (np.sqrt(v2 / c) + 1e-8)
    return w, np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))


def fit(docs: DataFrame, labels: DataFrame, rating: Column | None = None, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, orders: tuple[int, ...] = ORDERS, bits: int = HASH_BITS, l2: float = 1e-5, steps: int = 200) -> QualityModel:
    """Fit on at most about `train_rows` labelled rows of each grade.

    rating is an integer grade computed from the label table (its column
    quality by default). The driver gets one vector of 2**bits floats for each
    training row. With a single grade every text gets it; with none, grade 0.
    """
    part = labelled_sample(docs, labels, id_col, text_col, F.col("quality") if rating is None else rating, train_rows)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t, orders, bits).astype(np.float16).tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(got, pa.binary())], names=["y", "x"])

    got = sorted((r["y"], bytes(r["x"])) for r in map_arrow(part.select("text", "y"), vectors, "y int, x binary").collect())
    grades = sorted({y for y, _ in got}) or [0]
    if len(grades) < 2:
        return QualityModel(grades, np.zeros(1 << bits, dtype=np.float32), np.zeros(0), orders, bits)
    x = np.stack([np.frombuffer(v, dtype=np.float16) for _, v in got]).astype(np.float32)
    y = np.searchsorted(grades, [g for g, _ in got])
    w, cuts = _fit_cumulative(x, y, len(grades), l2, steps)
    return QualityModel(grades, w, cuts, orders, bits)


def grade(docs: DataFrame, model: QualityModel, text_col: str = "text", least: int | None = None, keep_at: float = 0.5, columns: list[str] | None = None) -> DataFrame:
    """docs (all columns, or those named) with expected_grade, tail_prob and kept.

    tail_prob is P(grade >= least), by default for the second lowest grade; kept
    says that it reaches keep_at. Null texts are graded like empty ones, whole
    texts however long. Every row returns once, repeated rows and equal ids too;
    equal texts get equal grades; an empty table stays empty; columns named like
    the new ones, in any case, are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    least = model.grades[min(1, len(model.grades) - 1)] if least is None else least

    def score(texts: list) -> list[list]:
        m = shared.value
        z = np.array([features(t or "", m.orders, m.bits) @ m.weights for t in texts], dtype=float)
        tails = m.tails(z)
        k = int(np.searchsorted(m.grades, least))
        tail = np.ones(len(z)) if k == 0 else tails[:, k - 1] if k < len(m.grades) else np.zeros(len(z))
        return [m.expected(tails).tolist(), tail.tolist(), (tail >= keep_at).tolist()]

    return map_texts(docs, text_col, [("expected_grade", "double", pa.float64()), ("tail_prob", "double", pa.float64()), ("kept", "boolean", pa.bool_())], score, columns)
