"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import map_arrow, map_texts
from logloom.llm.ngrams import code_points, text_buckets

ORDERS = (1, 2, 3)
HASH_BITS = 14
#: Rows of each language that a model is fitted on, at most; scoring covers all rows.
TRAIN_ROWS = 1000
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class LanguageModel:
    langs: list[str]
    log_prob: np.ndarray  # 2**bits x languages
    prior: np.ndarray
    orders: tuple[int, ...] = ORDERS
    bits: int = HASH_BITS

    def scores(self, text: str) -> np.ndarray:
        """Log posterior up to a constant, for each language."""
        total = self.prior.copy()
        for ids in text_buckets(code_points(text.lower()), self.orders, self.bits):
            total += self.log_prob[ids].sum(axis=0, dtype=np.float64)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        s = self.scores(text)
        k = int(np.argmax(s))
        return self.langs[k], float(1.0 / np.exp(s - s[k]).sum())


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, orders: tuple[int, ...] = ORDERS, bits: int = HASH_BITS, alpha: float = 0.5) -> LanguageModel:
    """Fit on at most about `train_rows` rows of each language, chosen by a hash of the id.

    A language that few rows have is learned from all of them, however large the
    table; how frequent languages are is counted over all rows. N-gram counts are
    summed in each task and reach the driver as one dense row for a task and
    language. With no usable row the model has no language.
    """
    known = rows.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).withColumn("__lang", F.col(lang_col).cast("string"))
    total = {r["__lang"]: r["n"] for r in known.groupBy("__lang").agg(F.count("*").alias("n")).collect()}
    part = known.limit(0)
    if total:
        share = F.create_map(*[F.lit(x) for k, n in sorted(total.items()) for x in (k, int(min(1.0, train_rows / n) * 2**62))])
        part = known.filter(F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col(id_col)), 2) <= share[F.col("__lang")]).repartition(8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = seen.setdefault(lang, np.zeros(1 << bits, dtype=np.int64))
                for ids in text_buckets(code_points(text.lower()), orders, bits):
                    c += np.bincount(ids, minlength=1 << bits)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v.tobytes() for v in seen.values()], pa.binary())], names=["lang", "counts"])

    got = map_arrow(part.select(F.col(text_col).cast("string"), "__lang"), count, "lang string, counts binary").collect()
    langs = sorted({r["lang"] for r in got})
    counts = np.zeros((1 << bits, len(langs)))
    for r in got:
        counts[:, langs.index(r["lang"])] += np.frombuffer(r["counts"], dtype=np.int64)
    docs = np.array([total[k] for k in langs], dtype=np.float64)
    if not langs:
        return LanguageModel([], np.zeros((1 << bits, 0), dtype=np.float32), np.zeros(0), orders, bits)
    prob = (counts + alpha) / (counts + alpha).sum(axis=0)
    return LanguageModel(langs, np.log(prob).astype(np.float32), np.log(docs / docs.sum()), orders, bits)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "lang_score", columns: list[str] | None = None) -> DataFrame:
    """docs (all columns, or those named) with the predicted language and its posterior, 0 to 1.

    `und` with score 0 where the text is null or has no letter, or the model was
    fitted on nothing. Every row returns once, repeated rows too; an empty table
    stays empty. Columns named like the two new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: list) -> list[list]:
        got = [shared.value.predict(t) for t in texts]
        return [[g[0] for g in got], [g[1] for g in got]]

    return map_texts(docs, text_col, [(pred_col, "string", pa.string()), (score_col, "double", pa.float64())], score, columns)
