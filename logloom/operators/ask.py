"""Questions to a model, asked by executors: each different prompt once, and remembered.

The memo is a table of prompts, replies and how many requests each took. What it
knows is joined before anything is asked; what is new is dealt to a bounded number
of tasks, each with a bounded number of requests under way, in rounds that are
written one by one, so a lost job loses a round at most. Requests are counted
where they are made, failed ones too, and come back with the reply: a task that
runs again counts once, as only one of its attempts is written.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import align, text
from logloom.functions.shared import checkpoint
from logloom.operators.oracle import CONSTANT_PROMPT, MEANING_PROMPT, SAME_PROMPT

MEMO = "prompt string, reply string, calls long"
#: Prompts of a round.
ROUND = 100_000


class Client(Protocol):
    def ask(self, prompt: str) -> str:
        """The reply; OSError, ValueError, KeyError or IndexError if there is none."""


class Offline:
    """Answers without a server: a message's template by the heuristic."""

    def ask(self, prompt: str) -> str:
        return align.heuristic(prompt).template


def memo(spark: SparkSession, path: str) -> DataFrame:
    """(prompt, reply, calls): each prompt that was asked; the reply is null where all requests failed."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], MEMO)
    return spark.read.schema(MEMO).parquet(path).groupBy("prompt").agg(F.max("reply").alias("reply"), F.sum("calls").alias("calls"))


def ask(prompts: DataFrame, client: Client, path: str, prompt_col: str = "prompt", tasks: int = 8, at_once: int = 4, tries: int = 3, wait: float = 0.5, round_rows: int = ROUND) -> DataFrame:
    """(prompt, reply, calls) of each different prompt that is not null, from the memo below `path`, where new ones are added.

    At most `tasks` times `at_once` requests are under way. A request that fails
    is made again, up to `tries` in all, after `wait` seconds and twice as long
    each time; a prompt without a reply is asked again by a later call.
    """
    spark = prompts.sparkSession
    asked = checkpoint(prompts.select(F.col(prompt_col).alias("prompt")).filter("prompt is not null").distinct())
    new = checkpoint(asked.join(memo(spark, path).filter("reply is not null"), "prompt", "left_anti"))

    def one(prompt: str) -> tuple[str | None, int]:
        for k in range(tries):
            try:
                return client.ask(prompt), k + 1
            except (OSError, ValueError, KeyError, IndexError):
                if k + 1 < tries:
                    time.sleep(wait * 2**k)
        return None, tries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                got = list(pool.map(one, b.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r for r, _ in got], pa.string()), pa.array([n for _, n in got], pa.int64())], names=["prompt", "reply", "calls"])

    rounds = -(-new.count() // round_rows)
    for k in range(rounds):
        mine = new.filter(F.pmod(F.xxhash64(F.lit("round"), "prompt"), F.lit(rounds)) == k)
        mine.repartition(tasks).mapInArrow(run, MEMO).write.mode("append").parquet(path)
    # not left as a plan: Spark takes two reads of one path in a plan for equal, also where files came in between
    return checkpoint(asked.join(memo(spark, path), "prompt"))


def _filled(prompt: tuple[str, ...], *values: Column) -> Column:
    """A prompt's pieces with the values between them."""
    parts = [F.lit(prompt[0])]
    for v, piece in zip(values, prompt[1:], strict=True):
        parts += [v, F.lit(piece)]
    return F.concat(*parts)


def templates(messages: DataFrame, client: Client, path: str, content_col: str = "content", **limits) -> DataFrame:
    """(content, template, calls): the client's template of each different message; the heuristic's where there is no reply."""
    got = ask(messages, client, path, content_col, **limits).withColumnRenamed("prompt", "content")
    return got.select("content", F.coalesce("reply", align.heuristic_template("content").getField("template")).alias("template"), "calls")


def same_event(pairs: DataFrame, client: Client, path: str, first: str = "a", second: str = "b", **limits) -> DataFrame:
    """pairs with `same`: whether the client takes two templates for one statement; null without a reply."""
    asked = pairs.withColumn("__prompt", _filled(SAME_PROMPT, F.col(first), F.col(second)))
    got = ask(asked, client, path, "__prompt", **limits).select(F.col("prompt").alias("__prompt"), text.says_yes(F.col("reply")).alias("same"))
    return asked.join(got, "__prompt", "left").drop("__prompt")


def constant_tokens(tokens: DataFrame, client: Client, path: str, message: str = "content", token: str = "token", **limits) -> DataFrame:
    """tokens with `constant`: whether the client, asked for the meaning first, takes a part of a message for constant text; null without a reply."""
    asked = tokens.withColumn("__prompt", _filled(MEANING_PROMPT, F.col(message), F.col(token)))
    meant = ask(asked, client, path, "__prompt", **limits).select(F.col("prompt").alias("__prompt"), F.col("reply").alias("__meaning"))
    asked = asked.join(meant, "__prompt", "left").withColumn("__prompt", _filled(CONSTANT_PROMPT, F.col(message), F.col(token), F.col("__meaning"))).drop("__meaning")
    got = ask(asked, client, path, "__prompt", **limits).select(F.col("prompt").alias("__prompt"), text.says_constant(F.col("reply")).alias("constant"))
    return asked.join(got, "__prompt", "left").drop("__prompt")
