"""Online mining on a stream, with a keyed state for each dataset.

A dataset's lines go through the ordered pass (`mine.Miner`) batch by batch; its
clusters, the entries of its catalog and its next id are state, so that a batch
goes on where the last one ended, after a restart too. Nothing of it passes the
driver, and what the state holds grows with the templates, not with the lines.

Every batch leaves a version: its lines with the ids that they got, the clusters
that changed, and the moves of clusters that became part of others. Ids are
given once. `structured` reads all versions and follows the moves, so a merge in
a later batch changes the ids of earlier lines without any of them being written
again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from logloom.functions import text
from logloom.functions.shared import checkpoint
from logloom.operators.match import Entry
from logloom.operators.mine import Cluster, Miner
from logloom.operators.oracle import Oracle

#: What a batch leaves. line: id; move: id became part of other; cluster: its template and lines so far; closed: the dataset's state ended.
VERSION = "kind string, dataset string, LineId long, id long, other long, template string, lines long"
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class OnlineMiner(StatefulProcessor):
    """The ordered pass over one dataset's lines. idle_ms: a dataset without lines for so long is closed, and starts anew if it returns, with new ids."""

    def __init__(self, oracle: Oracle | None = None, idle_ms: int | None = None) -> None:
        self.oracle, self.idle_ms = oracle, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "next_id long")
        self.clusters = handle.getMapState("clusters", "id long", "template string, first long, lines long, members array<string>")
        self.entries = handle.getMapState("entries", "id long, template string", "classes array<array<string>>")

    def _restored(self) -> Miner:
        miner = Miner(self.oracle)
        if self.head.exists():
            clusters = {k[0]: Cluster(v[0], v[1], v[2], list(v[3])) for k, v in self.clusters.iterator()}
            entries = [Entry(k[0], k[1], [set(c) for c in v[0]]) for k, v in self.entries.iterator()]
            miner.restore(clusters, entries, self.head.get()[0])
        return miner

    def _keep(self, miner: Miner, clusters: dict, entries: dict) -> None:
        """Write what differs from what the state held."""
        self.head.update((miner.next_id,))
        for cid in clusters.keys() - miner.clusters.keys():
            self.clusters.removeKey((cid,))
        for cid, c in miner.clusters.items():
            if clusters.get(cid) != (now := (c.template, c.first, c.rows, tuple(c.members))):
                self.clusters.updateValue((cid,), (*now[:3], list(now[3])))
        for key in entries.keys() - miner.entries.keys():
            self.entries.removeKey(key)
        for key, e in miner.entries.items():
            if entries.get(key) != (now := [sorted(c) for c in e.classes]):
                self.entries.updateValue(key, (now,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        miner = self._restored()
        clusters = {k: (c.template, c.first, c.rows, tuple(c.members)) for k, c in miner.clusters.items()}
        entries = {k: [sorted(c) for c in e.classes] for k, e in miner.entries.items()}
        lines = pd.concat(rows).sort_values(["LineId", "content"], kind="stable")
        placed: dict[str, int] = {}
        learned, given, moved = -1, [], []
        for line, content in zip(lines["LineId"].tolist(), lines["content"].tolist(), strict=True):
            if learned != miner.learned:  # what was learned may fit a message better than what took it before
                placed, learned = {}, miner.learned
            if content in placed:
                miner.clusters[placed[content]].rows += 1
            else:
                before = len(miner.moves)
                placed[content] = miner.feed(content, line)
                moved += [(line, old, new) for old, new in list(miner.moves.items())[before:]]
            given.append(placed[content])
        self._keep(miner, clusters, entries)
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old[0] if isinstance(old, tuple | list) else old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        out = [("line", line, cid, None, None, None) for line, cid in zip(lines["LineId"].tolist(), given, strict=True)]
        out += [("move", line, old, new, None, None) for line, old, new in moved]
        out += [("cluster", c.first, cid, None, c.template, c.rows) for cid, c in sorted(miner.clusters.items()) if clusters.get(cid) != (c.template, c.first, c.rows, tuple(c.members))]
        yield _version(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.clusters.clear()  # the next id stays, so no id is given twice
        self.entries.clear()
        yield _version(key[0], [("closed", None, None, None, None, None)])

    def close(self) -> None:
        pass


def _version(dataset: str, rows: list[tuple]) -> pd.DataFrame:
    kinds = {"LineId": "Int64", "id": "Int64", "other": "Int64", "lines": "Int64"}
    made = pd.DataFrame(rows, columns=["kind", "LineId", "id", "other", "template", "lines"]).astype(kinds)
    made.insert(1, "dataset", dataset)
    return made


def mine_online(lines: DataFrame, path: str, checkpoint: str, oracle: Oracle | None = None, idle_ms: int | None = None, **trigger) -> StreamingQuery:
    """Start mining a stream of (dataset, LineId, content); each batch's version goes below `path`, written again if the batch is.

    Lines of a dataset are taken in the order of LineId within a batch, and batch
    after batch; empty or null contents, and rows without a dataset or LineId,
    are left out. A batch's lines of one dataset meet in one task: the trigger bounds them.
    idle_ms needs a trigger by processing time, as others would wait for timers without end.
    """
    if idle_ms is not None and "processingTime" not in trigger:
        raise ValueError("idle_ms needs a processingTime trigger")
    src = lines.select(F.col("dataset").cast("string"), F.col("LineId").cast("long"), text.content(F.col("content")).alias("content"))
    src = src.filter("dataset is not null and LineId is not null and content != ''")
    mined = src.groupBy("dataset").transformWithStateInPandas(OnlineMiner(oracle, idle_ms), outputStructType=VERSION, outputMode="Append", timeMode="None" if idle_ms is None else "ProcessingTime")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    conf, (key, provider) = lines.sparkSession.conf, _PROVIDER
    before = conf.get(key)
    conf.set(key, provider)  # a stream takes the settings of its start along
    try:
        return mined.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        conf.set(key, before)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """All that batches left, with the batch."""
    return spark.read.schema(f"{VERSION}, batch int").option("basePath", path).parquet(f"{path}/batch=*")


def resolved(moves: DataFrame, keys: list[str], old: str = "id", new: str = "other") -> DataFrame:
    """(keys, old, new): each id that moved, with the id that it has become in the end, whatever moves lie between.

    An id moves once. Rounds double the way that an id is followed.
    """
    step = checkpoint(moves.select(*keys, F.col(old).alias("old"), F.col(new).alias("new")))
    while True:
        far = step.select(*keys, F.col("old").alias("new"), F.col("new").alias("far"))
        longer = step.join(far, [*keys, "new"], "left")
        if longer.filter("far is not null").isEmpty():
            return step
        step = checkpoint(longer.select(*keys, "old", F.coalesce("far", "new").alias("new")))


def structured(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, LineId, batch, first_id, EventId, EventTemplate): every line with the id that its
    batch gave it, and with its cluster's id and template after all batches."""
    v = versions(spark, path)
    moves = resolved(v.filter("kind = 'move'"), ["dataset"]).select("dataset", F.col("old").alias("first_id"), F.col("new").alias("moved"))
    lines = v.filter("kind = 'line'").select("dataset", "LineId", "batch", F.col("id").alias("first_id"))
    now = lines.join(moves, ["dataset", "first_id"], "left").withColumn("EventId", F.coalesce("moved", "first_id"))
    return now.join(catalog(spark, path).select("dataset", "EventId", "EventTemplate"), ["dataset", "EventId"]).select("dataset", "LineId", "batch", "first_id", "EventId", "EventTemplate")


def catalog(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame:
    """(dataset, EventId, EventTemplate, Occurrences): the clusters after a batch, the last by default."""
    v = versions(spark, path)
    v = v if batch is None else v.filter(F.col("batch") <= batch)
    newest = v.filter("kind = 'cluster'").groupBy("dataset", F.col("id").alias("EventId")).agg(F.max_by(F.struct("template", "lines"), "batch").alias("c"))
    gone = v.filter("kind = 'move'").select("dataset", F.col("id").alias("EventId"))
    return newest.join(gone, ["dataset", "EventId"], "left_anti").select("dataset", "EventId", F.col("c.template").alias("EventTemplate"), F.col("c.lines").alias("Occurrences"))
