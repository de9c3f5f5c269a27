"""Online mining with state: the stream against one ordered pass, through restarts, moves and closed datasets."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from logloom.operators.mine import Miner, mine_exact
from logloom.streaming import online


def log(seed, n):
    """Lines of two datasets whose statements widen, and are taken in by later ones."""
    rnd = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta"]
    said = [
        lambda k: f"{rnd.choice(words)} {rnd.choice(words)} stored",
        lambda k: f"job {k} done in {rnd.randint(1, 9)} ms",
        lambda k: f"user {rnd.choice(words)} logged {rnd.choice(['in', 'out'])}",
        lambda k: f"{rnd.choice(words)}: {k}",
    ]
    late = [lambda k: f"{k} {k + 1} stored", lambda k: f"user 7{k} logged in", lambda k: f"{k}:{k}", lambda k: "user x logged in 1 2"]
    return [(rnd.choice("AB"), k, rnd.choice(said + (late if k > n // 2 else []))(k)) for k in range(n)]


def passed(lines):
    """What the ordered pass makes of a dataset's lines: first ids, final ids and templates."""
    miner, first = Miner(), []
    for k, content in lines:
        first.append((k, miner.feed(content, k)))
    return {k: (cid, miner.root(cid), miner.clusters[miner.root(cid)].template) for k, cid in first}, miner


def in_batches(spark, folder, rows, cuts, **options):
    df = spark.createDataFrame(rows, "dataset string, LineId long, content string")
    for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        df.filter((F.col("LineId") >= lo) & (F.col("LineId") < hi)).repartition(2).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
        online.mine_online(stream, f"{folder}/out", f"{folder}/checkpoint", **options).awaitTermination()
    return f"{folder}/out"


@pytest.mark.parametrize("seed, cuts", [(1, [60, 61, 150]), (2, [110])])
def test_stream_equals_one_ordered_pass(spark, tmp_path, seed, cuts):
    rows = log(seed, 220)
    path = in_batches(spark, tmp_path, [*rows, ("A", 500, ""), ("A", 501, None), (None, 502, "x")], cuts)
    got = {(r["dataset"], r["LineId"]): r for r in online.structured(spark, path).collect()}
    assert len(got) == len(rows)
    moved = 0
    for dataset in "AB":
        want, miner = passed([(k, c) for d, k, c in rows if d == dataset])
        assert {k: (r["first_id"], r["EventId"], r["EventTemplate"]) for (d, k), r in got.items() if d == dataset} == want
        catalog = {r["EventId"]: (r["EventTemplate"], r["Occurrences"]) for r in online.catalog(spark, path).filter(F.col("dataset") == dataset).collect()}
        assert catalog == {cid: (c.template, c.rows) for cid, c in miner.clusters.items()}
        moved += sum(a != b for a, b, _ in want.values())
    assert moved > 0


def test_moves_of_moves(spark):
    moves = spark.createDataFrame([("a", k, k + 1) for k in range(9)] + [("b", 3, 1)], "d string, id long, other long")
    got = {(r["d"], r["old"]): r["new"] for r in online.resolved(moves, ["d"]).collect()}
    assert got == {("a", k): 9 for k in range(9)} | {("b", 3): 1}
    assert online.resolved(moves.limit(0), ["d"]).count() == 0


def test_a_restored_miner_goes_on_as_the_first_would(spark):
    lines = [(k, c) for _, k, c in log(3, 200)]
    want, whole = passed(lines)
    first = Miner()
    for k, c in lines[:90]:
        first.feed(c, k)
    second = Miner()
    second.restore(first.clusters, list(first.entries.values()), first.next_id)
    for k, c in lines[90:]:
        assert second.feed(c, k) == want[k][0]
    assert {i: c.template for i, c in second.clusters.items()} == {i: c.template for i, c in whole.clusters.items()}


def test_idle_datasets_are_closed():
    """The processor by itself: a timer is set anew by lines, and its end drops clusters but not the next id."""

    class Value:
        def __init__(self):
            self.v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

    class Map(dict):
        def iterator(self):
            return iter(self.items())

        def updateValue(self, k, v):
            self[tuple(k)] = v

        def removeKey(self, k):
            self.pop(tuple(k))

    class Handle:
        def __init__(self):
            self.timers = []

        def getValueState(self, *a):
            return Value()

        def getMapState(self, *a):
            return Map()

        def listTimers(self):
            return [(t,) for t in self.timers]

        def deleteTimer(self, t):
            self.timers.remove(t)

        def registerTimer(self, t):
            self.timers.append(t)

    class Now:
        def __init__(self, t):
            self.t = t

        def getCurrentProcessingTimeInMs(self):
            return self.t

    p, handle = online.OnlineMiner(idle_ms=100), Handle()
    p.init(handle)
    batch = lambda *c: iter([pd.DataFrame({"LineId": range(len(c)), "content": c})])
    list(p.handleInputRows(("d",), batch("a 1", "b 2"), Now(1000)))
    out = pd.concat(p.handleInputRows(("d",), batch("a 3"), Now(1050)))
    assert handle.timers == [1150] and out[out["kind"] == "line"]["id"].tolist() == [0]
    assert pd.concat(p.handleExpiredTimer(("d",), Now(1150), None))["kind"].tolist() == ["closed"]
    out = pd.concat(p.handleInputRows(("d",), batch("a 4"), Now(2000)))
    assert out[out["kind"] == "line"]["id"].tolist() == [2]


def test_idle_needs_processing_time(spark, tmp_path):
    with pytest.raises(ValueError):
        online.mine_online(spark.createDataFrame([], "dataset string, LineId long, content string"), str(tmp_path), str(tmp_path), idle_ms=5)


def test_mine_exact_by_dataset(spark):
    """Each dataset is mined by itself on an executor, as the miner alone would."""
    rows = log(4, 200)
    df = spark.createDataFrame([*rows, ("C", 900, None), (None, 901, "x 1")], "dataset string, LineId long, content string").repartition(3)
    structured, catalog = mine_exact(df, by=["dataset"])
    got = {r["LineId"]: (r["EventId"], r["EventTemplate"]) for r in structured.collect()}
    assert len(got) == len(rows) + 2 and got[901] == (0, "x <*>")
    for dataset in "AB":
        lines = [(k, c) for d, k, c in rows if d == dataset]
        from logloom.functions import align

        masks = {}
        for k, c in lines:
            masks.setdefault(" ".join(align.WILD if any(ch in "0123456789" for ch in w) else w for w in c.split(" ")), (k, c))
        at, miner = passed(masks.values())
        order = {cid: n for n, (cid, _) in enumerate(sorted(miner.clusters.items(), key=lambda x: x[1].first))}
        for k, c in masks.values():
            assert got[k] == (order[at[k][1]], at[k][2])
        assert sum(r["Occurrences"] for r in catalog.filter(F.col("dataset") == dataset).collect()) == len(lines)
    with pytest.raises(ValueError):
        mine_exact(df, most=3)
