"""Connected components of a link table, by alternating star contraction.

Every round is a handful of joins and aggregations; no links ever reach the
driver. A hub of the graph is one key of an aggregation with map-side combine
and of a join. The aggregate is checkpointed before it is joined, so that both
sides of the join are plain exchanges and adaptive execution may split the hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import checkpoint


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) long links -> (node, root): root is the smallest node of the component.

    Only nodes with a link to another node appear. Null ends and loops are left
    out; repeated links count once; an empty table gives an empty result.
    """
    e = edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = checkpoint(e)
    before = _fingerprint(e)
    for _ in range(rounds):
        if before[0] == 0:
            break
        # large star: every larger neighbour of u goes to the smallest node around u
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # small star: the smaller neighbours of u, and u, go to the smallest of them
        large = checkpoint(large)
        least = checkpoint(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = checkpoint(small.filter("u != v").distinct())
        after = _fingerprint(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
