"""Connected components of an edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import discard, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the component's smallest node.

    Large-star and small-star steps alternate until nothing changes. Every step works on edges with partial
    aggregates and joins; neither components nor neighbour lists are collected. The result of a join is dealt anew
    by whole edges, so adaptive execution may split a hub's rows in the join itself. Each round's edges are a
    written table, so a lost executor costs one round at most; the round before is deleted. Loops and repeated edges are
    allowed; edges with a null end are left out, and an empty table has no components.
    """
    state = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    before = None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").repartition("u", "v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        last = state
        state = written(small.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).repartition("u", "v").distinct())
        discard(last)
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
