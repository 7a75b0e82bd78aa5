"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import release, stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is one node of the component.

    Each round draws new random ranks, lets every node point to the lowest rank among itself and its
    neighbours, and contracts the graph along the pointers; the edges left fall by a constant factor
    in expectation, whatever the shape.  All steps are joins and minimum aggregations.
    """
    left = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    at = stage(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "components")
    turn = 0
    while left.take(1):
        turn += 1
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.xxhash64(F.col(c), F.lit(turn))  # noqa: B023, E731
        low = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("v"))).alias("m"))
        to = stage(low.select(F.col("a").alias("old"), F.when(F.col("m.r") < rank("a"), F.col("m.v")).otherwise(F.col("a")).alias("new")), "pointers")
        moved = at.join(to, at["component"] == to["old"], "left").select("node", F.coalesce("new", "component").alias("component"))
        fewer = (
            left.join(to, left["a"] == to["old"]).select(F.col("new").alias("a"), "b")
            .join(to.withColumnRenamed("new", "other"), F.col("b") == F.col("old")).select(F.least("a", "other").alias("a"), F.greatest("a", "other").alias("b"))
            .where("a <> b").distinct()
        )
        then_at, then_left = stage(moved, "components"), stage(fewer, "edges")
        release(at, left, to)
        at, left = then_at, then_left
    release(left)
    return at
