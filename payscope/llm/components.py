"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payscope.llm.shared import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is one node of the component.

    Each round hashes the nodes anew, maps every node to the neighbour of least hash (itself included) and
    contracts the graph along that map.  A node whose hash is greater than those of its neighbours is
    nobody's target and vanishes, which on average is a fixed share of the nodes of any graph, so the rounds
    grow with the logarithm of the nodes.  The maps of the rounds are then composed, last to first.  Nothing is
    collected; a hot node is a ``min`` with partial aggregation and joins that adaptive execution may split.
    """
    spark = edges.sparkSession
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        ranked = lambda node: F.struct(F.xxhash64(F.lit(len(maps)), node).alias("rank"), F.col(node).alias("node"))
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min(ranked("b")).alias("m"))
        step = materialize(least.select(F.col("a").alias("node"), F.least(ranked("a"), F.col("m"))["node"].alias("to")), "cc-map")
        maps.append(step)
        ends = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        others = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = edges.join(ends, "a").join(others, "b").where("x <> y")
        edges = materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
    if not maps:
        return spark.range(0).selectExpr("id AS node", "id AS root")
    roots = maps[-1].withColumnRenamed("to", "root")
    for step in reversed(maps[:-1]):
        later = roots.select(F.col("node").alias("to"), "root")
        roots = step.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return roots
