"""Connected components of an edge table by alternating large and small stars.

Each round rewires every node to the smallest node it knows of, from its larger
and then from its smaller neighbours, until nothing changes; the number of
rounds grows with the logarithm of the longest path. Rounds are written tables,
and only one row, a count and a sum of the edges, comes to the driver: joins are
sort-merge joins, as a broadcast table is built in the driver's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.workspace import regrouped, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges ``a, b`` with a > b. Large: every larger neighbour is tied to the smallest one; small: the node and its smaller neighbours are."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        tied = both.where("v > u").join(regrouped(least, "x").hint("merge"), F.col("u") == F.col("x")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), "m")
        tied = edges.join(regrouped(least, "x").hint("merge"), F.col("a") == F.col("x")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("x").alias("a"), F.col("m").alias("b")))
    return tied.where("a <> b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; the root is the smallest node of its component."""
    state = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    said = None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == said or not now[0]:
            break
        said = now
        state = stored(_star(_star(state, True), False), "edges")
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
