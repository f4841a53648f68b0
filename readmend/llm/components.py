"""Connected components by alternating large-star and small-star, with DataFrames.

Large-star links every larger neighbour of a node to the least of its neighbours; small-star
links the smaller neighbours, and the node, to the least of them. When nothing changes any
more, each component is a star around its least node. Every round is a stored table.
Joins meet on a node: a hub's rows are dealt anew by the adaptive skew join, and sums are
taken in the map tasks first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readmend.llm.common import stored

MAX_ROUNDS = 60


def _to_least(edges: DataFrame) -> DataFrame:
    """(u, v, least): the least of u and its neighbours beside each edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("near"))
    return edges.join(least, "u").withColumn("least", F.least("u", "near"))


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """`edges` have v < u."""
    near = _to_least(edges)
    return (near.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
            .union(near.select("u", F.col("least").alias("v"))).distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of an edge (u, v); the component is its least
    node. Loops, repeated edges and edges with a null are harmless."""
    now = stored(edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def mark(df):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

    was = mark(now)
    for _ in range(MAX_ROUNDS):
        if not was[0]:
            break
        now = stored(small_star(large_star(now)), "edges")
        if (new := mark(now)) == was:
            break
        was = new
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(now.select(F.col("v"), F.col("v")).distinct())
