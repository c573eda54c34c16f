"""Connected components by alternating large-star and small-star passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut_small


def _star(e: DataFrame, large: bool) -> DataFrame:
    """One pass over undirected edges (u > v)."""
    if large:
        near = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = near.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        out = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def _settled(e: DataFrame) -> bool:
    """Whether every node is either a centre or on one edge to a centre: no pass changes such edges, and any others it does."""
    ends = e.select(F.col("u").alias("id"), F.lit(1).alias("up")).union(e.select(F.col("v").alias("id"), F.lit(0).alias("up")))
    nodes = ends.groupBy("id").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return not nodes.agg(F.max((F.col("up") > 1) | (F.col("up") > F.col("least")))).first()[0]


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """``(id, component)`` for every node on an edge; component is the smallest id reachable.

    Edges stay distributed; each round is checkpointed to the shared folder. A node of high
    degree costs one partially aggregated minimum and one join that AQE may split.
    Empty edges give an empty result; nulls and self-loops are ignored.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).filter("u > v").distinct()
    e = cut_small(e)
    for _ in range(most):
        if _settled(e):
            break
        e = cut_small(_star(_star(e, True), False))
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
