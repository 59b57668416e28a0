"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """edges (a, b), a > b: each a moves to the smallest neighbour of b, found with one partial aggregation."""
    least = edges.groupBy(F.col("b").alias("v")).agg(F.min("b").alias("m"))
    least = least.unionByName(edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))).groupBy("v").agg(F.min("m").alias("m"))
    least = least.where("m < v")
    return edges.join(least, edges.b == least.v, "left").select("a", F.coalesce("m", "b").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex and its smaller neighbours move to the smallest of those."""
    least = edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
    moved = edges.join(least, edges.a == least.v).select(F.col("b").alias("a"), F.col("m").alias("b"))
    kept = least.select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(kept).where("a > b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars around their smallest vertices: each end has one edge, and no centre is an end."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("n")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("n")))
    return ends.groupBy("v").agg(F.sum("n").alias("n"), F.min("n").alias("centre")).where("n > 1 or n = 1 and centre = 0").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(vertex, component): component is the smallest vertex reachable. Vertices without links, and null ends, are absent.

    links may hold repeated rows, loops and either direction; an empty table gives an empty result.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = cut(links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())
    for _ in range(rounds):
        if _settled(edges):
            break
        edges = cut(_small_star(_large_star(edges)))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("b").alias("vertex")).distinct()
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(roots.select("vertex", F.col("vertex").alias("component")))
