"""Distributed connected components of an undirected link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import pin


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest one (or the node itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return (both.join(low, "a").where("b > a").select(F.col("b").alias("x"), "low")
            .select(F.greatest("x", "low").alias("a"), F.least("x", "low").alias("b"))
            .where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them. ``a > b`` in ``edges``."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    down = edges.join(low, "a")
    return (down.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionByName(low.select("a", F.col("low").alias("b"))).distinct())


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links(a, b)`` -> ``(node, component)``: the smallest node id reachable.

    Alternating large-star / small-star rounds. Each round keeps only per-node
    minima (partially aggregated, so a hub's neighbours are never gathered) and
    one skew-splittable join; the link table is written between rounds. Only
    linked nodes are returned; a node without a link is its own component.
    Null ends and self links are ignored; an empty table gives an empty result.
    """
    edges = pin(links.where("a is not null and b is not null and a <> b")
                .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == mark or not now.n:
            break
        mark = (now.n, now.h)
        edges = pin(_small_star(_large_star(edges)), "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())
