"""Connected components of a large set of links, with joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of the component) for every node of `links` (a long, b long).

    Alternates large-star and small-star steps: in a large-star step every node links its larger neighbours to its smallest one, in a
    small-star step the smaller ones. Each step is an aggregate with a combiner (the smallest neighbour) and an equi-join on the node that Spark may split, so a
    node with very many neighbours isn't gathered. Each round is written to the shared folder; chains halve, so rounds grow with the
    logarithm of the longest path. It ends when a round leaves the links as they were.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = _sum(edges)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        edges = stage(_small_star(_large_star(edges)), "links")
        now = _sum(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """(a > b) in, (a > b) out: neighbours larger than a node link to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).select(F.col("a").alias("u"), "m")
    moved = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Neighbours not larger than a node, and the node itself, link to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    moved = edges.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
