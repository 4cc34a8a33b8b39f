"""Chains, rings and forests over rows, by pointer jumping: each round doubles how far a row sees, so a chain of n rows takes about log2(n) rounds, each a join and a staged table.

`links` has node and next. A node is the next of one other at most, so no join key is hot, and rows that have seen the end don't take part in the joins.
Forests (node, parent; null at a top) may have hot parents: sums are aggregated before they are exchanged, and the joins are plain ones that adaptive execution splits.
Nodes whose parent isn't a node, or that hang on a ring, have no top and are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage


def list_rank(links: DataFrame, value: str | None = None) -> DataFrame:
    """node, after (the sum of `value` over the rows that follow it in its chain, or their number), last (the chain's last node). next is null at a chain's end; a ring is an error."""
    own = (F.col(value) if value else F.lit(1)).cast("long")
    rows = stage(links.select("node", "next", own.alias("own")), "links")
    ahead = rows.select(F.col("node").alias("n"), F.col("own").alias("after"))
    ends = rows.where("next IS NULL").select("node", "next", F.lit(0).cast("long").alias("after"), F.col("node").alias("last"))
    state = rows.where("next IS NOT NULL").join(ahead, F.col("next") == F.col("n")).select("node", "next", "after", F.col("next").alias("last")).unionByName(ends)
    for _ in range(rows.count().bit_length() + 2):
        state = stage(state, "chains")
        going = state.where("next IS NOT NULL")
        if going.isEmpty():
            return state.select("node", "after", "last")
        seen = state.select(F.col("node").alias("n"), F.col("next").alias("next2"), F.col("after").alias("after2"), F.col("last").alias("last2"))
        met = going.join(seen, F.col("next") == F.col("n"))
        state = met.select("node", F.col("next2").alias("next"), (F.col("after") + F.col("after2")).alias("after"), F.col("last2").alias("last")).unionByName(state.where("next IS NULL"))
    raise ValueError("rows follow each other in a ring")


def ring_heads(links: DataFrame) -> DataFrame:
    """node, next, head (the ring's least node) of rows that all lie in rings: every node has a next and is one."""
    state = stage(links.select("node", "next", F.col("next").alias("jump"), F.least("node", "next").alias("head")), "rings")
    while True:
        seen = state.select(F.col("node").alias("n"), F.col("jump").alias("jump2"), F.col("head").alias("head2"))
        met = state.join(seen, F.col("jump") == F.col("n")).withColumn("less", F.col("head2") < F.col("head"))
        after = stage(met.select("node", "next", F.col("jump2").alias("jump"), F.least("head", "head2").alias("head"), "less"), "rings")
        if after.where("less").isEmpty():  # each node's window begins where another ends, so equal minima are the ring's
            return after.select("node", "next", "head")
        state = after.drop("less")


def ring_order(links: DataFrame) -> DataFrame:
    """node, head, seq: the place of each node in its ring, counted from the least."""
    rings = ring_heads(links)
    opened = rings.select("node", F.when(F.col("next") != F.col("head"), F.col("next")).alias("next"))
    ranked = list_rank(opened).select("node", "after")
    whole = ranked.select(F.col("node").alias("head"), F.col("after").alias("size"))
    return rings.select("node", "head").join(ranked, "node").join(whole, "head").select("node", "head", (F.col("size") - F.col("after")).alias("seq"))


def _jump(state: DataFrame, change: list) -> DataFrame:
    """One round: each going row meets the row it sees furthest (columns with 2); `change` are the columns of what it becomes."""
    going, ended = state.where("jump IS NOT NULL"), state.where("jump IS NULL")
    seen = state.select(*[F.col(c).alias(f"{c}2") for c in state.columns])
    return going.join(seen, F.col("jump") == F.col("node2")).select(*change).unionByName(ended)


def forest_sums(tree: DataFrame, values: list[str]) -> DataFrame:
    """node and each of `values` as its sum over the node and all that is below it."""
    state = stage(tree.select("node", F.col("parent").alias("jump"), *[F.col(v).cast("long").alias(v) for v in values]), "forest")
    for _ in range(state.count().bit_length() + 1):
        going = state.where("jump IS NOT NULL")
        if going.isEmpty():
            break
        given = going.groupBy(F.col("jump").alias("to")).agg(*[F.sum(v).alias(f"{v}_more") for v in values])
        moved = _jump(state, ["node", F.col("jump2").alias("jump"), *values]).join(given, F.col("node") == F.col("to"), "left")
        state = stage(moved.select("node", "jump", *[(F.col(v) + F.coalesce(f"{v}_more", F.lit(0))).alias(v) for v in values]), "forest")
    return state.where("jump IS NULL").select("node", *values)


def forest_walk(tree: DataFrame, sums: list[str], nearest: list[str]) -> DataFrame:
    """node, top, each of `sums` as its sum on the way from the top to the node, each of `nearest` as the first value on the way up that isn't null."""
    state = stage(tree.select("node", F.col("parent").alias("jump"), F.coalesce("parent", "node").alias("top"), *[F.col(v).cast("long").alias(v) for v in sums], *nearest), "forest")
    change = ["node", F.col("jump2").alias("jump"), F.col("top2").alias("top"), *[(F.col(v) + F.col(f"{v}2")).alias(v) for v in sums], *[F.coalesce(v, f"{v}2").alias(v) for v in nearest]]
    for _ in range(state.count().bit_length() + 1):
        if state.where("jump IS NOT NULL").isEmpty():
            break
        state = stage(_jump(state, change), "forest")
    return state.where("jump IS NULL").select("node", "top", *sums, *nearest)
