"""Connected components by alternating large and small stars; links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import drop, stored


def _facts(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1_000_003))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node on its smallest one: those above it (large) or below it (small)."""
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = both.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest node.

    Repeated, reversed and self edges are allowed; null ends are ignored. No edges: no rows.
    """
    e = edges.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    e = stored(e.distinct(), "edges")
    before = _facts(e)
    while before[0]:
        e2 = stored(_star(_star(e, True), False), "edges")
        after = _facts(e2)
        drop(e)
        e = e2
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
