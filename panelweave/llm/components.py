"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.storage import materialize

MAX_ROUNDS = 60


def _lowest(pairs: DataFrame) -> DataFrame:
    """Each node with the lowest node of its neighbourhood; combined before the shuffle."""
    return pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_lowest(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = _lowest(down)
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select("a", F.col("low").alias("b"))).where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node with an edge ``(a, b)`` to another.

    ``component`` is the lowest node reachable. Every round goes to the scratch
    folder, so a lost executor costs a re-read; the number of rounds grows with the
    logarithm of the longest path, squared at worst. A hub's edges are joined to one
    row per node, which adaptive execution splits.
    """
    current = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b")
        .distinct(),
        "component-edges",
    )
    seen = None
    for _ in range(MAX_ROUNDS):
        state = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
        ).first()
        if state == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = state
        current = materialize(
            _small_star(_large_star(current).distinct()).distinct(), "component-edges"
        )
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
