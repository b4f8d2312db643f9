"""Connected components of a link table, without any of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayglass.session import materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (``node``, ``root``) for every linked node; the root is the smallest node reachable.

    Alternates two steps until nothing changes: every node links its larger neighbours
    to its smallest one, then its smaller neighbours to the smallest. Each step is one
    grouped minimum, combined before the shuffle, and one join; each round is written to
    the shared folder, so a lost executor repeats one round at most.
    """
    big, small = F.greatest(a, b).alias("_big"), F.least(a, b).alias("_small")
    edges = materialise(links.where(F.col(a) != F.col(b)).select(big, small).distinct(), "component-links")
    state = _state(edges)
    while True:
        edges = materialise(_pull_smaller(_pull_larger(edges)), "component-links")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("_big").alias("node"), F.col("_small").alias("root")).unionByName(
        edges.select(F.col("_small").alias("node"), F.col("_small").alias("root")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    """Row count and an order-free digest: equal when the edges are."""
    mixed = F.xxhash64("_big", "_small").cast("decimal(20,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mixed), F.sum(F.abs(mixed))).first())


def _pull_larger(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("_big").alias("_at"), F.col("_small").alias("_to")).unionByName(
        edges.select(F.col("_small").alias("_at"), F.col("_big").alias("_to"))
    )
    least = both.groupBy("_at").agg(F.least(F.min("_to"), F.col("_at")).alias("_least"))
    larger = both.where(F.col("_to") > F.col("_at")).join(least, "_at")
    return larger.select(F.col("_to").alias("_big"), F.col("_least").alias("_small")).distinct()


def _pull_smaller(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("_big").agg(F.min("_small").alias("_least"))
    moved = edges.join(least, "_big").where(F.col("_small") != F.col("_least"))
    return (
        moved.select(F.col("_small").alias("_big"), F.col("_least").alias("_small"))
        .unionByName(least.select("_big", F.col("_least").alias("_small")))
        .distinct()
    )
