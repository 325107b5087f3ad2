"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label the nodes of an undirected graph with the smallest node of their component.

    ``edges`` has columns ``a`` and ``b`` (bigint, any order; loops and repeats are ignored). Returns ``node``,
    ``root`` for every node with a link to another one. No edges give no rows. Each round shuffles what is left of the edges
    twice and is written to the shared folder; only a count and a checksum reach the driver. A node with very many
    links is aggregated before it is shuffled, and the joins are plain ones. What a round wrote is deleted when the next one has been
    written.
    """
    now = materialise(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    seen = _signature(now)
    if not seen[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours move to the smallest neighbour
        large = (
            both.join(low, "a")
            .where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where(F.col("a") != F.col("b"))
            .distinct()
        )
        large = materialise(large, "large-star")
        # small star: smaller neighbours, and the node itself, move to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .where(F.col("a") != F.col("b"))
            .distinct()
        )
        before, now = now, materialise(small, "small-star")
        release(before, large)
        after = _signature(now)
        if after == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
