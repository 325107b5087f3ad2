"""Link graphs: reachability, aliases, link counts, deferred references (SURVEY: J12, J13, J18, J20, R27, S28)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reachable(links: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Nodes with their least depth from any root. One join a level, and what was seen before is taken out, so cycles end.

    ``links``: source, target; ``roots``: node. The driver sees only whether a level is empty. The walk goes on until one is; with
    ``max_depth`` it raises if there are deeper nodes, as they may not be left out in silence.
    """
    links = links.select("source", "target").distinct().persist()
    frontier = roots.select("node").distinct().withColumn("depth", F.lit(0)).persist()
    seen, depth = frontier, 0
    while True:
        depth += 1
        met = frontier.join(links, frontier["node"] == links["source"])
        step = met.select(F.col("target").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        step = step.withColumn("depth", F.lit(depth)).persist()
        if step.isEmpty():
            return seen
        if max_depth is not None and depth > max_depth:
            raise ValueError(f"there are nodes deeper than {max_depth}")
        seen, frontier = seen.unionByName(step), step


def primary(paths: DataFrame, identity: Sequence[str], path: str) -> DataFrame:
    """Each path with the primary (least) one of the same identity, and whether it is an alias."""
    least = F.min(path).over(Window.partitionBy(*identity))
    return paths.withColumn("primary", least).withColumn("alias", F.col(path) != F.col("primary"))


def over_linked(links: DataFrame, declared: DataFrame, target: str, count: str) -> DataFrame:
    """Objects with more links than their header declares."""
    seen = links.groupBy(target).agg(F.count(F.lit(1)).alias("observed"))
    return seen.join(declared, target).where(F.col("observed") > F.col(count))


def resolve(references: DataFrame, targets: DataFrame, on: Sequence[str], missing: int = 4) -> DataFrame:
    """References with status 1 where their target exists and ``missing`` elsewhere."""
    have = targets.select(*on).distinct().withColumn("here", F.lit(1))
    return references.join(have, list(on), "left").withColumn("status", F.coalesce("here", F.lit(missing))).drop("here")
