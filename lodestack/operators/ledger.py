"""Evidence reconciliation and selection among attempts (SURVEY: R35, J04, J05, P12, P13, G15, W06, W07, V01, V07)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reasons that contradict a proposal; any other reason leaves it unassigned.
CONFLICTS = ("overlap", "duplicate_coordinate")


def reasons(**failing: Column) -> Column:
    """The names of the predicates that hold, as a sorted array."""
    return F.array_sort(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in failing.items()])))


def decide(reason_array: Column, conflicts: Sequence[str] = CONFLICTS) -> Column:
    """accepted without a reason; contradicted if any reason is a conflict, whatever else is wrong; else unassigned."""
    against = F.arrays_overlap(reason_array, F.array(*[F.lit(c) for c in conflicts]))
    return F.when(F.size(reason_array) == 0, "accepted").when(against, "contradicted").otherwise("unassigned")


def best(rows: DataFrame, by: Sequence[str], score: str, order: Sequence[str]) -> DataFrame:
    """The first row with the highest score: a later attempt replaces an earlier one only if it is strictly better."""
    key = F.struct(F.col(score).alias("score"), *[(-F.col(c)).alias(f"o{i}") for i, c in enumerate(order)])
    kept = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*kept), key).alias("top")).select(*by, "top.*")


def first_n(rows: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """At most ``n`` rows of each group."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("nth", nth).where(F.col("nth") <= n)


def reason_counts(rows: DataFrame, column: str, top: int) -> DataFrame:
    """The most frequent reasons."""
    counted = rows.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "reason").limit(top)


def hint(asserted: Column, observed: Column) -> Column:
    """matches, conflicts, or unobserved where either side is unknown."""
    return F.when(asserted.isNull() | observed.isNull(), "unobserved").when(asserted == observed, "matches").otherwise("conflicts")


def precedence() -> Column:
    """Aggregate over findings with the columns corrupt, missing, incomplete and warning: the strongest decides."""
    return (
        F.when(F.bool_or("corrupt"), "reject_corrupt")
        .when(F.bool_or("missing"), "reject_dependencies")
        .when(F.bool_or("incomplete"), "incomplete")
        .when(F.bool_or("warning"), "accept_with_warnings")
        .otherwise("accept")
    )


def running_total(rows: DataFrame, by: Sequence[str], order: Sequence[str], size: str, tile: int) -> DataFrame:
    """``rows`` with ``total``, the sum of ``size`` up to each row in its group.

    The first of ``order`` is a whole number; groups are cut into tiles of it, so that one large group is many tasks, and only the
    sums of tiles are added up over a whole group.
    """
    cut = rows.withColumn("tile", F.floor(F.col(order[0]) / tile))
    ahead = Window.partitionBy(*by).orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*by, "tile").agg(F.sum(size).alias("all"))
    sums = sums.select(*by, "tile", F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*by, "tile").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    told = cut.withColumn("part", F.sum(size).over(inside)).join(sums, [*by, "tile"])
    return told.withColumn("total", F.col("before") + F.col("part")).drop("tile", "part", "before")
