"""Half-open intervals: overlap, union, runs, coverage, range joins (SURVEY: J01-J04, J17, J19, G13, G14, S20, S23, W01-W05)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlapping(extents: DataFrame, by: Sequence[str], order: Sequence[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """Extents that begin before the furthest end among those sorted before them. The running maximum sees nested extents, too."""
    before = Window.partitionBy(*by).orderBy(start, *order).rowsBetween(Window.unboundedPreceding, -1)
    return extents.withColumn("reach", F.max(stop).over(before)).where(F.col("reach") > F.col(start)).drop("reach")


def union(extents: DataFrame, by: Sequence[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """Merged extents. They merge only if they share bytes: touching ones stay apart. Exact repeats are dropped first,
    which combines before the shuffle."""
    extents = extents.groupBy(*by, start, stop).agg(F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy(*by).orderBy(start, stop)
    reach = F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) >= reach), 1).otherwise(0)
    return (
        extents.withColumn("fresh", fresh)
        .withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*by, "island")
        .agg(F.min(start).alias(start), F.max(stop).alias(stop), F.sum("copies").alias("members"))
        .drop("island")
    )


def runs(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Maximal runs of equal values: columns ``by``, value, run, n and the first and last of each order column."""
    all_rows = Window.partitionBy(*by).orderBy(*order)
    same = Window.partitionBy(*by, value).orderBy(*order)
    numbered = rows.withColumn("run", F.row_number().over(all_rows) - F.row_number().over(same))
    ends = [f(c).alias(f"{n}_{c}") for c in order for n, f in (("first", F.min), ("last", F.max))]
    return numbered.groupBy(*by, value, "run").agg(F.count(F.lit(1)).alias("n"), *ends)


def _buckets(df: DataFrame, start: str, stop: str, width: int) -> DataFrame:
    first = F.floor(F.col(start) / width)
    last = F.floor((F.greatest(F.col(stop), F.col(start) + 1) - 1) / width)
    return df.withColumn("bucket", F.explode(F.sequence(first, last)))


def range_join(left: DataFrame, right: DataFrame, width: int, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of extents (l_start, l_stop) and (r_start, r_stop) that share a byte.

    Both sides go to the buckets of ``width`` they touch, so the join has an equality key; a pair is kept only in the bucket
    where the later one starts, so it appears once. ``width`` should be near the usual length: shorter makes copies,
    longer makes candidates.
    """
    a = _buckets(left, "l_start", "l_stop", width)
    b = _buckets(right, "r_start", "r_stop", width)
    met = a.join(b, [*by, "bucket"]).where(
        (F.col("l_start") < F.col("r_stop"))
        & (F.col("r_start") < F.col("l_stop"))
        & (F.col("bucket") == F.floor(F.greatest("l_start", "r_start") / width))
    )
    return met.drop("bucket")


def holders(points: DataFrame, segments: DataFrame, at: str, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of a point and a segment (r_start, r_stop) that holds it, however long segments are.

    A segment goes to the least of the bucket sizes 2^8, 2^12, ... 2^60 at which it touches two buckets at most, so its copies don't
    grow with its length; at the largest size it may touch 16. A point gets a copy for each size in use, 14 at most.
    """
    touched = lambda c, bits: F.call_function("shiftright", c, bits)
    last = F.col("r_stop") - 1
    more = [(touched(last, F.lit(b)) - touched(F.col("r_start"), F.lit(b)) > 1).cast("int") * 4 for b in range(8, 60, 4)]
    sized = segments.where(F.col("r_start") < F.col("r_stop")).withColumn("bits", sum(more, F.lit(8)))
    ends = [touched(c, F.col("bits")) for c in (F.col("r_start"), last)]
    b = sized.withColumn("bucket", F.explode(F.sequence(*ends)))
    a = points.withColumn("sizes", sized.agg(F.collect_set("bits")).scalar()).withColumn("bits", F.explode("sizes")).drop("sizes")
    a = a.withColumn("bucket", touched(F.col(at), F.col("bits")))
    met = a.join(b, [*by, "bits", "bucket"]).where((F.col(at) >= F.col("r_start")) & (F.col(at) < F.col("r_stop")))
    return met.drop("bits", "bucket")


def covered(updates: DataFrame, extents: DataFrame, by: Sequence[str], key: Sequence[str], width: int) -> DataFrame:
    """Each update with whether one island of the union of ``extents`` holds all of it."""
    islands = union(extents, by).select(*by, F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))
    left = updates.withColumnsRenamed({"start": "l_start", "stop": "l_stop"})
    inside = (
        range_join(left, islands, width, by)
        .where((F.col("r_start") <= F.col("l_start")) & (F.col("l_stop") <= F.col("r_stop")))
        .select(*key)
        .distinct()
        .withColumn("covered", F.lit(True))
    )
    return updates.join(inside, list(key), "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def split_members(extents: DataFrame, size: int) -> DataFrame:
    """Extents cut at multiples of ``size``: member, offset in it, and length of each part."""
    cut = _buckets(extents, "start", "stop", size).withColumnRenamed("bucket", "member")
    low = F.greatest(F.col("start"), F.col("member") * size)
    high = F.least(F.col("stop"), (F.col("member") + 1) * size)
    return cut.withColumn("offset", low - F.col("member") * size).withColumn("length", high - low)


def wholly_present(elements: DataFrame, segments: DataFrame, key: Sequence[str], size: int) -> DataFrame:
    """Each element with whether all its bytes stand in present segments of ``size`` bytes (column ``segment``)."""
    parts = split_members(elements, size)
    found = parts.join(segments.select(F.col("segment").alias("member"), F.lit(1).alias("here")), "member", "left")
    return found.groupBy(*key).agg((F.sum(F.coalesce("here", F.lit(0))) == F.count(F.lit(1))).alias("valid"))


def not_increasing(rows: DataFrame, by: Sequence[str], order: Sequence[str], key: str) -> DataFrame:
    """Rows whose key isn't above the one before it."""
    before = F.lag(key).over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("before", before).where(F.col(key) <= F.col("before"))


def gaps(keys: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Places where keys are missing, with the neighbours on both sides."""
    after = F.lead(key).over(Window.partitionBy(*by).orderBy(key))
    return keys.select(*by, F.col(key).alias("left_key"), after.alias("right_key")).where(
        F.col("right_key") - F.col("left_key") > 1
    )
