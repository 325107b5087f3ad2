"""Selections and mapped sources (SURVEY: P02-P04, J15, S23, S25-S27, W11, F26)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: start, stride, count, block of one axis.
Axis = tuple[int, int, int, int]


def normalise(selection: Sequence, shape: Sequence[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """Ranges of each axis, and the axes that an integer takes away. Takes ints (negative ones count from the end), slices with
    step one, and one ellipsis; anything else is refused."""
    items = list(selection)
    if sum(x is Ellipsis for x in items) > 1:
        raise ValueError("more than one ellipsis")
    if Ellipsis in items:
        at = items.index(Ellipsis)
        items[at : at + 1] = [slice(None)] * (len(shape) - len(items) + 1)
    items += [slice(None)] * (len(shape) - len(items))
    if len(items) != len(shape):
        raise ValueError("too many axes")
    ranges, gone = [], []
    for axis, (x, n) in enumerate(zip(items, shape, strict=True)):
        if isinstance(x, bool) or not isinstance(x, int | slice):
            raise TypeError("only ints and slices select")
        if isinstance(x, int):
            i = x + n if x < 0 else x
            if not 0 <= i < n:
                raise IndexError(f"{x} is outside axis {axis}")
            ranges.append((i, i + 1))
            gone.append(axis)
        else:
            if x.step not in (None, 1):
                raise ValueError("only step one")
            start, stop, _ = x.indices(n)
            ranges.append((start, max(start, stop)))
    return ranges, gone


def size(axes: Sequence[Axis]) -> int:
    return reduce(lambda n, a: n * a[2] * a[3], axes, 1)


def check(axes: Sequence[Axis], shape: Sequence[int]) -> None:
    for (start, stride, count, block), n in zip(axes, shape, strict=True):
        if min(start, count, block) < 0 or stride < 1 or count > 1 and block > stride:
            raise ValueError("blocks of a selection overlap")
        if count and block and start + (count - 1) * stride + block > n:
            raise ValueError("a selection leaves its array")


def point(k: Column, axes: Sequence[Axis]) -> list[Column]:
    """The coordinate of the k-th point of a regular hyperslab in row-major order: mixed-radix digits, each origin + repeat *
    stride + within."""
    out, below = [], 1
    for start, stride, count, block in reversed(axes):
        digit = F.floor(k / below).cast("bigint") % max(1, count * block)
        out.append(start + F.floor(digit / max(1, block)).cast("bigint") * stride + digit % max(1, block))
        below *= max(1, count * block)
    return out[::-1]


def rank(coordinate: Sequence[Column], axes: Sequence[Axis]) -> Column:
    """The place of a coordinate in the selection; null where it isn't selected."""
    at, inside = F.lit(0).cast("bigint"), F.lit(True)
    for c, (start, stride, count, block) in zip(coordinate, axes, strict=True):
        away = c - start
        # a single block may be longer than its stride
        repeat = F.floor(away / stride).cast("bigint") if count > 1 else F.when(away >= 0, 0).otherwise(-1).cast("bigint")
        within = away - repeat * stride
        inside = inside & (away >= 0) & (repeat < count) & (within < block)
        at = at * (count * block) + repeat * block + within
    return F.when(inside, at)


def points(spark, axes: Sequence[Axis]) -> DataFrame:
    """All points: k, x0, x1, ..."""
    at = point(F.col("k"), axes)
    return spark.range(size(axes)).withColumnRenamed("id", "k").select("k", *[x.alias(f"x{i}") for i, x in enumerate(at)])


def mapped(spark, mappings: Sequence[tuple[Sequence[Axis], str, Sequence[Axis]]]) -> DataFrame:
    """Virtual points with the source point that stands at the same place of the source's selection: mapping, source, v0, v1, ...,
    s0, s1, ...; no source is read for that."""
    out = None
    for i, (virtual, name, source) in enumerate(mappings):
        if size(virtual) != size(source):
            raise ValueError("the selections of a mapping differ in size")
        k = F.col("id")
        one = spark.range(size(virtual)).select(
            F.lit(i).alias("mapping"),
            F.lit(name).alias("source"),
            *[x.alias(f"v{n}") for n, x in enumerate(point(k, virtual))],
            *[x.alias(f"s{n}") for n, x in enumerate(point(k, source))],
        )
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def overlaps(pairs: DataFrame, on: Sequence[str]) -> DataFrame:
    """Virtual points with more than one mapping; a bounded reader refuses unless there are none."""
    return pairs.groupBy(*on).agg(F.count(F.lit(1)).alias("mappings")).where(F.col("mappings") > 1)


def last_mapping(pairs: DataFrame, on: Sequence[str]) -> DataFrame:
    """The resolver's rule: where mappings overlap, the last one counts."""
    rest = [c for c in pairs.columns if c not in on]
    return pairs.groupBy(*on).agg(F.max_by(F.struct(*rest), "mapping").alias("m")).select(*on, "m.*")


def segment_starts(segments: DataFrame, order: str, length: str, by: Sequence[str]) -> DataFrame:
    """Declared segments with the offset at which each begins in the whole."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("start", F.coalesce(F.sum(length).over(before), F.lit(0)))
