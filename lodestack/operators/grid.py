"""Chunk grids, hyperslabs and masked projection (SURVEY: F01, F02, G18, P02-P07, J16, G01-G03)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCEPTED = 1


def chunk_of(index: Column | str, chunk: int) -> Column:
    """The chunk number of an element index."""
    index = F.col(index) if isinstance(index, str) else index
    return F.floor(index / chunk).cast("bigint")


def cardinality(shape: Sequence[int], chunks: Sequence[int]) -> int:
    """How many chunks a grid has."""
    return reduce(lambda n, x: n * -(-x[0] // x[1]), zip(shape, chunks, strict=True), 1)


def linear(coords: Sequence[Column], sizes: Sequence[int]) -> Column:
    """Row-major rank of a coordinate."""
    return reduce(lambda at, x: at * x[1] + x[0], zip(coords, sizes, strict=True), F.lit(0).cast("bigint"))


def coordinates(rank: Column, sizes: Sequence[int]) -> list[Column]:
    """The coordinate of a row-major rank."""
    out, stride = [], 1
    for size in reversed(sizes):
        out.append(F.floor(rank / stride).cast("bigint") % size)
        stride *= size
    return out[::-1]


def grid(spark, shape: Sequence[int], chunks: Sequence[int]) -> DataFrame:
    """All chunks of a grid: rank, c0, c1, ... and the elements of each (edge chunks are cropped)."""
    sizes = [-(-d // c) for d, c in zip(shape, chunks, strict=True)]
    base = spark.range(cardinality(shape, chunks)).withColumnRenamed("id", "rank")
    at = coordinates(F.col("rank"), sizes)
    held = [F.least(F.lit(c), F.lit(d) - x * c) for d, c, x in zip(shape, chunks, at, strict=True)]
    return base.select(
        "rank",
        *[x.alias(f"c{i}") for i, x in enumerate(at)],
        reduce(lambda a, b: a * b, held, F.lit(1)).cast("bigint").alias("elements"),
    )


def long_form(df: DataFrame, index: str, array: str) -> DataFrame:
    """A table of rank-one arrays as the elements of a rank-two array: i0, i1, value."""
    return df.select(F.col(index).cast("bigint").alias("i0"), F.posexplode(array).alias("i1", "value")).withColumn(
        "i1", F.col("i1").cast("bigint")
    )


def hyperslab(elements: DataFrame, **ranges: tuple[int, int]) -> DataFrame:
    """Elements whose named indexes are within half-open ranges."""
    for name, (start, stop) in ranges.items():
        elements = elements.where((F.col(name) >= start) & (F.col(name) < stop))
    return elements


def masked(value: Column, status: Column) -> Column:
    """The value where the status is accepted, else null; never a fill value."""
    return F.when(status == ACCEPTED, value)


def undeclared(status: DataFrame, codes: Sequence[int], column: str = "status") -> DataFrame:
    """Rows whose status code isn't declared; a reader refuses its input unless there are none."""
    return status.where(~F.coalesce(F.col(column).isin(*codes), F.lit(False)))


def expand(elements: DataFrame, chunk_status: DataFrame, on: Sequence[str]) -> DataFrame:
    """Each element with its chunk's status; 0 where the chunk has none. A join on the chunk's coordinate."""
    return elements.join(chunk_status, list(on), "left").withColumn("status", F.coalesce("status", F.lit(0)))


def outcome(status: Column) -> Column:
    """Aggregate: complete when every unit is accepted, else partial."""
    return F.when(F.bool_and(status == ACCEPTED), "complete").otherwise("partial")
