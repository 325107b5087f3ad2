"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where everything runs in one process (a local master) may it be unset; then a temporary folder serves.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="lodestack-"))
    return _own_folder[0]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts the lineage: a lost executor costs the tasks it ran, not what was written before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestack_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote for ``tables``, once nothing will read it again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._lodestack_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bound(value: Column, use) -> Column:
    """``use(value)``, with ``value`` evaluated once a row, however often ``use`` names it and in whatever lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Items that ``running`` folds before it starts a new array.
SLICE_ITEMS = 256


def running(items: Column, state: Column, step, out: str) -> Column:
    """Walk the array ``items`` with a carried ``state``: ``step(state, item)`` gives the next state and the item's output.

    The outputs, of type ``out``, come back as an array. A plain fold would copy its output array for every item; this one
    folds slices, so a million items copy a few hundred each.
    """

    def whole(all_items: Column) -> Column:
        last = F.floor((F.greatest(F.lit(1), F.size(all_items)) - 1) / SLICE_ITEMS).cast("int")
        slices = F.transform(
            F.sequence(F.lit(0), last), lambda k: F.slice(all_items, k * SLICE_ITEMS + 1, F.lit(SLICE_ITEMS))
        )

        def one(s: Column, x: Column) -> Column:
            now, given = step(s["state"], x)
            return F.struct(now.alias("state"), F.concat(s["out"], F.array(given)).alias("out"))

        def part(s: Column, p: Column) -> Column:
            begin = F.struct(s["state"].alias("state"), F.array().cast(f"array<{out}>").alias("out"))
            return bound(
                F.aggregate(p, begin, one),
                lambda r: F.struct(r["state"].alias("state"), F.concat(s["out"], F.array(r["out"])).alias("out")),
            )

        first = F.struct(state.alias("state"), F.array().cast(f"array<array<{out}>>").alias("out"))
        return F.flatten(F.aggregate(slices, first, part)["out"])

    return bound(items, whole)


def give_back() -> None:
    """Return the memory that Arrow and the C library hold but no longer use to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of GNU has it
    if trim:
        trim(0)


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` with a function of this package.

    Python workers outlive their tasks, and what one has freed would stay its own through all later stages; so a task ends by
    giving that back.
    """

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    ship(df.sparkSession)
    return df.mapInArrow(task, schema)


#: Columns that a long array of floats is cut into, so that Spark can sum it piece by piece.
SLICE = 64


def sliced(flat, weight: float = 1.0):
    """A record batch (slice, weight, v0 ... v63) that holds ``flat``."""
    import numpy as np
    import pyarrow as pa

    n = -(-len(flat) // SLICE)
    table = np.zeros((n, SLICE), np.float32)
    table.ravel()[: len(flat)] = flat
    columns = [pa.array(np.ascontiguousarray(table[:, i])) for i in range(SLICE)]
    names = ["slice", "weight", *(f"v{i}" for i in range(SLICE))]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, weight)), *columns], names)


SLICED = "slice int, weight double, " + ", ".join(f"v{i} float" for i in range(SLICE))


def summed(slices: DataFrame, n: int):
    """The sum of the arrays of ``n`` floats that ``slices`` holds, and of their weights; None where there are none."""
    import numpy as np

    names = [f"v{i}" for i in range(SLICE)]
    rows = slices.groupBy("slice").agg(F.sum("weight").alias("weight"), *[F.sum(c).alias(c) for c in names]).toArrow()
    if not rows.num_rows:
        return None
    rows = rows.sort_by("slice")
    return np.stack([rows[c].to_numpy() for c in names], axis=1).ravel()[:n], rows["weight"][0].as_py()
