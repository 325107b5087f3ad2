"""The public interface (SURVEY: U01, U02, K01, K12, V01-V05, X16, W06, K16).

    got = recover(spark, "/data/*.h5", dataset="/measurements")
    publish(got, "/results/run1")
    verify(spark, "/results/run1").where("not passed")
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import ledger, selection
from .session import ship
from .sources import arrays

#: Status names that a result may hold.
STATUSES = ("accepted", "unknown", "unavailable", "truncated", "decode_failed", "decoder_unavailable")


@dataclass
class Recovery:
    """values (file, path, index, value, status), units (a row for each chunk), datasets (also what was refused, and why)."""

    values: DataFrame
    units: DataFrame
    datasets: DataFrame


def recover(spark: SparkSession, path: str, dataset: str | None = None) -> Recovery:
    """Read containers; values only where the bytes prove them. ``dataset``: an absolute path, else all."""
    if dataset is not None and (not dataset.startswith("/") or "//" in dataset or "/../" in dataset + "/"):
        raise ValueError("a dataset path is absolute and canonical")
    ship(spark)
    src = arrays.files(spark, path)
    described, units = arrays.datasets(src), arrays.chunks(src)
    if dataset is not None:
        described, units = described.where(F.col("path") == dataset), units.where(F.col("path") == dataset)
    return Recovery(arrays.values(units, described), units, described)


def coverage(values: DataFrame) -> DataFrame:
    """Elements by file and dataset: total, accepted, and whether all are."""
    ok = F.col("status") == "accepted"
    return values.groupBy("file", "path").agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(ok, 1)).alias("accepted"),
        F.when(F.bool_and(ok), "complete").otherwise("partial").alias("outcome"),
    )


def read_masked(values: DataFrame, shape: Sequence[int], chosen: Sequence) -> DataFrame:
    """A slice of one dataset's values: x0, x1, ... (axes taken by an int are dropped) and value, null unless accepted. A status
    that isn't declared masks, as anything but accepted does."""
    ranges, gone = selection.normalise(chosen, shape)
    at, below = [], 1
    for n in reversed(shape):
        at.append(F.floor(F.col("index") / below).cast("bigint") % max(1, n))
        below *= max(1, n)
    at = at[::-1]
    inside = F.lit(True)
    for x, (start, stop) in zip(at, ranges, strict=True):
        inside = inside & (x >= start) & (x < stop)
    kept = [(x - r[0]).alias(f"x{i}") for i, (x, r) in enumerate(zip(at, ranges, strict=True)) if i not in gone]
    return values.where(inside).select(*kept, F.when(F.col("status") == "accepted", F.col("value")).alias("value"))


def publish(got: Recovery, path: str) -> None:
    """Write values, units and report. Nothing is overwritten; the report comes last, so a folder without one isn't a result."""
    spark = got.values.sparkSession
    got.values.write.mode("errorifexists").partitionBy("path").parquet(f"{path}/values")
    digests = got.units.select(
        "file", "path", "origin", "offset", "size", "status", F.when(F.col("status") == "accepted", F.sha2("data", 256)).alias("sha256")
    )
    digests.write.mode("errorifexists").parquet(f"{path}/units")
    got.datasets.write.mode("errorifexists").parquet(f"{path}/datasets")
    coverage(spark.read.parquet(f"{path}/values")).coalesce(1).write.mode("errorifexists").json(f"{path}/report")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """A row for each check of a published result: file, path, check, passed."""
    values = spark.read.parquet(f"{path}/values")
    units = spark.read.parquet(f"{path}/units")
    told = spark.read.schema("file string, path string, total bigint, accepted bigint, outcome string").json(f"{path}/report")
    now = coverage(values).select(
        "file", "path", F.col("total").alias("t"), F.col("accepted").alias("a"), F.col("outcome").alias("o")
    )
    both = told.join(now, ["file", "path"], "full")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    checks = F.array(
        F.struct(F.lit("total").alias("check"), same("total", "t").alias("passed")),
        F.struct(F.lit("accepted").alias("check"), same("accepted", "a").alias("passed")),
        F.struct(F.lit("outcome").alias("check"), same("outcome", "o").alias("passed")),
    )
    totals = both.select("file", "path", F.explode(checks).alias("c")).select("file", "path", "c.*")
    sound = F.bool_and(F.col("status").isin(*STATUSES))
    masked = F.bool_and((F.col("status") == "accepted") | F.col("value").isNull())
    maps = values.groupBy("file", "path").agg(sound.alias("declared"), masked.alias("masked"))
    ledger_ok = units.groupBy("file", "path").agg(
        F.bool_and((F.col("status") == "accepted") == F.col("sha256").isNotNull()).alias("digests")
    )
    out = totals
    for df, name in ((maps, "declared"), (maps, "masked"), (ledger_ok, "digests")):
        out = out.unionByName(df.select("file", "path", F.lit(name).alias("check"), F.col(name).alias("passed")))
    return out


def routes(
    write_flag: bool = False,
    past_end: bool = False,
    native_first: bool = False,
    corrected: bool = False,
    readable: bool = False,
) -> list[str]:
    """The routes to try for a dataset, in order, from the file's condition. ``native_first``: the path is in the reserved group, the run
    resumes another, or the superblock's checksum fails; ``corrected``: counts or filter fields of rooted objects were set right."""
    if write_flag:
        return ["status"]
    if past_end:
        return ["truncated_chunks", "nonchunked"]
    order = ["structural", "large_structural", "relocated_native", "nonchunked"] + ["readable"] * readable + ["native_stream"]
    if native_first or corrected:
        order.remove("native_stream")
        order.insert(0, "native_stream")
    return order


def route(attempts: DataFrame, by: Sequence[str] = ("path",)) -> DataFrame:
    """The route to keep of each dataset: more coverage wins, the first attempt of a tie; attempts that were contradicted stop
    the dataset altogether, unsupported ones are passed over."""
    stopped = attempts.groupBy(*by).agg(F.bool_or("contradiction").alias("stopped"))
    usable = attempts.where(~F.col("unsupported") & ~F.col("contradiction"))
    best = ledger.best(usable, list(by), "coverage", ["attempt"])
    return best.join(stopped, list(by)).where(~F.col("stopped")).drop("stopped")


def summary(outcomes: DataFrame) -> DataFrame:
    """How many files or datasets had each outcome."""
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def strict_json(text: str, known: Sequence[str], most: int = 1 << 20) -> dict:
    """A JSON object without repeated or unknown keys (SURVEY: S35)."""
    if len(text) > most:
        raise ValueError("too long")

    def once(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("a key is repeated")
        return dict(pairs)

    out = json.loads(text, object_pairs_hook=once, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(f"{c} is no JSON")))
    if not isinstance(out, dict) or set(out) - set(known):
        raise ValueError("not an object of known keys")
    return out


def capabilities() -> dict:
    """What this build reads and decodes (SURVEY: V10)."""
    from .functions import codecs

    return {
        "superblocks": [0, 1, 2, 3],
        "layouts": ["compact", "contiguous", "single", "implicit", "fixed_array", "extensible_array", "tree", "tree2"],
        "types": ["integer", "float", "fixed string"],
        "filters": sorted(codecs.DECODERS),
        "statuses": list(STATUSES),
    }
