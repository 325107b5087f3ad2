"""Digests, parity, and comparison with prior captures (SURVEY: G05, G07, G11, G12, F11, F12, J05-J10, R29-R34)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCEPTED, UNAVAILABLE, UNKNOWN = "accepted", "unavailable", "allocation_unknown"


def digest(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """SHA-256 of each unit's sorted, comma-joined values. A unit is a chunk, which is bounded by design."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(value)), lambda v: v.cast("string")), ",")
    return rows.groupBy(*by).agg(F.sha2(joined, 256).alias("digest"))


def xor_parity(members: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """XOR of each stripe's members; partial before the shuffle."""
    return members.groupBy(*by).agg(F.bit_xor(value).alias("parity"))


def xor_restore(members: DataFrame, parity: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Each stripe's missing value (null ``value``), where exactly one is missing; else null."""
    state = members.groupBy(*by).agg(
        F.sum(F.col(value).isNull().cast("int")).alias("missing"), F.bit_xor(value).alias("companions")
    )
    rebuilt = F.when(F.col("missing") == 1, F.col("parity").bitwiseXOR(F.coalesce("companions", F.lit(0).cast("bigint"))))
    return state.join(parity, list(by)).withColumn("restored", rebuilt)


def gf_times(byte: Column, factor: int) -> Column:
    """Product in GF(256) with polynomial 0x11D, as shifts and XORs in the JVM."""
    out, power = F.lit(0), byte.cast("int")
    while factor:
        if factor & 1:
            out = out.bitwiseXOR(power)
        factor >>= 1
        double = F.shiftleft(power, 1)
        power = F.when(double > 255, double.bitwiseXOR(F.lit(0x11D))).otherwise(double)
    return out


def compare_baseline(grid: DataFrame, current: DataFrame, prior: DataFrame, on: Sequence[str]) -> DataFrame:
    """Status of each unit: its digest now against the captured one. Without a captured digest the status stays open."""
    found = grid.join(current.withColumnRenamed("digest", "now"), list(on), "left").join(
        prior.withColumnRenamed("digest", "was"), list(on), "left"
    )
    status = (
        F.when(F.col("now").isNull(), UNKNOWN)
        .when(F.col("was").isNull(), "unverified")
        .when(F.col("now") == F.col("was"), ACCEPTED)
        .otherwise(UNAVAILABLE)
    )
    return found.withColumn("status", status)


def choose_replica(units: DataFrame, copies: Sequence[str], current: str = "now", prior: str = "was") -> DataFrame:
    """Pick the source of each unit: the current bytes if they match the captured digest, else the first replica that does. There is
    no vote: replicas that differ without a captured digest are ambiguous."""
    match = F.coalesce(*[F.when(F.col(c) == F.col(prior), F.lit(i)) for i, c in enumerate(copies)], F.lit(-1))
    distinct = F.size(F.array_distinct(F.array_compact(F.array(*copies))))
    status = (
        F.when(F.col(prior).isNotNull() & (F.col(current) == F.col(prior)), ACCEPTED)
        .when(F.col(prior).isNotNull() & (match >= 0), "recovered")
        .when(F.col(prior).isNull() & (distinct > 1), "ambiguous")
        .otherwise(UNAVAILABLE)
    )
    chosen = F.when(status == ACCEPTED, F.lit(-1)).when(status == "recovered", match)
    return units.withColumn("status", status).withColumn("source", chosen)


def repeated(rows: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Groups with more than one row, with their number and smallest key."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("least")).where(F.col("n") > 1)


def complement(text: Column, ranges: Column) -> Column:
    """What the ``ranges`` (structs of int start and stop, by start) leave of ``text``, in order."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, r: Column) -> Column:
        between = F.substr(text, s["at"] + 1, F.greatest(r["start"] - s["at"], F.lit(0)))
        return F.struct(F.greatest(s["at"], r["stop"]).alias("at"), F.concat(s["out"], between).alias("out"))

    return F.aggregate(ranges, begin, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.length(text))))
