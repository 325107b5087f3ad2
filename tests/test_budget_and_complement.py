"""Running totals over tiles and complements of captured ranges, against plain loops."""

import random

from pyspark.sql import functions as F

from lodestack.operators import capture, ledger


def test_running_total(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaab"), at, nth, rng.randrange(50)) for at in range(0, 600, 3) for nth in range(2)]
    df = spark.createDataFrame(rows, "source string, at bigint, nth int, size bigint")
    got = {tuple(r)[:3]: r["total"] for r in ledger.running_total(df, ["source"], ["at", "nth"], "size", 64).select("source", "at", "nth", "total").collect()}
    sums, want = {}, {}
    for source, at, nth, size in sorted(rows):
        sums[source] = sums.get(source, 0) + size
        want[source, at, nth] = sums[source]
    assert got == want
    assert ledger.running_total(df.limit(0), ["source"], ["at", "nth"], "size", 64).count() == 0


def test_complement(spark):
    text = "abcdefghijklmnopqrstuvwxyzé\U0001f600z"
    cases = [[], [(0, 5)], [(2, 4), (3, 9)], [(2, 20), (3, 5), (25, 90)], [(0, 90)], [(50, 60)]]
    df = spark.createDataFrame([(text, c) for c in cases] + [("", [(0, 3)])], "text string, ranges array<struct<start:int,stop:int>>")
    got = [r["left"] for r in df.select(capture.complement(F.col("text"), F.col("ranges")).alias("left")).collect()]
    want = ["".join(ch for i, ch in enumerate(text) if not any(a <= i < b for a, b in c)) for c in cases] + [""]
    assert got == want
