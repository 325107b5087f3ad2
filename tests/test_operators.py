import random

import pytest
from pyspark.sql import functions as F

from lodestack.functions import gf256
from lodestack.operators import capture, graph, grid, intervals, ledger
from lodestack.plans import further
from lodestack.streaming import ingest


def rows(seed, n=60, top=120, most=15):
    r = random.Random(seed)
    return [(i, r.randrange(3), s, s + r.randint(1, most)) for i, s in enumerate(r.randrange(top) for _ in range(n))]


def frame(spark, data):
    return spark.createDataFrame(data, "id int, source int, start bigint, stop bigint")


@pytest.mark.parametrize("seed", range(3))
def test_intervals_against_brute_force(spark, seed):
    data = rows(seed)
    df = frame(spark, data)
    got = {r.id for r in intervals.overlapping(df, ["source"], ["id"]).collect()}
    before = lambda x: [y for y in data if y[1] == x[1] and (y[2], y[0]) < (x[2], x[0])]
    assert got == {x[0] for x in data if any(y[3] > x[2] for y in before(x))}
    merged = {(r.source, r.start, r.stop): r.members for r in intervals.union(df, ["source"]).collect()}
    want = {}
    for s in range(3):
        run = None
        for _, _, a, b in sorted((x for x in data if x[1] == s), key=lambda x: (x[2], x[3])):
            if run and a < run[1]:
                run = [run[0], max(run[1], b), run[2] + 1]
            else:
                if run:
                    want[s, run[0], run[1]] = run[2]
                run = [a, b, 1]
        want[s, run[0], run[1]] = run[2]
    assert merged == want
    other = rows(seed + 50, 40)
    left = df.select("id", "source", F.col("start").alias("l_start"), F.col("stop").alias("l_stop"))
    right = frame(spark, other).select(F.col("id").alias("other"), "source", F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))
    for width in (4, 16, 1000):
        pairs = [(r.id, r.other) for r in intervals.range_join(left, right, width, ["source"]).collect()]
        brute = [(x[0], y[0]) for x in data for y in other if x[1] == y[1] and x[2] < y[3] and y[2] < x[3]]
        assert sorted(pairs) == sorted(brute)


def test_holders_of_segments_of_any_length(spark):
    rng = random.Random(5)
    starts = [rng.choice([-1, 1]) * rng.randrange(1 << rng.randrange(1, 62)) for _ in range(120)]
    segments = [(i, i % 3, a, a + rng.randrange(1 << rng.randrange(1, 62))) for i, a in enumerate(starts)]
    segments += [(200, 0, -(2**63), 2**63 - 1), (201, 1, 5, 5), (202, 1, 9, 3), (203, 1, None, 7), (204, 2, 255, 257)]
    ends = [e + d for _, _, a, z in segments if a is not None for e in (a, z) for d in (-1, 0, 1) if abs(e + d) < 2**63]
    points = [(i, i % 3, x) for i, x in enumerate(ends + [0, 255, 256, 257, 4096, None])]
    left = spark.createDataFrame(points, "id bigint, source int, l_start bigint")
    right = spark.createDataFrame(segments, "other bigint, source int, r_start bigint, r_stop bigint")
    got = [(r.id, r.other) for r in intervals.holders(left, right, "l_start", ["source"]).collect()]
    want = [(i, k) for i, s, x in points for k, t, a, z in segments if s == t and None not in (x, a) and a <= x < z]
    assert sorted(got) == sorted(want)
    assert intervals.holders(left, right.limit(0), "l_start", ["source"]).count() == 0


def test_unequal_segments_of_large_keys(spark, tmp_path):
    keys = [0, 1, 2, 31, 60_000, 50_000_000, 303_700_049, 303_700_050, 2**62, -1, -7, -(2**62), None]
    prices = [0.5, 99.9, 100.0, 399.99, 400.0, 96_100.0, 102_399.9, 102_400.0, 3.6e11, 2.5e17, 2.5e17, 2.0**63 - 1024, -4.0, None]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(x,) for x in prices], "l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for k in keys:
        held = [int(x // 1) - k * k * 100 for x in prices if None not in (k, x) and k * k * 100 <= x // 1 < (k + 1) * (k + 1) * 100]
        if held:
            want[k] = (len(held), sum(held))
    got = further.q63_unequal_segments(spark, str(tmp_path)).collect()
    assert {r.segment: (r.points, r.offsets) for r in got} == want and {60_000, 50_000_000, 303_700_049} <= set(want)


def test_touching_ranges_stay_apart(spark):
    df = frame(spark, [(1, 0, 0, 5), (2, 0, 5, 9), (3, 0, 8, 10), (4, 0, 1, 2)])
    assert {(r.start, r.stop) for r in intervals.union(df, ["source"]).collect()} == {(0, 5), (5, 10)}
    assert {r.id for r in intervals.overlapping(df, ["source"], ["id"]).collect()} == {3, 4}


def test_grid(spark):
    cells = grid.grid(spark, (11, 7), (4, 3)).collect()
    assert len(cells) == grid.cardinality((11, 7), (4, 3)) == 9 and sum(c.elements for c in cells) == 77
    for c in cells:
        assert c.rank == c.c0 * 3 + c.c1
        assert c.elements == min(4, 11 - 4 * c.c0) * min(3, 7 - 3 * c.c1)


def test_masked_values_are_null_unless_accepted(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (2, 2, 6.0), (3, None, 7.0), (4, 9, 8.0)], "id int, status int, v double")
    got = {r.id: r.m for r in df.select("id", grid.masked(F.col("v"), F.col("status")).alias("m")).collect()}
    assert got == {1: 5.0, 2: None, 3: None, 4: None}
    assert {r.id for r in grid.undeclared(df, [1, 2]).collect()} == {3, 4}


def test_xor_restore_needs_exactly_one(spark):
    df = spark.createDataFrame([(0, 3), (0, 5), (0, None), (1, None), (1, None), (2, 7)], "stripe int, v bigint")
    parity = spark.createDataFrame([(0, 3 ^ 5 ^ 9), (1, 4), (2, 7)], "stripe int, parity bigint")
    got = {r.stripe: r.restored for r in capture.xor_restore(df, parity, ["stripe"], "v").collect()}
    assert got == {0: 9, 1: None, 2: None}


def test_field_product_in_columns(spark):
    df = spark.range(256).select(F.col("id").cast("int").alias("b"))
    for factor in (1, 2, 7, 16, 255):
        for r in df.select("b", capture.gf_times(F.col("b"), factor).alias("p")).collect():
            assert r.p == gf256.multiply(r.b, factor)


def test_replicas_never_vote(spark):
    data = [(1, "h", "h", "x", "y"), (2, "h", "z", "x", "h"), (3, "h", "z", "x", "x"), (4, None, "z", "x", "y"), (5, None, "z", "x", "x"), (6, "h", None, None, "h")]
    df = spark.createDataFrame(data, "id int, was string, now string, r0 string, r1 string")
    got = {r.id: (r.status, r.source) for r in capture.choose_replica(df, ["r0", "r1"]).collect()}
    assert got == {1: ("accepted", -1), 2: ("recovered", 1), 3: ("unavailable", None), 4: ("ambiguous", None), 5: ("unavailable", None), 6: ("recovered", 1)}


def test_reachability_with_cycles(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("d", "d")]
    got = {r.node: r.depth for r in graph.reachable(spark.createDataFrame(edges, "source string, target string"), spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_conflicts_beat_other_reasons(spark):
    df = spark.createDataFrame([(1, False, False), (2, True, False), (3, False, True), (4, True, True)], "id int, over boolean, failed boolean")
    why = ledger.reasons(overlap=F.col("over"), required_check=F.col("failed"))
    got = {r.id: (r.d, r.w) for r in df.select("id", ledger.decide(why).alias("d"), why.alias("w")).collect()}
    assert got == {1: ("accepted", []), 2: ("contradicted", ["overlap"]), 3: ("unassigned", ["required_check"]), 4: ("contradicted", ["overlap", "required_check"])}


def test_first_best_wins_ties(spark):
    df = spark.createDataFrame([("d", 2, 5, "b"), ("d", 1, 5, "a"), ("d", 3, 4, "c"), ("e", 1, None, "z")], "k string, attempt int, coverage int, route string")
    got = {r.k: r.route for r in ledger.best(df, ["k"], "coverage", ["attempt"]).collect()}
    assert got == {"d": "a", "e": "z"}


def test_ingest_takes_each_file_once(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    events.where("event_id % 2 = 0").write.parquet(src)
    ingest.ingest(spark, src, events.schema, out, state)
    first = spark.read.parquet(out).count()
    ingest.ingest(spark, src, events.schema, out, state)
    assert spark.read.parquet(out).count() == first == events.where("event_id % 2 = 0").count()
    events.where("event_id % 2 = 1").write.mode("append").parquet(src)
    ingest.ingest(spark, src, events.schema, out, state)
    assert spark.read.parquet(out).count() == events.count()
    counts = ingest.windowed_counts(events)
    assert counts.agg(F.sum("n")).first()[0] == events.count()
