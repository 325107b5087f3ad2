"""Queries over whole tables that have no SQL, against brute force."""

from collections import defaultdict

import duckdb

import __spark_entry__ as entry

QUERIES = entry.queries()


def rows(sf, sql):
    return duckdb.sql(sql.format(**{t: f"'{sf}/{t}.parquet'" for t in ("lineitem", "customer", "nation")})).fetchall()


def test_all_conflicts(spark, sf):
    by_source = defaultdict(list)
    for source, price, quantity, *key in rows(sf, "select l_suppkey, l_extendedprice, l_quantity, l_orderkey, l_linenumber from {lineitem}"):
        by_source[source].append((int(price // 1), int(price // 1) + int(quantity // 1), tuple(key)))
    want = []
    for source, extents in by_source.items():
        for a, b, first in extents:
            for c, d, second in extents:
                if first < second and a < d and c < b:
                    want.append((source, first[0], second[0], first[1], second[1]))
    got = QUERIES["q56_all_conflicting_proposals"](spark, sf)
    assert sorted(map(tuple, got.select("source", "first_order", "second_order", "first_line", "second_line").collect())) == sorted(want)
    # pairs that the part's filter would leave out
    assert any(w[1] % 4 or w[2] % 4 for w in want)


def test_two_readers_of_all(spark, sf):
    of = defaultdict(list)
    for order, line, part in rows(sf, "select l_orderkey, l_linenumber, l_partkey from {lineitem}"):
        of[order, line].append(part)
    want = []
    for (order, line), parts in of.items():
        other = [None if order % 31 == 0 else p + (order % 37 == 0) for p in parts]
        want += [(order, line, p) for p in parts for o in other if p == o]
    assert sorted(map(tuple, QUERIES["q55_two_readers_of_all"](spark, sf).collect())) == sorted(want)
    assert {w[1] for w in want} > {1}


def test_all_positional_pairs(spark, sf):
    points, virtual = defaultdict(list), defaultdict(list)
    for nation, key in sorted(rows(sf, "select c_nationkey, c_custkey from {customer}"), key=lambda r: r[1]):
        points[nation % 5].append(key)
    for region, nation in sorted(rows(sf, "select n_regionkey, n_nationkey from {nation}")):
        virtual[region].append(nation)
    want = []
    for region, nations in virtual.items():
        found = points[region] + [None] * len(nations)
        want += [(region, n, p, int(p is not None)) for n, p in zip(nations, found)]
    got = map(tuple, QUERIES["q54_all_positional_pairs"](spark, sf).collect())
    assert sorted(got, key=repr) == sorted(want, key=repr)
