import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sources import VALUES, sample

from lodestack import api
from lodestack.functions.checksums import lookup3
from lodestack.operators import selection
from lodestack.sources import container, repair


def test_recover_publish_verify(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.h5").write_bytes(sample(lost=(4,)))
    got = api.recover(spark, str(tmp_path / "in"), "/filtered")
    api.publish(got, str(tmp_path / "out"))
    assert api.verify(spark, str(tmp_path / "out")).where("not passed").count() == 0
    (row,) = api.coverage(got.values).collect()
    assert (row.total, row.accepted, row.outcome) == (48, 42, "partial")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        api.publish(got, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        api.recover(spark, "x", "relative")
    # a report that claims more than the maps hold
    told = spark.read.json(str(tmp_path / "out" / "report")).withColumn("accepted", F.lit(48)).collect()
    spark.createDataFrame(told).write.mode("overwrite").json(str(tmp_path / "out" / "report"))
    assert {r["check"] for r in api.verify(spark, str(tmp_path / "out")).where("not passed").collect()} == {"accepted"}


def test_masked_reads(spark, tmp_path):
    (tmp_path / "a.h5").write_bytes(sample(lost=(4,)))
    values = api.recover(spark, str(tmp_path), "/filtered").values.cache()
    truth = VALUES.astype(float)
    truth[3:6, 0:2] = np.nan  # the lost chunk
    for chosen in ((slice(1, 5), slice(0, 3)), (-1,), (Ellipsis, 0), (2, 3), (slice(4, 4),), ()):
        got = api.read_masked(values, (6, 8), chosen).collect()
        want = truth[tuple(chosen)]
        assert len(got) == want.size
        for r in got:
            at = tuple(r[:-1])
            assert r.value is None if np.isnan(want[at]) else r.value == want[at]
    for bad in ((slice(0, 4, 2),), (9,), (0, 0, 0), (Ellipsis, Ellipsis), (1.5,), (True,)):
        with pytest.raises((ValueError, TypeError, IndexError)):
            api.read_masked(values, (6, 8), bad)


def test_selections(spark):
    for axes in ([(1, 4, 2, 3), (0, 1, 5, 1)], [(2, 3, 3, 1)], [(0, 1, 1, 4), (1, 2, 2, 1), (0, 5, 1, 2)]):
        want = [()]
        for start, stride, count, block in axes:
            line = [start + i * stride + w for i in range(count) for w in range(block)]
            want = [p + (x,) for p in want for x in line]
        rows = selection.points(spark, axes).orderBy("k")
        assert [tuple(r[1:]) for r in rows.collect()] == want
        back = rows.select("k", selection.rank([F.col(f"x{i}") for i in range(len(axes))], axes).alias("r")).collect()
        assert all(r.k == r.r for r in back)
    with pytest.raises(ValueError):
        selection.check([(0, 2, 2, 3)], [9])
    with pytest.raises(ValueError):
        selection.check([(0, 4, 3, 2)], [9])


def test_mappings(spark):
    maps = [([(0, 1, 4, 1)], "a", [(2, 2, 4, 1)]), ([(2, 1, 4, 1)], "b", [(0, 1, 4, 1)])]
    pairs = selection.mapped(spark, maps)
    assert {r.v0 for r in selection.overlaps(pairs, ["v0"]).collect()} == {2, 3}
    got = {r.v0: (r.source, r.s0) for r in selection.last_mapping(pairs, ["v0"]).collect()}
    assert got == {0: ("a", 2), 1: ("a", 4), 2: ("b", 0), 3: ("b", 1), 4: ("b", 2), 5: ("b", 3)}


def test_routes(spark):
    rows = [("/a", 1, 5, False, False), ("/a", 2, 5, False, False), ("/a", 3, 7, True, False), ("/b", 1, 3, False, False), ("/b", 2, 9, False, True), ("/c", 1, 1, False, False), ("/c", 2, 4, False, False)]
    df = spark.createDataFrame(rows, "path string, attempt int, coverage int, unsupported boolean, contradiction boolean")
    assert {(r.path, r.attempt) for r in api.route(df).collect()} == {("/a", 1), ("/c", 2)}


def test_route_order():
    assert api.routes(write_flag=True, past_end=True) == ["status"]
    assert api.routes(past_end=True) == ["truncated_chunks", "nonchunked"]
    assert api.routes(readable=True)[-2:] == ["readable", "native_stream"] and api.routes()[0] == "structural"
    assert api.routes(corrected=True)[:2] == ["native_stream", "structural"]


def test_strict_json():
    assert api.strict_json('{"a": 1}', ["a", "b"]) == {"a": 1}
    for bad in ('{"a": 1, "a": 2}', '{"c": 1}', "[1]", '{"a": NaN}'):
        with pytest.raises(ValueError):
            api.strict_json(bad, ["a"])


def test_broken_fixed_array_pointer():
    good = sample()
    at = good.find(b"FAHD")
    data = bytearray(good)
    data[at + 16 : at + 24] = struct.pack("<Q", 12345)
    change = repair.fixed_array_pointer(bytes(data), at)
    made = repair.plan(bytes(data), [change])
    assert repair.apply(bytes(data), made) == good
    with pytest.raises(container.Damaged):
        repair.apply(good, made)
    with pytest.raises(container.Damaged):
        repair.apply(bytes(data), made | {"changes": []})
    assert repair.fixed_array_pointer(good, at) is None
    data[good.find(b"FADB") + 6] ^= 1
    with pytest.raises(container.Damaged):
        repair.fixed_array_pointer(bytes(data), at)


def test_one_byte_and_two_links():
    r = random.Random(1)
    body = bytes(r.randrange(256) for _ in range(40))
    hurt = bytearray(body)
    hurt[17] ^= 4
    assert repair.one_byte(bytes(hurt), lookup3(body)) == (17, body[17])
    slots, right = [0, 8, 16], {0: 1000, 16: 3000}
    whole = bytearray(body)
    for s, a in right.items():
        whole[s : s + 8] = struct.pack("<Q", a)
    candidates = [[1000, 2000], [2000], [3000, 4000, 1000]]
    assert repair.assign(body, lookup3(bytes(whole)), slots, candidates) == right
    assert repair.assign(body, 1, slots, candidates) is None
    with pytest.raises(container.Damaged):
        repair.assign(body, 1, slots, candidates, most_trials=3)


def test_sibling_bridge():
    node = lambda left, right, level=0: b"TREE" + struct.pack("<BBHQQ", 1, level, 0, left, right)
    size, none = 24, container.UNDEFINED
    data = node(none, size) + node(0, 2 * size) + node(size, none)
    assert repair.sibling_bridge(data, 0, 2 * size) == size
    assert repair.sibling_bridge(node(none, size) + node(0, 2 * size, 1) + node(size, none), 0, 2 * size) is None
    assert repair.sibling_bridge(node(none, 2 * size) + node(0, 2 * size) + node(size, none), 0, 2 * size) is None


def test_every_index_pointer_comes_back(tmp_path):
    w = container.Writer()
    w.fixed_array("a", (4, 4), (2, 2), "<i4", [bytes(16)] * 4)
    w.extensible_array("b", (12, 2), (container.UNDEFINED, 2), (2, 2), "<i4", {k: bytes(16) for k in range(6)})
    w.tree2("c", (60, 2), (2, 2), "<i4", {(i, 0): bytes(16) for i in range(30)})
    good = w.finish()
    for word, (_, place, _) in repair.POINTERS.items():
        data = bytearray(good)
        at = good.find(word) + place
        data[at : at + 8] = struct.pack("<Q", 4242)
        assert repair.apply(bytes(data), repair.plan(bytes(data), repair.find(bytes(data)))) == good
    assert repair.find(good) == []
    from lodestack.__main__ import main

    data = bytearray(good)
    at = good.find(b"EAHD") + 60
    data[at] ^= 255
    (tmp_path / "bad").write_bytes(bytes(data))
    import contextlib
    import io

    with contextlib.redirect_stdout(io.StringIO()) as out:
        assert main(["plan", str(tmp_path / "bad")]) == 0
    (tmp_path / "plan").write_text(out.getvalue())
    assert main(["apply", str(tmp_path / "bad"), str(tmp_path / "plan"), str(tmp_path / "good")]) == 0
    assert (tmp_path / "good").read_bytes() == good
    with pytest.raises(FileExistsError):
        main(["apply", str(tmp_path / "bad"), str(tmp_path / "plan"), str(tmp_path / "good")])
