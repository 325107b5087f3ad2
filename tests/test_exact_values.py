import numpy as np
import pytest

from lodestack.operators import graph
from lodestack.sources import arrays


def test_elements_come_out_exactly():
    big = np.array([2**53 + 1, -(2**63), 2**63 - 1, 7], "<i8")
    value, integer, text, element = (a.to_pylist() for a in arrays._exact(big))
    assert value == [None, None, None, 7.0] and [int(i) for i in integer] == big.tolist() and text == [None] * 4
    assert b"".join(element) == big.tobytes()
    unsigned = np.array([2**64 - 1, 2**53], ">u8")
    value, integer, _, element = (a.to_pylist() for a in arrays._exact(unsigned))
    assert value == [None, 2.0**53] and [int(i) for i in integer] == [2**64 - 1, 2**53] and b"".join(element) == unsigned.tobytes()
    value, integer, text, element = (a.to_pylist() for a in arrays._exact(np.array([b"abc", b"", b"\xff"], "S4")))
    assert text == ["abc", "", None] and value == [None] * 3 and element == [b"abc\0", b"\0\0\0\0", b"\xff\0\0\0"]
    assert arrays._exact(np.array([1.5, np.nan], ">f4"))[0].to_pylist()[0] == 1.5


def test_values_of_a_chunked_dataset(spark):
    data = np.array([2**53 + 1, 5, -3, 0], "<i8").tobytes()
    decoded = spark.createDataFrame(
        [("f", "/a", [0], "accepted", data), ("f", "/a", [4], "unknown", None)],
        "file string, path string, origin array<bigint>, status string, data binary",
    )
    described = spark.createDataFrame([("f", "/a", [6], [4], "<i8")], "file string, path string, shape array<bigint>, chunks array<bigint>, dtype string")
    got = arrays.values(decoded, described).orderBy("index").collect()
    assert [None if r.integer is None else int(r.integer) for r in got] == [2**53 + 1, 5, -3, 0, None, None]
    assert [r.value for r in got] == [None, 5.0, -3.0, 0.0, None, None]


def test_a_long_chain_is_walked_to_its_end(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(6, 2)], "source bigint, target bigint")
    roots = spark.createDataFrame([(0,)], "node bigint")
    assert {r.node: r.depth for r in graph.reachable(links, roots).collect()} == {i: i for i in range(7)}
    with pytest.raises(ValueError, match="deeper"):
        graph.reachable(links, roots, max_depth=3)
