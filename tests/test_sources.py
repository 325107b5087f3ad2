import random
import struct
import zlib

import numpy as np
import pytest

from lodestack.functions import codecs
from lodestack.functions.checksums import fletcher32, lookup3
from lodestack.sources import arrays, container

PIPELINE = [(codecs.SHUFFLE, [4]), (codecs.DEFLATE, [6]), (codecs.FLETCHER32, [])]


def stored(raw: bytes) -> bytes:
    packed = zlib.compress(codecs.shuffle(raw, 4))
    return packed + struct.pack("<I", fletcher32(packed))


def grid_parts(values, dims):
    out = []
    for i in range(0, values.shape[0], dims[0]):
        for j in range(0, values.shape[1], dims[1]):
            part = np.zeros(dims, values.dtype)
            cut = values[i : i + dims[0], j : j + dims[1]]
            part[: cut.shape[0], : cut.shape[1]] = cut
            out.append(part.tobytes())
    return out


VALUES = (np.arange(48).reshape(6, 8) * 37 + 3).astype("<u4")


def sample(lost=(), broken=()):
    w = container.Writer()
    parts = [stored(p) for p in grid_parts(VALUES, (3, 2))]
    for k in broken:
        parts[k] = parts[k][:-1] + bytes([parts[k][-1] ^ 1])
    w.fixed_array("filtered", (6, 8), (3, 2), "<u4", [None if k in lost else p for k, p in enumerate(parts)], PIPELINE)
    w.fixed_array("paged", (6, 8), (1, 1), "<u4", grid_parts(VALUES, (1, 1)), page_bits=4)
    w.implicit("implicit", (5, 7), (3, 2), "<f4", grid_parts(VALUES[:5, :7].astype("<f4"), (3, 2)))
    w.contiguous("flat", (6, 8), ">u4", VALUES.astype(">u4").tobytes())
    w.compact("small", (3,), "<i2", struct.pack("<3h", -1, 2, -3))
    return w.finish()


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.h5").write_bytes(sample(lost=(4,), broken=(7,)))
    (tmp_path / "b.h5").write_bytes(b"nothing here" * 100)
    return str(tmp_path)


def test_survey_and_values(spark, folder):
    src = arrays.files(spark, folder)
    told = {(r.file[-4:], r.path): r for r in arrays.datasets(src).collect()}
    assert told["b.h5", None].support == "damaged"
    assert told["a.h5", "/paged"].shape == [6, 8] and told["a.h5", "/filtered"].filters == [2, 1, 3]
    decoded = arrays.chunks(src)
    assert {(tuple(r.origin), r.status) for r in decoded.where("path = '/filtered' and status <> 'accepted'").collect()} == {((3, 0), "unknown"), ((3, 6), "decode_failed")}
    got = arrays.values(decoded, arrays.datasets(src)).collect()
    wrong = 0
    for path, want in (("/filtered", VALUES), ("/paged", VALUES), ("/implicit", VALUES[:5, :7]), ("/flat", VALUES), ("/small", np.array([-1, 2, -3]))):
        mine = {r["index"]: (r.value, r.status) for r in got if r.path == path}
        assert len(mine) == want.size
        for i, v in enumerate(want.ravel().tolist()):
            value, status = mine[i]
            assert (value is None) == (status != "accepted")
            wrong += value is not None and value != v
    assert wrong == 0


def test_links_and_markers(spark, folder):
    src = arrays.files(spark, folder)
    assert {r.name for r in arrays.links(src).collect()} == {"filtered", "paged", "implicit", "flat", "small"}
    data = sample(lost=(4,), broken=(7,))
    found = {(r.signature, r.offset) for r in arrays.markers(src).collect()}
    assert ("FAHD", data.find(b"FAHD")) in found and sum(m == "FADB" for m, _ in found) == 2


def test_tampering_never_gives_wrong_values():
    """Bytes flipped anywhere: what is still accepted is right, wherever a checksum or the format can tell."""
    good, r = sample(), random.Random(501)
    _, src, found = container.survey(good)
    spans = [(c.offset, c.size) for d in found.datasets if d.path == "/filtered" for c in container.chunks(src, d)]
    for _ in range(120):
        data = bytearray(good)
        at, n = r.choice(spans)
        data[at + r.randrange(n)] ^= 1 << r.randrange(8)
        _, src, found = container.survey(bytes(data))
        d = next(d for d in found.datasets if d.path == "/filtered")
        for c, want in zip(container.chunks(src, d), grid_parts(VALUES, (3, 2)), strict=True):
            try:
                assert codecs.decode(src.at(c.offset, c.size), [(f[0], f[2]) for f in d.filters], c.mask, 24) == want
            except codecs.DecodeError:
                pass


def test_sealed_structures_are_refused():
    good = sample()
    for word in (b"FAHD", b"FADB", b"OHDR"):
        data = bytearray(good)
        data[good.find(word) + 9] ^= 1
        try:
            _, src, found = container.survey(bytes(data))
        except container.Damaged:
            continue
        bad = len(found.refused)
        for d in found.datasets:
            try:
                list(container.chunks(src, d))
            except container.Damaged:
                bad += 1
        assert bad == 1
    with pytest.raises(container.Damaged):
        container.superblock(good[:20] + b"\1" + good[21:])


def test_truncated_file(spark, tmp_path):
    data = sample()
    _, src, found = container.survey(data)
    (tmp_path / "a.h5").write_bytes(data)
    d = next(d for d in found.datasets if d.path == "/flat")
    assert next(container.chunks(container.Bytes(data[: d.index[0] + 10]), d)).offset == d.index[0]
    with pytest.raises(container.Damaged):
        container.Bytes(data[: d.index[0] + 10]).at(*d.index)


def old_file():
    """A version-0 superblock with an old-style root group and a chunk tree, byte by byte."""
    data = bytearray(96)
    put = lambda b: (len(data), data.extend(b))[0]
    parts = grid_parts(VALUES, (3, 4))
    at = [put(p) for p in parts]
    keys = [struct.pack("<II3Q", 48, 0, i // 2 * 3, i % 2 * 4, 0) for i in range(4)]
    node = lambda ks, kids, level: b"TREE" + struct.pack("<BBHQQ", 1, level, len(kids), 2**64 - 1, 2**64 - 1) + b"".join(k + struct.pack("<Q", c) for k, c in zip(ks, kids, strict=True)) + struct.pack("<II3Q", 0, 0, 6, 0, 0)
    leaves = [put(node(keys[:2], at[:2], 0)), put(node(keys[2:], at[2:], 0))]
    tree = put(node([keys[0], keys[2]], leaves, 1))
    body = b""
    space = struct.pack("<BBBB4x2Q", 1, 2, 0, 0, 6, 8)
    layout = struct.pack("<BBBQ3I", 3, 2, 3, tree, 3, 4, 4)
    for kind, m in ((1, space), (3, container.Writer.type_of("<u4")), (8, layout)):
        m = m.ljust(-(-len(m) // 8) * 8, b"\0")
        body += struct.pack("<HHB3x", kind, len(m), 0) + m
    header = put(struct.pack("<BBHII4x", 1, 0, 3, 1, len(body)) + body)
    names = put(b"\0" * 8 + b"x\0".ljust(8, b"\0"))
    heap = put(b"HEAP" + struct.pack("<B3xQQQ", 0, 16, 2**64 - 1, names))
    symbols = put(b"SNOD" + struct.pack("<BBH", 1, 0, 1) + struct.pack("<QQII16x", 8, header, 0, 0))
    group = put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, 2**64 - 1, 2**64 - 1) + struct.pack("<QQQ", 0, symbols, 8))
    message = struct.pack("<HHB3xQQ", 0x11, 16, 0, group, heap)
    root = put(struct.pack("<BBHII4x", 1, 0, 1, 1, len(message)) + message)
    head = container.SIGNATURE + struct.pack("<8BHHI4QQQII16x", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0, 0, 2**64 - 1, len(data), 2**64 - 1, 0, root, 0, 0)
    data[: len(head)] = head
    return bytes(data)


def test_old_format():
    _, src, found = container.survey(old_file())
    assert not found.refused
    (d,) = found.datasets
    got = {c.origin: src.at(c.offset, c.size) for c in container.chunks(src, d)}
    want = dict(zip([(0, 0), (0, 4), (3, 0), (3, 4)], grid_parts(VALUES, (3, 4)), strict=True))
    assert d.path == "/x" and got == want


def test_one_byte_correction_is_unique():
    body = b"FAHD" + bytes(range(20))
    hurt = bytearray(body)
    hurt[9] = 77
    assert arrays.one_byte_corrections(bytes(hurt), lookup3(body)) == [(9, body[9])]


def test_extensible_array():
    free = container.UNDEFINED
    values = np.arange(40 * 6).reshape(40, 6).astype("<u4")
    for shape, most, page_bits in (((40, 6), (free, 6), 2), ((40, 6), (free, 8), 10), ((6, 40), (6, free), 3)):
        v = values if shape[0] == 40 else values.T.copy()
        dims = (2, 3) if shape[0] == 40 else (3, 2)
        w = container.Writer()
        parts, want = {}, {}
        axis = most.index(free)
        other = -(-most[1 - axis] // dims[1 - axis])
        for i in range(0, shape[0], dims[0]):
            for j in range(0, shape[1], dims[1]):
                raw = v[i : i + dims[0], j : j + dims[1]].tobytes()
                at = (i // dims[0], j // dims[1])
                if (i + j) % 7 == 5:
                    continue  # not allocated
                parts[at[axis] * other + at[1 - axis]] = raw
                want[i, j] = raw
        w.extensible_array("x", shape, most, dims, "<u4", parts, page_bits=page_bits)
        _, src, found = container.survey(w.finish())
        (d,) = found.datasets
        got = {c.origin: src.at(c.offset, c.size) for c in container.chunks(src, d) if c.offset is not None}
        assert d.layout == "extensible_array" and got == want


def test_version_two_tree():
    for n in (1, 2, 4, 5, 6, 13, 60, 200):
        w = container.Writer()
        parts = {(i, j): struct.pack("<4i", i, j, n, -1) for i in range(n) for j in range(2) if (i + j) % 5}
        w.tree2("x", (2 * n, 4), (2, 2), "<i4", parts)
        data = w.finish()
        _, src, found = container.survey(data)
        (d,) = found.datasets
        got = {tuple(o // 2 for o in c.origin): src.at(c.offset, c.size) for c in container.chunks(src, d)}
        assert d.layout == "tree2" and got == parts
        if len(parts) > 20:
            hurt = bytearray(data)
            hurt[data.find(b"BTLF") + 9] ^= 1
            _, src, found = container.survey(bytes(hurt))
            with pytest.raises(container.Damaged):
                list(container.chunks(src, found.datasets[0]))


def test_data_source(spark, folder):
    from lodestack.sources import datasource

    datasource.register(spark)
    read = spark.read.format("arraychunks").option("slices", "3")
    got = read.load(f"{folder}/*.h5")
    want = arrays.chunks(arrays.files(spark, folder))
    key = lambda df: sorted((r.path, tuple(r.origin), r.status, None if r.data is None else bytes(r.data)) for r in df.collect())
    assert key(got) == key(want)
    bare = read.option("payload", "false").option("dataset", "/filtered").load(f"{folder}/*.h5")
    assert sorted(r.status for r in bare.collect()) == ["accepted"] * 7 + ["unknown"]
