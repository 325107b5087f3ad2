import random

import pytest

from lodestack.functions import checksums, codecs, gf256


def test_lookup3_published_values():
    text = b"Four score and seven years ago"
    assert checksums.lookup3(b"") == 0xDEADBEEF
    assert checksums.lookup3(text) == 0x17770551 and checksums.lookup3(text, 1) == 0xCD628161


def test_fletcher32_is_right_modulo_65535():
    r = random.Random(1)
    for n in (0, 1, 2, 7, 719, 720, 721, 5001):
        data = bytes(r.randrange(256) for _ in range(n))
        low = high = 0
        for i in range(0, n, 2):
            low += int.from_bytes(data[i : i + 2].ljust(2, b"\0"), "big")
            high += low
        got = checksums.fletcher32(data)
        assert ((got & 0xFFFF) % 65535, (got >> 16) % 65535) == (low % 65535, high % 65535)


def test_gf256_is_a_field():
    for a in range(1, 256):
        assert gf256.multiply(a, gf256.inverse(a)) == 1
    slow = lambda a, b: slow(a << 1 ^ (0x11D if a & 128 else 0), b >> 1) ^ (a if b & 1 else 0) if b else 0
    r = random.Random(2)
    for _ in range(500):
        a, b = r.randrange(256), r.randrange(256)
        assert gf256.multiply(a, b) == slow(a, b)


@pytest.mark.parametrize("members,rows,width", [(7, 2, 127), (8, 4, 33), (16, 4, 9)])
def test_erasures(members, rows, width):
    r = random.Random(members)
    data = [bytes(r.randrange(256) for _ in range(width - i % 3)) for i in range(members)]
    sizes = list(map(len, data))
    parity = gf256.parity(data, rows)
    for lost in range(rows + 2):
        for _ in range(12):
            gone = set(r.sample(range(members), lost))
            got = gf256.restore([None if i in gone else d for i, d in enumerate(data)], parity, sizes)
            assert got == data if lost <= rows else got is None


def test_codecs():
    r = random.Random(3)
    raw = bytes(r.randrange(4) for _ in range(103))
    assert codecs.unshuffle(codecs.shuffle(raw, 4), 4) == raw
    assert codecs.lzf(b"\x02abc\x20\x02\xe0\x05\x00", 100) == b"abcabc" + b"c" * 14
    for bad in (b"\x05ab", b"\x20\x09", b"\xe0"):
        with pytest.raises(codecs.DecodeError):
            codecs.lzf(bad, 100)
    import zlib

    with pytest.raises(codecs.DecodeError):
        codecs.inflate(zlib.compress(raw) + b"x", 200)
    with pytest.raises(codecs.DecodeError):
        codecs.inflate(zlib.compress(raw), 50)
    with pytest.raises(codecs.DecoderUnavailable):
        codecs.decode(raw, [(999, [])], 0, len(raw))
    assert codecs.decode(raw, [(999, [])], 1, len(raw)) == raw


def test_decoding_as_a_column(spark):
    import zlib

    rows = [(1, zlib.compress(b"abcd"), 0), (2, b"junk", 0), (3, None, 0), (4, b"abcd", 1)]
    df = spark.createDataFrame(rows, "id int, payload binary, filter_mask bigint")
    got = {r.id: (r.status, r.data) for r in codecs.decoded(df, [(codecs.DEFLATE, [])], 4).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "accepted", 2: "decode_failed", 3: "unavailable", 4: "accepted"}
    assert bytes(got[1][1]) == b"abcd"


def test_checksum_column(spark):
    df = spark.createDataFrame([(b"Four score and seven years ago",), (None,)], "b binary")
    assert [r[0] for r in df.select(checksums.udf(checksums.lookup3)("b")).collect()] == [0x17770551, None]


def test_text_forms(spark):
    from pyspark.sql import functions as F

    from lodestack.functions import text

    value = {"b": [1, b"\x00\xff", {"x": None}], "a": "é"}
    assert text.from_token(text.token(value)) == value
    assert text.canonical({"b": 1, "a": [1.5, True]}) == '{"a":[1.5,true],"b":1}'
    with pytest.raises(ValueError):
        text.canonical(float("nan"))
    assert text.shown("/a\nb") == "/a\\nb" and len(text.shown("x" * 999)) == 200
    assert text.rebased({"p": "/a/b", "q": ["/ab", "/a"]}, "/a", "/z") == {"p": "/z/b", "q": ["/ab", "/z"]}
    assert text.numbered("f%b_%%.h5", 12) == "f12_%.h5"
    with pytest.raises(ValueError):
        text.numbered("f%d", 1)
    df = spark.createDataFrame([("f12.h5",), ("fx.h5",), ("f1.h5x",)], "n string")
    assert [r[0] for r in df.select(text.block_of(F.col("n"), "f%b.h5")).collect()] == [12, None, None]
    df = spark.createDataFrame([("a" * 64,), ("A" * 64,), (None,)], "n string")
    assert [r[0] for r in df.select(text.is_digest(F.col("n"))).collect()] == [True, False, False]


def test_frames():
    from lodestack.streaming import frames

    data = b"".join(frames.pack({"unit": i}, bytes([i]) * i * 10) for i in range(4))
    got = list(frames.unpack(data))
    assert [(h["unit"], len(p)) for h, p, _ in got] == [(0, 0), (1, 10), (2, 20), (3, 30)] and got[-1][2] == len(data)
    assert len(list(frames.unpack(data[:-1]))) == 3 and list(frames.unpack(b"123")) == []
    hurt = bytearray(data)
    hurt[-1] ^= 1
    with pytest.raises(ValueError):
        list(frames.unpack(bytes(hurt)))
