"""Array containers as DataFrames (SURVEY: S01, S05, S12-S14, S17, S28, S31; K01, K04, V01).

Files are read with Spark's ``binaryFile`` source, so any store that Spark reads will do and a task holds one file at a time. Files
beyond ``binaryFile``'s 2 GB limit need to be split by their writer.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..session import ship
from . import container

DATASETS = (
    "file string, path string, address bigint, shape array<bigint>, chunks array<bigint>, dtype string, layout string, "
    "filters array<int>, support string, reason string"
)
CHUNKS = "file string, path string, origin array<bigint>, offset bigint, size bigint, filter_mask bigint, status string, data binary"
LINKS = "file string, group_address bigint, name string, kind string, target bigint, target_path string"

# Four-byte signatures of the format's structures.
MARKERS = ("OHDR", "OCHK", "TREE", "SNOD", "HEAP", "GCOL", "FRHP", "FHDB", "FHIB", "FAHD", "FADB", "EAHD", "EAIB", "EASB", "EADB", "BTHD", "BTIN", "BTLF", "FSHD", "SMTB")


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def _each(src: DataFrame, schema: str, rows) -> DataFrame:
    names = [c.strip().split()[0] for c in schema.replace("<", "[").replace(">", "]").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column("file").to_pylist(), b.column("content"), strict=True):
                got = list(rows(file, data.as_buffer().to_pybytes()))
                if got:
                    columns = [pa.array(c, t) for c, t in zip(zip(*got, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names)

    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    types = [kinds[c.strip().split()[1]] for c in schema.split(", ")]
    ship(src.sparkSession)
    return src.mapInArrow(run, schema)


def _as_signed(address: int | None) -> int | None:
    return None if address is None or address >= 1 << 63 else address


def datasets(src: DataFrame) -> DataFrame:
    """A row for each dataset, and one for each object that can't be read, with the reason."""

    def rows(file: str, data: bytes):
        try:
            _, _, found = container.survey(data)
        except container.Unsupported as e:
            return [(file, None, None, None, None, None, None, None, "unsupported", str(e))]
        except ValueError as e:
            return [(file, None, None, None, None, None, None, None, "damaged", str(e))]
        out = [
            (file, d.path, d.address, list(d.shape), list(d.chunks), d.dtype, d.layout, [f[0] for f in d.filters], "candidate", None)
            for d in found.datasets
        ]
        return out + [(file, p, None, None, None, None, None, None, k, r) for p, k, r in found.refused]

    return _each(src, DATASETS, rows)


def links(src: DataFrame) -> DataFrame:
    def rows(file: str, data: bytes):
        try:
            _, _, found = container.survey(data)
        except ValueError:
            return []
        return [(file, group, x.name, x.kind, _as_signed(x.target), x.path) for group, x in found.links]

    return _each(src, LINKS, rows)


def chunks(src: DataFrame) -> DataFrame:
    """Every place of every dataset's chunk grid with its decoded bytes, or why it has none: ``unknown`` (not allocated),
    ``truncated`` (beyond the file), ``decode_failed``, ``decoder_unavailable``, ``unavailable`` (its index is damaged)."""

    def rows(file: str, data: bytes):
        try:
            _, raw, found = container.survey(data)
        except ValueError:
            return
        for d in found.datasets:
            size = d.width
            for n in d.chunks or d.shape:
                size *= n
            filters = [(f[0], f[2]) for f in d.filters]
            seen = set()
            try:
                for c in container.chunks(raw, d):
                    seen.add(c.origin)
                    status, body = "unknown", None
                    if c.offset is not None and c.size:
                        try:
                            body = codecs.decode(raw.at(c.offset, c.size), filters, c.mask, size)
                            status = "accepted"
                        except container.Damaged:
                            status = "truncated"
                        except codecs.DecoderUnavailable:
                            status = "decoder_unavailable"
                        except codecs.DecodeError:
                            status = "decode_failed"
                    yield file, d.path, list(c.origin), _as_signed(c.offset), c.size, c.mask, status, body
                rest = "unknown"
            except (ValueError, struct.error):
                rest = "unavailable"
            if d.chunks:
                for origin in container._origins(d):
                    if origin not in seen:
                        yield file, d.path, list(origin), None, 0, 0, rest, None

    return _each(src, CHUNKS, rows)


VALUES = "file string, path string, index bigint, value double, status string, integer decimal(20,0), text string, element binary"


def _exact(got: np.ndarray) -> list[pa.Array]:
    """value, integer, text and element of decoded elements. A value that a double can't hold is null, never rounded."""
    nulls = lambda t: pa.nulls(got.size, t)
    width = got.dtype.itemsize
    raw = np.ascontiguousarray(got).tobytes()
    element = pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary())
    if got.dtype.kind == "S":
        # a fixed string ends at its padding; one that isn't UTF-8 is there as bytes only
        texts = []
        for i in range(got.size):
            try:
                texts.append(raw[i * width : (i + 1) * width].rstrip(b"\0").decode())
            except UnicodeDecodeError:
                texts.append(None)
        return [nulls(pa.float64()), nulls(pa.decimal128(20, 0)), pa.array(texts, pa.string()), element]
    if got.dtype.kind == "f":
        return [pa.array(got.astype(np.float64)), nulls(pa.decimal128(20, 0)), nulls(pa.string()), element]
    whole = pa.array(got.astype(got.dtype.newbyteorder("=")))
    # every whole number up to 2^53 has a double of its own
    same = np.ones(got.size, bool) if width < 8 else (got <= 2**53) & (got >= (0 if got.dtype.kind == "u" else -(2**53)))
    value = pa.array(got.astype(np.float64), mask=~same)
    return [value, whole.cast(pa.decimal128(20, 0)), nulls(pa.string()), element]


def values(decoded: DataFrame, described: DataFrame) -> DataFrame:
    """Long form: file, path, index (row-major rank in the array), value (double), status, integer, text and element. Edge chunks are
    cropped, and every element of a chunk that isn't accepted is there with nulls.

    ``element`` has the stored bytes of every accepted element. ``integer`` is exact for all whole numbers, ``text`` is the string
    of fixed strings, and ``value`` is null where a double can't hold the element.
    """
    both = decoded.join(described.select("file", "path", "shape", "chunks", "dtype"), ["file", "path"])
    names = [c.split()[0] for c in VALUES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                shape, dims = r["shape"], r["chunks"] or r["shape"]
                inside = [min(c, n - o) for c, n, o in zip(dims, shape, r["origin"], strict=True)]
                at = np.zeros(inside, np.int64)
                for axis, (o, n) in enumerate(zip(r["origin"], inside, strict=True)):
                    stride = int(np.prod(shape[axis + 1 :], dtype=np.int64))
                    spread = [1] * len(shape)
                    spread[axis] = n
                    at = at + ((o + np.arange(n)) * stride).reshape(spread)
                if r["data"] is None:
                    got = [pa.nulls(at.size, t) for t in (pa.float64(), pa.decimal128(20, 0), pa.string(), pa.binary())]
                else:
                    whole = np.frombuffer(r["data"], r["dtype"]).reshape(dims)
                    got = _exact(whole[tuple(slice(0, n) for n in inside)].ravel())
                fixed = [pa.array([r[k]] * at.size, pa.string()) for k in ("file", "path", "status")]
                yield pa.RecordBatch.from_arrays(
                    [fixed[0], fixed[1], pa.array(at.ravel()), got[0], fixed[2], *got[1:]], names
                )

    return both.mapInArrow(run, VALUES)


def markers(src: DataFrame) -> DataFrame:
    """Places of the format's four-byte signatures: file, signature, offset."""

    def rows(file: str, data: bytes):
        for m in MARKERS:
            word, at = m.encode(), -1
            while (at := data.find(word, at + 1)) >= 0:
                yield file, m, at

    return _each(src, "file string, signature string, offset bigint", rows)


def one_byte_corrections(body: bytes, checksum: int) -> list[tuple[int, int]]:
    """All (place, byte) changes that give ``body`` its stored checksum (SURVEY: R08). A repair is justified only if there is one."""
    from ..functions.checksums import lookup3

    out = []
    for at in range(len(body)):
        for b in range(256):
            if b != body[at] and lookup3(body[:at] + bytes([b]) + body[at + 1 :]) == checksum:
                out.append((at, b))
    return out
