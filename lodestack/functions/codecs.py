"""Chunk filters (SURVEY: F06-F10): inflate, byte shuffle, LZF, Fletcher-32, and the pipeline that undoes them.

Decoding tells apart: ``accepted``, ``decode_failed`` (the bytes contradict the filter) and ``decoder_unavailable``.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd

from .checksums import fletcher32

# Registered filter numbers.
DEFLATE, SHUFFLE, FLETCHER32, LZF = 1, 2, 3, 32000


class DecodeError(ValueError):
    """The stored bytes don't decode."""


class DecoderUnavailable(ValueError):
    """There is no decoder for a filter."""


def inflate(data: bytes, limit: int) -> bytes:
    """One whole zlib stream of at most ``limit`` bytes; anything after its end is an error."""
    machine = zlib.decompressobj()
    try:
        out = machine.decompress(data, limit + 1)
    except zlib.error as e:
        raise DecodeError(str(e)) from e
    if len(out) > limit or not machine.eof or machine.unused_data:
        raise DecodeError("stream too long, cut short, or followed by more")
    return out


def shuffle(data: bytes, width: int) -> bytes:
    n = len(data) // width
    whole = np.frombuffer(data, np.uint8, n * width).reshape(n, width).T.tobytes()
    return whole + data[n * width :]


def unshuffle(data: bytes, width: int) -> bytes:
    """Undo the byte transpose; a partial element at the end stays as it is."""
    n = len(data) // width
    whole = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T.tobytes()
    return whole + data[n * width :]


def lzf(data: bytes, limit: int) -> bytes:
    """LZF: a control byte under 32 starts a literal run; else it holds a length and a distance back, which may overlap."""
    out, at = bytearray(), 0
    try:
        while at < len(data):
            control = data[at]
            at += 1
            if control < 32:
                run = data[at : at + control + 1]
                if len(run) != control + 1:
                    raise DecodeError("literal run cut short")
                out += run
                at += control + 1
            else:
                length = control >> 5
                if length == 7:
                    length += data[at]
                    at += 1
                back = len(out) - ((control & 31) << 8 | data[at]) - 1
                at += 1
                if back < 0:
                    raise DecodeError("reference before the start")
                for i in range(length + 2):
                    out.append(out[back + i])
            if len(out) > limit:
                raise DecodeError("output too long")
    except IndexError as e:
        raise DecodeError("input cut short") from e
    return bytes(out)


def checked(data: bytes) -> bytes:
    """Take the Fletcher-32 value off the end. Both byte orders of its halves are in use."""
    if len(data) < 4:
        raise DecodeError("no room for a checksum")
    body, stored = data[:-4], int.from_bytes(data[-4:], "little")
    value = fletcher32(body)
    swapped = int.from_bytes(b"".join(value.to_bytes(4, "little")[i : i + 2][::-1] for i in (0, 2)), "little")
    if stored not in (value, swapped):
        raise DecodeError("checksum differs")
    return body


#: Filter number to decoder(data, values, limit). Others may be registered.
DECODERS: dict[int, Callable[[bytes, Sequence[int], int], bytes]] = {
    DEFLATE: lambda d, v, n: inflate(d, n),
    SHUFFLE: lambda d, v, n: unshuffle(d, v[0]),
    FLETCHER32: lambda d, v, n: checked(d),
    LZF: lambda d, v, n: lzf(d, n),
}


def decode(data: bytes, filters: Sequence[tuple[int, Sequence[int]]], mask: int, size: int) -> bytes:
    """Undo a pipeline, the last filter first. Bit i of ``mask`` says that filter i was not applied to this chunk."""
    limit = size + 4 * (len(filters) + 1)
    for i in range(len(filters) - 1, -1, -1):
        if mask >> i & 1:
            continue
        number, values = filters[i]
        if number not in DECODERS:
            raise DecoderUnavailable(f"filter {number}")
        data = DECODERS[number](data, values, limit)
    if len(data) != size:
        raise DecodeError(f"{len(data)} bytes, not {size}")
    return data


def decoded(chunks, filters: Sequence[tuple[int, Sequence[int]]], size: int):
    """Decode a DataFrame of chunks (payload binary, filter_mask bigint, anything else): adds ``status`` and ``data``."""
    from pyspark.sql import functions as F
    from pyspark.sql.functions import pandas_udf

    from ..session import ship

    ship(chunks.sparkSession)
    filters = [(n, list(v)) for n, v in filters]

    @pandas_udf("status string, data binary")
    def run(payload: pd.Series, mask: pd.Series) -> pd.DataFrame:
        rows = []
        for p, m in zip(payload, mask, strict=True):
            if p is None:
                rows.append(("unavailable", None))
                continue
            try:
                rows.append(("accepted", decode(bytes(p), filters, int(m), size)))
            except DecoderUnavailable:
                rows.append(("decoder_unavailable", None))
            except DecodeError:
                rows.append(("decode_failed", None))
        return pd.DataFrame(rows, columns=["status", "data"])

    return chunks.withColumn("__d", run("payload", F.coalesce("filter_mask", F.lit(0)))).select(
        *chunks.columns, F.col("__d.status").alias("status"), F.col("__d.data").alias("data")
    )
