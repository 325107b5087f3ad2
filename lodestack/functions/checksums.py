"""Checksums of array containers (SURVEY: G09, G10, F23, F30): plain functions, and pandas UDFs over binary columns."""

from __future__ import annotations

import numpy as np
import pandas as pd

MASK = 0xFFFFFFFF


def fletcher32(data: bytes) -> int:
    """Fletcher-32 over big-endian 16-bit words, an odd last byte in the upper half; sums are folded, not reduced."""
    words = np.frombuffer(data[: len(data) // 2 * 2], ">u2").astype(np.uint64)
    low = high = 0
    for at in range(0, len(words), 360):
        part = words[at : at + 360]
        n = len(part)
        high += n * low + int((part * np.arange(n, 0, -1, dtype=np.uint64)).sum())
        low += int(part.sum())
        low, high = (low & 0xFFFF) + (low >> 16), (high & 0xFFFF) + (high >> 16)
        # one fold may leave more than 16 bits where the block's second sum was large
        high = (high & 0xFFFF) + (high >> 16)
    if len(data) % 2:
        low += data[-1] << 8
        high += low
        low, high = (low & 0xFFFF) + (low >> 16), (high & 0xFFFF) + (high >> 16)
    low, high = (low & 0xFFFF) + (low >> 16), (high & 0xFFFF) + (high >> 16)
    return high << 16 | low


def _turn(x: int, n: int) -> int:
    return (x << n | x >> (32 - n)) & MASK


# The rotations of the published mixing steps.
_MIX = (4, 6, 8, 16, 19, 4)
_FINAL = (14, 11, 25, 16, 4, 14, 24)


def lookup3(data: bytes, seed: int = 0) -> int:
    """Bob Jenkins' lookup3 (hashlittle) of bytes."""
    state = [(0xDEADBEEF + len(data) + seed) & MASK] * 3
    tail = len(data) - (len(data) - 1) // 12 * 12 if data else 0
    body = len(data) - tail
    for at in range(0, body, 12):
        for k in range(3):
            state[k] = (state[k] + int.from_bytes(data[at + 4 * k : at + 4 * k + 4], "little")) & MASK
        # each step takes the register before from the current one, turns it in, and adds the third to the former
        for step, n in enumerate(_MIX):
            i, j, k = step % 3, (step + 2) % 3, (step + 1) % 3
            state[i] = (state[i] - state[j]) & MASK ^ _turn(state[j], n)
            state[j] = (state[j] + state[k]) & MASK
    if not tail:
        return state[2]
    last = data[body:].ljust(12, b"\0")
    for k in range(3):
        state[k] = (state[k] + int.from_bytes(last[4 * k : 4 * k + 4], "little")) & MASK
    for step, n in enumerate(_FINAL):
        i, j = (2 + step) % 3, (1 + step) % 3
        state[i] = ((state[i] ^ state[j]) - _turn(state[j], n)) & MASK
    return state[2]


def udf(f):
    """A pandas UDF (binary to bigint) of a checksum."""
    from pyspark.sql import SparkSession
    from pyspark.sql.functions import pandas_udf

    from ..session import ship

    if active := SparkSession.getActiveSession():
        ship(active)

    @pandas_udf("bigint")
    def over(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else f(bytes(b))).astype("Int64")

    return over
