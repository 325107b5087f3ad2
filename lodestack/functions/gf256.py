"""Arithmetic in GF(256) and erasure coding (SURVEY: G12, F11, R30).

Row j of the parity weighs member i by (i + 1)^j. Restoring solves that system for the missing members, all of a stripe or
none.
"""

from __future__ import annotations

import numpy as np

#: Fixed value: the polynomial x^8 + x^4 + x^3 + x^2 + 1.
POLYNOMIAL = 0x11D


def _tables() -> tuple[np.ndarray, np.ndarray]:
    power = np.zeros(510, np.uint8)
    log = np.zeros(256, np.int64)
    x = 1
    for i in range(255):
        power[i] = power[i + 255] = x
        log[x] = i
        x <<= 1
        if x & 0x100:
            x ^= POLYNOMIAL
    return power, log


POWER, LOG = _tables()


def multiply(a, b) -> np.ndarray:
    a, b = np.asarray(a, np.uint8), np.asarray(b, np.uint8)
    return np.where((a == 0) | (b == 0), 0, POWER[LOG[a] + LOG[b]]).astype(np.uint8)


def inverse(a: int) -> int:
    if not a:
        raise ZeroDivisionError("0 has no inverse")
    return int(POWER[255 - LOG[a]])


def weight(member: int, row: int) -> int:
    return int(POWER[LOG[member + 1] * row % 255])


def parity(members: list[bytes], rows: int) -> list[bytes]:
    """Parity rows of members, padded with zeros to the longest."""
    width = max(map(len, members), default=0)
    data = np.array([np.frombuffer(m.ljust(width, b"\0"), np.uint8) for m in members]).reshape(len(members), width)
    out = []
    for row in range(rows):
        weighed = [multiply(d, weight(i, row)) for i, d in enumerate(data)]
        out.append(np.bitwise_xor.reduce(weighed, axis=0).astype(np.uint8).tobytes() if weighed else b"")
    return out


def restore(members: list[bytes | None], rows: list[bytes | None], lengths: list[int]) -> list[bytes] | None:
    """All members, the missing ones solved from parity; None where there are more missing members than parity rows."""
    lost = [i for i, m in enumerate(members) if m is None]
    have = [j for j, r in enumerate(rows) if r is not None][: len(lost)]
    if len(have) < len(lost):
        return None
    if not lost:
        return [m for m in members if m is not None]
    width = max(len(rows[j]) for j in have)
    left = []
    for j in have:
        total = np.frombuffer(rows[j].ljust(width, b"\0"), np.uint8).copy()
        for i, m in enumerate(members):
            if m is not None:
                total ^= multiply(np.frombuffer(m.ljust(width, b"\0")[:width], np.uint8), weight(i, j))
        left.append(total)
    system = np.array([[weight(i, j) for i in lost] for j in have], np.uint8)
    for c in range(len(lost)):
        pivot = next((r for r in range(c, len(lost)) if system[r, c]), None)
        if pivot is None:
            return None
        system[[c, pivot]], left[c], left[pivot] = system[[pivot, c]], left[pivot], left[c]
        scale = inverse(int(system[c, c]))
        system[c], left[c] = multiply(system[c], scale), multiply(left[c], scale)
        for r in range(len(lost)):
            if r != c and system[r, c]:
                factor = system[r, c]
                left[r] = left[r] ^ multiply(left[c], factor)
                system[r] = system[r] ^ multiply(system[c], factor)
    solved = dict(zip(lost, left, strict=True))
    return [m if m is not None else solved[i].tobytes()[: lengths[i]] for i, m in enumerate(members)]
