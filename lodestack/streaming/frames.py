"""Frames for journals and pipes (SURVEY: T01, T03): 8 bytes of length, a JSON header, the payload."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

MOST_HEADER, MOST_PAYLOAD = 1 << 20, 1 << 30


def pack(header: dict, payload: bytes = b"") -> bytes:
    head = json.dumps(header | {"size": len(payload), "sha256": hashlib.sha256(payload).hexdigest()}, sort_keys=True).encode()
    if len(head) > MOST_HEADER or len(payload) > MOST_PAYLOAD:
        raise ValueError("frame too large")
    return len(head).to_bytes(8, "little") + head + payload


def unpack(data: bytes) -> Iterator[tuple[dict, bytes, int]]:
    """Header, payload and end of each whole frame. A frame that was cut off at the end isn't given, so a journal goes on from
    the last end; a frame whose payload has another digest is an error."""
    at = 0
    while at + 8 <= len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        if n > MOST_HEADER:
            raise ValueError("header too large")
        if at + 8 + n > len(data):
            return
        header = json.loads(data[at + 8 : at + 8 + n])
        size = header["size"]
        if not 0 <= size <= MOST_PAYLOAD:
            raise ValueError("payload too large")
        end = at + 8 + n + size
        if end > len(data):
            return
        payload = data[at + 8 + n : end]
        if hashlib.sha256(payload).hexdigest() != header["sha256"]:
            raise ValueError("payload differs from its digest")
        yield header, payload, end
        at = end
