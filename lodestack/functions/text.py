"""Text forms (SURVEY: F14, F21-F24, F26)."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(value) -> str:
    """JSON with sorted keys and no white space; what isn't JSON is refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False, ensure_ascii=True)


def token(value) -> str:
    """A canonical token of an element: bytes in base64 under their own tag, records as sorted objects, arrays in order."""

    def plain(x):
        if isinstance(x, bytes | bytearray):
            return {"bytes": base64.b64encode(bytes(x)).decode()}
        if isinstance(x, dict):
            return {"record": {str(k): plain(v) for k, v in x.items()}}
        if isinstance(x, list | tuple):
            return {"array": [plain(v) for v in x]}
        return x

    return canonical(plain(value))


def from_token(text: str):
    def back(x):
        if isinstance(x, dict):
            ((kind, held),) = x.items()
            if kind == "bytes":
                return base64.b64decode(held, validate=True)
            return {k: back(v) for k, v in held.items()} if kind == "record" else [back(v) for v in held]
        return x

    return back(json.loads(text))


def shown(path: str, most: int = 200) -> str:
    """A path for display: control characters escaped, long ones cut in the middle."""
    text = "".join(c if c.isprintable() else json.dumps(c)[1:-1] for c in path)
    return text if len(text) <= most else text[: most // 2] + "..." + text[-(most - most // 2 - 3) :]


def rebased(report, old: str, new: str):
    """A report with the prefix of every dataset path in it replaced."""
    if isinstance(report, dict):
        return {k: rebased(v, old, new) for k, v in report.items()}
    if isinstance(report, list):
        return [rebased(v, old, new) for v in report]
    if isinstance(report, str) and (report == old or report.startswith(old.rstrip("/") + "/")):
        return new.rstrip("/") + report[len(old.rstrip("/")) :] or "/"
    return report


def numbered(pattern: str, block: int) -> str:
    """A source name with its block number: ``%b`` is the number, ``%%`` a per cent sign, anything else after ``%`` is refused."""

    def one(m: re.Match) -> str:
        if m[0] not in ("%b", "%%"):
            raise ValueError(f"{m[0]} in a name pattern")
        return str(block) if m[0] == "%b" else "%"

    return re.sub(r"%.?", one, pattern)


def block_of(name: Column, pattern: str) -> Column:
    """The block number that a name has under a pattern with one ``%b``; null where it doesn't fit."""
    before, _, after = pattern.partition("%b")
    found = F.regexp_extract(name, f"^{re.escape(before)}([0-9]+){re.escape(after)}$", 1)
    return F.when(found != "", found).cast("bigint")


def is_digest(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def unit_check(rows: Sequence[dict], key: str) -> None:
    """Refuse rows whose key repeats."""
    if len({r[key] for r in rows}) != len(rows):
        raise ValueError(f"{key} repeats")
