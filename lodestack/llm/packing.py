"""Best-fit packing of documents into sequences, improved by swap-based local search.

Which sequences there are depends only on how many pieces have each length, and there are at most ``capacity`` lengths. So the
driver gets that histogram (its size doesn't grow with the documents), packs it, and holds sequences of equal content as
one group with a multiplicity: best fit in descending length first, then local search over the groups with room left, which
moves a piece, exchanges one for one or two for one between any fuller and any less full sequence while the sum of squared
fills rises, until sequences empty. Pieces get their rank among those of their length and take the place that the plan
gives that rank. No text or token list moves for that.

Null texts are empty documents (the end id alone). Repeated rows are packed like others; their ranks may change places between
runs, which changes nothing, as they are equal. No documents give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import map_arrow, materialise

CAPACITY = 2048
END_ID = 0

#: A group of equal sequences: how often, the room left, and the number of pieces by length.
Group = tuple[int, int, dict[int, int]]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens; only the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces; nothing is shuffled."""
    file = path or tokens.vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tokens.parts_of(batch):
                ids, counts = tokens.encode(b.column("text"), file)
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
                n_first = np.where(counts > capacity, (counts - 1) % capacity + 1, counts)
                per = np.where(counts > capacity, -(-counts // capacity), 1)
                of = np.repeat(np.arange(len(counts)), per)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
                start = np.where(nth == 0, 0, n_first[of] + (nth - 1) * capacity)
                length = np.where(nth == 0, n_first[of], capacity)
                at = (np.cumsum(counts) - counts)[of] + start
                crc = [tokens.crc32(ids[i : i + n]) for i, n in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").take(pa.array(of)),
                        pa.array(nth, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(picked, run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(histogram: dict[int, int], capacity: int) -> list[Group]:
    """Best fit in descending length. ``histogram``: number of pieces by length."""
    by_room: dict[int, list[Group]] = {}

    def put(times: int, room: int, held: dict[int, int]) -> None:
        if times:
            by_room.setdefault(room, []).append((times, room, held))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for room in sorted(r for r in by_room if r >= length):
            groups = by_room.pop(room)
            while groups and left:
                times, _, held = groups.pop()
                each = room // length  # best fit goes on in the sequence it has just made tighter
                full = min(times, left // each)
                put(full, room - each * length, held | {length: held.get(length, 0) + each})
                left -= full * each
                times -= full
                if times and 0 < left < each:
                    put(1, room - left * length, held | {length: held.get(length, 0) + left})
                    left, times = 0, times - 1
                put(times, room, held)
                if times:
                    break
            for g in groups:
                put(*g)
            if not left:
                break
        if left:
            each = capacity // length
            put(left // each, capacity - each * length, {length: each})
            if left % each:
                put(1, capacity - left % each * length, {length: left % each})
    return [g for groups in by_room.values() for g in groups]


def least(histogram: dict[int, int], capacity: int) -> int:
    """Fewer sequences than this can't hold the pieces (Martello and Toth): those longer than half never share one, and the
    room that they leave holds shorter ones only."""
    n = np.zeros(capacity + 1, np.int64)
    n[list(histogram)] = list(histogram.values())
    upto = np.append(0, np.cumsum(n))
    tokens_upto = np.append(0, np.cumsum(n * np.arange(capacity + 1)))
    half = capacity // 2
    shortest = np.arange(half + 1)
    with_room = upto[capacity - shortest + 1] - upto[half + 1]
    room = with_room * capacity - (tokens_upto[capacity - shortest + 1] - tokens_upto[half + 1])
    over = tokens_upto[half + 1] - tokens_upto[shortest] - room
    return int((upto[-1] - upto[half + 1] + np.maximum(0, -(-over // capacity))).max())


def _changed(held: dict[int, int], out: list[int], into: list[int]) -> dict[int, int]:
    held = dict(held)
    for x in out:
        held[x] -= 1
        if not held[x]:
            del held[x]
    for x in into:
        held[x] = held.get(x, 0) + 1
    return held


def _sums(held: dict[int, int]) -> tuple[int, int]:
    """Bit sets of the lengths of single pieces and of pairs of pieces."""
    ones = sum(1 << x for x in held)
    twos = 0
    for x, n in held.items():
        twos |= (ones if n > 1 else ones ^ 1 << x) << x
    return ones, twos


def _above(bits: int, most: int) -> int:
    """The bit set of all numbers that are above one of ``bits`` by 1 to ``most``."""
    found, reach = bits << 1, 1
    while reach < most:
        step = min(reach, most - reach)
        found |= found << step
        reach += step
    return found


def _best_change(giver: dict[int, int], taker: dict[int, int], room: int) -> tuple[int, list[int], list[int]] | None:
    """The change that fills ``taker`` most: (gain, pieces given, pieces taken back)."""
    best: tuple[int, int, bool, tuple[int, ...]] | None = None
    ones, twos = _sums(giver)
    sizes = sorted(taker)
    pairs = ((x, y) for i, x in enumerate(sizes) for y in sizes[i:] if x != y or taker[x] > 1)
    singles = [(y,) for y in sizes]
    for sums, two, backs in ((ones, False, [(), *singles]), (twos, True, singles), (ones, False, pairs)):
        for back in backs:
            most = sum(back) + room
            given = (sums & (1 << most + 1) - 1).bit_length() - 1
            gain = given - sum(back)
            if gain > (best[0] if best else 0):
                best = (gain, given, two, back)
        if best and best[0] == room:
            break
    if not best:
        return None
    gain, given, two, back = best
    if not two:
        return gain, [given], list(back)
    x = next(x for x in giver if given - x in giver and (2 * x != given or giver[x] > 1))
    return gain, [x, given - x], list(back)


def improve(groups: list[Group], capacity: int) -> list[Group]:
    """Local search over sequences with room left. Each change makes a fuller sequence fuller at the cost of one less full,
    so the sum of squared fills rises and the search ends; sequences that lose their last piece go.

    It ends when the number of sequences is the least possible, or when no move, exchange of one for one, of two for one or of one
    for two between any two sequences makes the fuller one fuller. Bit sets tell whether two groups have such a change, so all
    pairs of groups are looked at; two groups without one are not looked at again.
    """
    done = [g for g in groups if not g[1]]
    histogram: dict[int, int] = {}
    for times, _, held in groups:
        for length, each in held.items():
            histogram[length] = histogram.get(length, 0) + times * each
    enough, width = least(histogram, capacity), capacity + 1
    total = sum(g[0] for g in groups)
    room_of = lambda key: capacity - sum(n * k for n, k in key)
    merged: dict[tuple, int] = {}
    for times, room, held in groups:
        if room:
            key = tuple(sorted(held.items()))
            merged[key] = merged.get(key, 0) + times
    # a group's room, the sums that it can give and those that it can take, and when it came; in the order of that
    known: dict[tuple, tuple[int, int, int, int, int]] = {}
    seen: dict[tuple, int] = {}  # whatever came before that has been looked at as a taker
    givers: list[tuple[int, tuple]] = []
    waiting: set[tuple] = set()
    now = 0
    full: dict[tuple, int] = {}

    def wait(key: tuple, room: int) -> None:
        if key not in waiting:
            waiting.add(key)
            heapq.heappush(givers, (-room, key))

    def add(key: tuple) -> None:
        nonlocal now
        now += 1
        room = room_of(key)
        ones, twos = _sums(dict(key))
        known.pop(key, None)
        back = 1 | ones | twos, ones
        takes, fills = (f(back[0]) | f(back[1]) << width for f in (lambda x: _above(x, room), lambda x: x << room))
        known[key] = room, ones | twos << width, takes, fills, now
        seen[key] = 0
        wait(key, room)

    def put(times: int, held: dict[int, int]) -> None:
        if not held:
            return
        key = tuple(sorted(held.items()))
        if not room_of(key):
            full[key] = full.get(key, 0) + times
            return
        before = merged.get(key, 0)
        merged[key] = before + times
        if before > 1:
            return
        add(key)  # also if there was one, which can now give to its like
        room, _, takes, _, _ = known[key]
        for other, (r, gives, _, _, _) in known.items():
            if r >= room and gives & takes:
                wait(other, r)

    if total > enough:
        for key in sorted(merged, key=room_of):
            add(key)
    while givers and total > enough:
        # the least full gives first, to the fullest that can take
        _, giver = heapq.heappop(givers)
        waiting.discard(giver)
        if giver not in merged:
            continue
        room, gives, _, _, _ = known[giver]
        taker, rank = None, 2 * width
        for other in reversed(known):
            r, _, takes, fills, came = known[other]
            if came <= seen[giver]:
                break
            if r <= room and gives & takes and (other != giver or merged[giver] > 1):
                if (at := r if gives & fills else width + r) < rank:
                    taker, rank = other, at
        if taker is None:
            seen[giver] = now
            continue
        change = _best_change(dict(giver), dict(taker), known[taker][0])
        if not change:
            raise AssertionError("the bit sets promise a change that isn't there")
        _, given, back = change
        times = merged[giver] // 2 if giver == taker else min(merged[giver], merged[taker])
        for key in (giver, taker):
            merged[key] -= times
            if not merged[key]:
                del merged[key], known[key], seen[key]
        left = _changed(dict(giver), given, back)
        total -= 0 if left else times
        put(times, left)
        put(times, _changed(dict(taker), back, given))
        if giver in merged:
            wait(giver, room)
    rest = [(times, room_of(key), dict(key)) for found in (full, merged) for key, times in found.items()]
    return done + rest


def plan(histogram: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """For ranges of ranks within a length: the first sequence, how many of the length each holds, and the offset there."""
    rows, ranks, sequence = [], dict.fromkeys(histogram, 0), 0
    for times, _, held in improve(best_fit(histogram, capacity), capacity):
        offset = 0
        for length, each in sorted(held.items(), reverse=True):
            rows.append((length, ranks[length], sequence, each, offset))
            ranks[length] += times * each
            offset += length * each
        sequence += times
    if ranks != histogram:
        raise AssertionError("the plan doesn't place every piece")
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "each", "offset"), table.T, strict=True))


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    spark = docs.sparkSession
    found = materialise(pieces(docs, capacity, end_id, path), "pieces")
    # at most ``capacity`` rows
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # a length may be that of very many pieces: they are numbered in salted shares
    salts = 4 * max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    shares = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = shares.select(
        F.col("length").alias("l"),
        F.col("salt").alias("s"),
        F.coalesce(
            F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("before"),
    )
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("nth", F.row_number().over(inside) - 1)
        .join(before, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s")))
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    )
    where = plan(histogram, capacity)
    steps = int(where["rank"].max(initial=0)) + max(histogram.values(), default=0) + 1
    keys = where["length"] * steps + where["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = np.searchsorted(keys, length * steps + rank, side="right") - 1
            nth = rank - where["rank"][row]
            each = where["each"][row]
            got = [pa.array(where["sequence"][row] + nth // each), pa.array(where["offset"][row] + nth % each * length)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + got, [*names, "sequence_id", "offset"])

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return map_arrow(ranked, run, schema)


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
