"""SimHash near-dedup with pivot distance tables.

Fingerprints are made in Arrow batches (one pass over the texts); everything after that works on distinct 64-bit
fingerprints. Two fingerprints with 3 or fewer differing bits agree in at least two of five blocks of bits, so the ten pairs of
blocks are join keys that lose no link. Within a key, members are sorted by their distance to a first pivot; for a
member only those within 3 of it are looked at, then the distances to all other pivots discard pairs whose largest
coordinate difference is over 3 (the triangle inequality makes that exact), and what survives is verified by XOR and a bit count.
What leaves a task is a spanning forest of the links, never the pairs of a group. Keys with very many members are cut into
tiles, and pairs of tiles are dealt out as tasks of bounded size.

Null or wordless texts have fingerprint zero, linked like any other. Repeated rows fall together in one fingerprint; a null doc_id
counts last for the component id. No documents give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import map_arrow, materialise
from .components import connected_components

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Bits of the five blocks, lowest first.
BLOCKS = (13, 13, 13, 13, 12)
#: Reference fingerprints: fixed pseudo-random ones.
N_PIVOTS = 16
#: Members of a key that one task compares with each other.
TILE = 4096


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**64, n, dtype=np.uint64)


def _spread() -> np.ndarray:
    """For each byte value, its 8 bits as the 8 bytes of a word."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.uint64).ravel()


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For runs of ``counts`` hashes: the word whose bits are set in over half of the run; zero for an empty run."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    counts = counts[full].astype(np.int64)
    # runs are cut into blocks of at most 255, so that eight counters fit into the bytes of one word
    per = -(-counts // 255)
    firsts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    of = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
    block_at = firsts[of] + nth * 255
    run_at = np.cumsum(per) - per
    spread, octets = _spread(), hashes.view(np.uint8).reshape(-1, 8)
    got = np.zeros(len(counts), np.uint64)
    for k in range(8):
        sums = np.add.reduceat(spread[octets[:, k]], block_at)
        totals = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), run_at, axis=0)
        set_bits = np.packbits(2 * totals > counts[:, None], axis=1, bitorder="little").ravel()
        got |= set_bits.astype(np.uint64) << np.uint64(8 * k)
    out[full] = got
    return out


def fingerprint_texts(texts: list[str | None]) -> np.ndarray:
    """The fingerprints of ``texts``: A-Z lower-cased, words split at ASCII white space, 3-word shingles with repeats."""
    from xxhash import xxh64_intdigest as h64

    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    out = []
    at = 0
    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        if len(words) > SHINGLE:
            joined = b" ".join(words)
            ends = []
            n = -1
            for w in words:
                n += len(w) + 1
                ends.append(n)
            starts = [0] + [e + 1 for e in ends[: -SHINGLE]]
            hashes.extend([h64(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=True)])
        elif words:
            hashes.append(h64(b" ".join(words), SEED))
        counts[i] = len(hashes)
        if len(hashes) > 2_000_000:
            done = np.diff(counts[at : i + 1], prepend=0)
            out.append(majority_bits(np.array(hashes, np.uint64), done))
            hashes, at = [], i + 1
    if at < len(texts):
        out.append(majority_bits(np.array(hashes, np.uint64), np.diff(counts[at:], prepend=0)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (bigint, the 64 bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = fingerprint_texts(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got.view(np.int64))], ["doc_id", "fingerprint"])

    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(picked, run, "doc_id bigint, fingerprint bigint")


def _roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Labels of ``n`` items after joining a[i] with b[i]; ``root`` holds the labels so far (smallest member)."""
    while True:
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        before = root.copy()
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == before).all():
            return root


def link_members(prints: np.ndarray, max_bits: int = MAX_BITS, chunk: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the fingerprints of one key: arrays a, b with a's component reached through b."""
    n = len(prints)
    refs = pivots()
    table = np.bitwise_count(prints[:, None] ^ refs[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    prints, table = prints[order], table[order]
    first = table[:, 0]
    stop = np.searchsorted(first, first.astype(np.int16) + max_bits, side="right")
    many = stop - np.arange(n) - 1  # partners after each member, in order of the first coordinate
    root = np.arange(n)
    ends = np.cumsum(many)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk, side="right")))
        k = many[at:to]
        i = np.repeat(np.arange(at, to), k)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
        for p in range(1, table.shape[1]):
            if not len(i):
                break
            near = np.abs(table[i, p] - table[j, p]) <= max_bits
            i, j = i[near], j[near]
        if len(i):
            near = np.bitwise_count(prints[i] ^ prints[j]) <= max_bits
            root = _roots(n, i[near], j[near], root)
        at = to
    linked = np.flatnonzero(root != np.arange(n))
    return prints[linked], prints[root[linked]]


def _pairs_of_small(key: np.ndarray, prints: np.ndarray, table: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within runs of equal ``key``; runs are at most ``most`` long."""
    a, b = [], []
    for d in range(1, most):
        i = np.flatnonzero(key[d:] == key[:-d])
        if not len(i):
            break
        for p in range(table.shape[1]):
            i = i[np.abs(table[i, p] - table[i + d, p]) <= MAX_BITS]
            if not len(i):
                break
        i = i[np.bitwise_count(prints[i] ^ prints[i + d]) <= MAX_BITS]
        a.append(prints[i])
        b.append(prints[i + d])
    none = np.zeros(0, np.uint64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, fingerprint), sorted by key and part: links, key by key. Holds one key's tile pair at a time."""
    small, refs = 48, pivots()
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def runs(key: np.ndarray, prints: np.ndarray):
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(edge, len(key)))
        few = np.repeat(size <= small, size)
        x, y = key[few], prints[few]
        a, b = _pairs_of_small(x, y, np.bitwise_count(y[:, None] ^ refs[None, :]).astype(np.int8), small)
        out = [(a, b)]
        for at, n in zip(edge[size > small], size[size > small], strict=True):
            out.append(link_members(prints[at : at + n]))
        a, b = (np.concatenate([o[k] for o in out]) for k in (0, 1))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy(zero_copy_only=False)
        prints = batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)
        if key[-1] == key[0] and (not held or held[-1][0][-1] == key[0]):
            held.append((key, prints))
            continue
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1
        held.append((key[:cut], prints[:cut]))
        yield from runs(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
        held = [(key[cut:], prints[cut:])]
    if held:
        yield from runs(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))


def links(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (a, b) that span the components of the distinct ``fingerprint`` column at 3 or fewer differing bits."""
    low, at = [], 0
    for n in BLOCKS:
        low.append(((1 << n) - 1) << at)
        at += n
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(
        *[
            F.xxhash64(F.lit(k), F.col("fingerprint").bitwiseAND(F.lit(signed(low[i] | low[j]))))
            for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))
        ]
    )
    dealt = distinct.select("fingerprint", F.explode(keys).alias("key"))
    large = dealt.groupBy("key").count().where(F.col("count") > tile)
    large = large.select(F.col("key").alias("k"), F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    mine = F.pmod(F.xxhash64("fingerprint"), F.col("tiles")).cast("int")
    others = F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = (
        dealt.join(large, dealt["key"] == large["k"], "left")
        .select("key", "fingerprint", "tiles", mine.alias("mine"), F.explode(others).alias("other"))
        .select(
            F.when(F.col("tiles").isNull(), F.col("key"))
            .otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
            .alias("key"),
            "fingerprint",
        )
    )
    return map_arrow(dealt.repartition("key").sortWithinPartitions("key"), _link_batches, "a bigint, b bigint")


def _grouped(prints: DataFrame) -> DataFrame:
    """f, root and component_id of each distinct ``fingerprint`` of ``prints`` (doc_id, fingerprint)."""
    distinct = materialise(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = connected_components(links(distinct.select("fingerprint")))
    rooted = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least"
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fingerprint", "root").join(ids, "root").select(F.col("fingerprint").alias("f"), "root", "component_id")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (bigint) and component_id (the smallest doc_id reachable by links, itself included) of every row."""
    prints = materialise(fingerprints(docs), "fingerprints")
    named = _grouped(prints)
    return prints.join(named, prints["fingerprint"] == named["f"]).select("doc_id", "fingerprint", "component_id")


def _marked(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the fingerprint of each row as a last column ``name``."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = fingerprint_texts(b.column(at).cast(pa.string()).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got.view(np.int64))], [*b.schema.names, name])

    return map_arrow(docs, run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each component: the one with the smallest doc_id (a null one counts last), then the smallest fingerprint, then
    the smallest text; of wholly equal rows any.

    The columns stay those of ``docs``. A row is known by its doc_id only where no other row has that; rows of shared doc_ids
    and without one are told apart by their fingerprints, so unlike texts with one doc_id are each kept or dropped on their own.
    """
    mark = f"fingerprint_{uuid.uuid4().hex}"
    prints = materialise(fingerprints(docs), "fingerprints")
    named = _grouped(prints)
    rows = prints.groupBy("doc_id", "fingerprint").agg(F.count(F.lit(1)).alias("n"))
    best = (
        rows.join(named, rows["fingerprint"] == named["f"])
        .groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fingerprint")).alias("best"))
        .select(F.col("best.doc_id").alias("__id"), F.col("best.fingerprint").alias("__print"))
    )
    best = materialise(best, "kept-fingerprints")
    shared = rows.groupBy("doc_id").agg(F.sum("n").alias("n")).where((F.col("n") > 1) | F.col("doc_id").isNull())
    shared = materialise(shared.select(F.col("doc_id").alias("__shared")), "shared-ids")
    own = F.col("doc_id").cast("bigint")
    alone = best.join(shared, best["__id"].eqNullSafe(shared["__shared"]), "left_anti").select("__id")
    kept = docs.join(alone, own == F.col("__id"), "left_semi")
    if shared.isEmpty():
        return kept
    some = _marked(docs.join(shared, own.eqNullSafe(F.col("__shared")), "left_semi"), mark)
    some = some.join(best, own.eqNullSafe(F.col("__id")) & (F.col(mark) == F.col("__print")), "left_semi")
    # pre-aggregated, as one doc_id may be that of very many rows
    once = some.groupBy(own.alias("__id"), mark).agg(
        F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.coalesce("text", F.lit(""))).alias("row")
    )
    return kept.unionByName(once.select("row.*"))


def op2_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
