"""Embedding near-dedup with an inverted multi-index.

Vectors are scaled to length one and cut into halves; each half has its own codebook, and the product grid of the two makes the
cells. The codebooks grow with the square root of the number of vectors, so that a cell keeps about ``IN_CELL`` of them and the work
for a vector stays the same. A vector lives in one cell. It looks into the nearest cells in the order of the summed half distances (the
multi-sequence order), as many as the calibration asks for: enough to find ``recall`` of the partners at exactly the least
cosine, in random directions from the sample's vectors (the hardest links there are), and of the sample's own links, from either
side, but never more than ``MOST_VISITS``. Codebooks are fitted on a bounded sample (``fit_rows`` vectors, or 16 for each code, of
which there are at most ``MOST_CODES``, by hash order); every vector is indexed and searched.

Candidates are verified by cosine in double precision. Links are counted where they are found and leave a task as counts and as a
spanning forest, never as the pairs of a cell. A pair that both sides find is counted once for each, as a resident
knows from its own list of visits whether it comes by itself. Cells with very many vectors are cut into tiles.

Vectors of different numbers of dimensions have no cosine and never link; each number has an index of its own, and those with
at most ``tile`` distinct vectors are a single cell each, searched exactly. Equal vectors (told by 128-bit digests) are one entry
with a multiplicity, and each copy has the others as links. Null or zero vectors, and those with null or non-finite components, link
with nothing. A null vec_id counts as a vector but not for component ids. Repeated rows are copies. No rows give no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise
from .components import connected_components

COSINE = 0.95
FIT_ROWS = 12_000
#: Recall of partners at exactly the least cosine, and of the sample's own links.
TARGET_RECALL, SAMPLE_RECALL = 0.98, 0.995
#: Vectors in a cell on average, and the fewest and most codes of a half.
IN_CELL = 64
LEAST_CODES, MOST_CODES = 16, 2048
MOST_VISITS = 256
TILE = 2048


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        for c in range(len(centres)):
            if (own := x[near == c]).size:
                centres[c] = own.mean(0)
    return centres


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes_for(n: int) -> int:
    """Codes of a half for ``n`` vectors."""
    return int(np.clip(np.ceil(np.sqrt(n / IN_CELL)), LEAST_CODES, MOST_CODES))


def visits(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """The first ``n`` cells of each unit vector in multi-sequence order, the nearest first.

    With both halves' codes sorted by distance, the pair of ranks (i, j) can be among the first n only if
    (i + 1)(j + 1) <= n; over those the n smallest sums are taken.
    """
    half = len(books[0][0])
    near, rank = [], []
    for p, b in zip((x[:, :half], x[:, half:]), books, strict=True):
        d = (p**2).sum(1)[:, None] - 2 * p @ b.T + (b**2).sum(1)
        r = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(b) else np.broadcast_to(np.arange(len(b)), d.shape)
        d = np.take_along_axis(d, r, 1)
        order = np.lexsort((r, d), axis=1)
        rank.append(np.take_along_axis(r, order, 1))
        near.append(np.take_along_axis(d, order, 1))
    i, j = np.array([(i, j) for i in range(min(n, len(books[0]))) for j in range(min(n // (i + 1), len(books[1])))]).T
    first, second = rank[0][:, i], rank[1][:, j]
    best = (near[0][:, i] + near[1][:, j]).argsort(1, kind="stable")[:, :n]
    return np.take_along_axis(first, best, 1) * len(books[1]) + np.take_along_axis(second, best, 1)


def _needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs with visits a[i] and b[i]: how many visits find one of the pair from the other."""
    at_a = np.where((hit := a == b[:, :1]).any(1), hit.argmax(1), a.shape[1])
    at_b = np.where((hit := b == a[:, :1]).any(1), hit.argmax(1), a.shape[1])
    return np.minimum(at_a, at_b) + 1


def fit(sample: np.ndarray, codes: int, recall: float = TARGET_RECALL, least: float = COSINE, trials: int = 2000):
    """Codebooks of the halves, and the number of visits that finds ``recall`` of the links."""
    half = sample.shape[1] // 2
    codes = max(1, min(codes, len(sample) // 4))
    # calibrated on vectors that the codebooks haven't seen, where there are enough
    own = sample[trials:] if len(sample) >= 4 * trials else sample
    books = (kmeans(own[:, :half], codes), kmeans(own[:, half:], codes, seed=4))
    cap = min(MOST_VISITS, len(books[0]) * len(books[1]))
    some = sample[:trials]
    seen = np.concatenate([visits(some[at : at + 512], books, cap) for at in range(0, len(some), 512)])
    # partners at the least cosine, in random directions
    away = np.random.default_rng(8).normal(size=some.shape)
    away -= (away * some).sum(1, keepdims=True) * some
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
    partners = least * some + np.sqrt(1 - least**2) * away
    theirs = np.concatenate([visits(partners[at : at + 512], books, cap) for at in range(0, len(some), 512)])
    n = int(np.quantile(_needed(seen, theirs), recall, method="higher"))
    # and the links that the sample itself holds
    i, j = np.nonzero(np.triu(some @ some.T >= least, 1))
    if len(i):
        i, j = i[:200_000], j[:200_000]
        n = max(n, int(np.quantile(_needed(seen[i], seen[j]), SAMPLE_RECALL, method="higher")))
    return books, min(n, cap)


def _search(least: float, kind: str):
    """A pass over rows (cell, lives, node, times, visits, x), sorted by cell: counts and spanning links. The vectors of a cell
    have the same number of dimensions."""

    def compare(node, times, lives, looks, x, home):
        """Visitors against residents of one cell."""
        res = np.flatnonzero(lives)
        counts = np.zeros(len(node), np.int64)
        a, b = [], []
        root = np.arange(len(node))
        step = max(16, (1 << 19) // max(len(res), 1))
        for at in range(0, len(node), step):
            vis = np.arange(at, min(at + step, len(node)))
            close = x[vis] @ x[res].T >= least
            close &= node[vis][:, None] != node[res][None, :]
            i, j = np.nonzero(close)
            if not len(i):
                continue
            i, j = vis[i], res[j]
            # a resident that looks into the visitor's own cell counts the link there
            comes = (looks[j] == home[i][:, None]).any(1)
            np.add.at(counts, i, times[j])
            np.add.at(counts, j[~comes], times[i[~comes]])
            low, high = np.minimum(i, j), np.maximum(i, j)
            while True:
                ra, rb = root[low], root[high]
                if (ra == rb).all():
                    break
                np.minimum.at(root, ra, np.minimum(ra, rb))
                np.minimum.at(root, rb, np.minimum(ra, rb))
                while (root[root] != root).any():
                    root = root[root]
        linked = np.flatnonzero(root != np.arange(len(node)))
        got = np.flatnonzero(counts)
        a = np.concatenate([node[linked], node[got]])
        b = np.concatenate([node[root[linked]], node[got]])
        n = np.concatenate([np.zeros(len(linked), np.int64), counts[got]])
        return a, b, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table):
            cell = rows["cell"].to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            cols = {c: rows[c].to_numpy() for c in ("node", "times", "lives")}
            looks, x = rows["visits"].to_numpy(), rows["x"].to_pylist()
            out = []
            for at, to in zip(edge, [*edge[1:], len(cell)], strict=True):
                if to - at > 1:
                    s = slice(at, to)
                    own = unit(np.frombuffer(b"".join(x[s]), kind).reshape(to - at, -1).astype(np.float64))
                    mine = np.stack(looks[s])
                    out.append(compare(cols["node"][s], cols["times"][s], cols["lives"][s], mine, own, mine[:, 0]))
            if out:
                a, b, n = (np.concatenate([o[k] for o in out]) for k in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy()
            if held and held[-1].column("cell")[-1].as_py() != cell[0]:
                yield from flush(pa.Table.from_batches(held))
                held = []
            cut = np.flatnonzero(cell != cell[-1])
            if not len(cut):
                held.append(batch)
                continue
            held.append(batch.slice(0, int(cut[-1]) + 1))
            yield from flush(pa.Table.from_batches(held))
            held = [batch.slice(int(cut[-1]) + 1)]
        if held:
            yield from flush(pa.Table.from_batches(held))

    return run


def _placed(vectors: DataFrame, d: int | None, index, kind: str) -> DataFrame:
    """node, times, d, visits and x (the vector's numbers, of ``kind``) of ``vectors``; without an ``index`` all of a d are in one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                found = part.column("embedding").to_numpy(zero_copy_only=False)
                if index is None:
                    looks = [[0]] * len(found)
                else:
                    x = unit(np.stack(found))
                    looks = list(visits(np.pad(x, ((0, 0), (0, d % 2))), *index).astype(np.int32))
                columns = [part.column(c) for c in ("node", "times", "d")]
                columns += [pa.array(looks, pa.list_(pa.int32())), pa.array([v.astype(kind).tobytes() for v in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "times", "d", "visits", "x"])

    return map_arrow(
        vectors.select("node", "times", "d", "embedding"), run, "node bigint, times bigint, d int, visits array<int>, x binary"
    )


def near_duplicates(vectors: DataFrame, least: float = COSINE, fit_rows: int = FIT_ROWS, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding)."""
    # floats travel as floats, and become doubles where they are compared
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    sound &= ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound &= F.exists("embedding", lambda v: v != 0)
    # -0.0 and 0.0 are the same vector, as in grouping
    rows = rows.withColumn("embedding", F.when(sound, F.transform("embedding", lambda v: v + F.lit(0.0))))
    rows = rows.withColumn("key", F.when(F.col("embedding").isNotNull(), F.md5(F.to_json(F.struct("embedding")))))
    # the entries are numbered when they are written, and joined by their digests
    distinct = materialise(
        rows.where(F.col("key").isNotNull())
        .groupBy("key", "embedding")
        .agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("times"))
        .select("*", F.size("embedding").alias("d"), F.monotonically_increasing_id().alias("node")),
        "distinct-vectors",
    )
    # numbers of dimensions with more vectors than a tile: few
    large = {r["d"]: r["n"] for r in distinct.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile).collect()}
    placed = _placed(distinct.where(~F.col("d").isin(*large) if large else F.lit(True)), None, None, kind)
    for d, n in sorted(large.items()):
        own, codes = distinct.where(F.col("d") == d), codes_for(n)
        picked = own.select("embedding", F.xxhash64("key").alias("h"), "key").orderBy("h", "key")
        picked = picked.limit(max(fit_rows, 16 * codes)).select("embedding").toArrow()
        sample = unit(np.stack(picked["embedding"].to_numpy()).astype(np.float64))
        # an odd number gets a zero beside it
        placed = placed.unionByName(_placed(own, d, fit(np.pad(sample, ((0, 0), (0, d % 2))), codes, least=least), kind))
    placed = materialise(placed, "placed-vectors")
    homes = placed.groupBy(F.col("d").alias("hd"), F.element_at("visits", 1).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    homes = homes.select("hd", "h", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    dealt = placed.select("*", F.posexplode("visits").alias("nth", "cell")).withColumn("lives", F.col("nth") == 0)
    dealt = dealt.join(homes, (F.col("d") == F.col("hd")) & (F.col("cell") == F.col("h")))  # no one lives in the other cells
    # A large cell's residents are dealt to tiles, and its visitors, themselves included, come to each tile.
    mine = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    tiles = F.sequence(F.lit(0), F.col("tiles") - 1)
    dealt = dealt.select("node", "times", "d", "visits", "x", "cell", "lives", mine.alias("mine"), F.explode(tiles).alias("tile"))
    # 22 bits for a cell of MOST_CODES x MOST_CODES, 18 for its tiles, the rest for the number of dimensions
    key = F.col("d").cast("long") * (1 << 40) + F.col("cell").cast("long") * (1 << 18) + F.col("tile")
    lives = F.col("lives") & (F.col("mine") == F.col("tile"))
    dealt = dealt.select(key.alias("cell"), "node", "times", "visits", "x", lives.alias("lives"))
    found = materialise(
        map_arrow(dealt.repartition("cell").sortWithinPartitions("cell"), _search(least, kind), "a bigint, b bigint, n bigint"),
        "vector-links",
    )
    counts = found.where("n > 0").groupBy(F.col("a").alias("c_node")).agg(F.sum("n").alias("others"))
    roots = connected_components(found.where("n = 0").select("a", "b"))
    named = (
        distinct.select("node", "key", "least", "times")
        .join(counts, F.col("node") == F.col("c_node"), "left")
        .join(roots.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left")
        .select(
            F.col("key").alias("n_key"), "least", (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n_links"),
            F.coalesce("root", "node").alias("root"),
        )
    )
    ids = named.groupBy(F.col("root").alias("i_root")).agg(F.min("least").alias("component"))
    named = named.join(ids, F.col("root") == F.col("i_root")).select("n_key", "n_links", "component")
    out = rows.select("vec_id", "key").join(named, F.col("key") == F.col("n_key"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of every vector of ``embeddings``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
