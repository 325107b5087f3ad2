"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of two blocks of ``STEP`` words. All words are features, hashed into ``FEATURES`` buckets; words keep their own 32-bit
code for verification. Inverse document frequencies come from all blocks of all documents. Buckets in more than ``COMMON`` of
the blocks are no features (their words do count in verification), unless an item would keep too few. A randomised SVD of the
TF-IDF blocks A gives a latent space of ``DIMENSIONS``, whatever the number of items: with random directions R, every task forms A'AR of its
blocks in one pass, Spark adds these in slices, and the driver gets one matrix of fixed size, from which the single-pass (Nystrom) form
of the decomposition follows. The items are rows of A as well, with ``ITEM_ENERGY`` times the energy of all blocks in total, so that
what they are about has its share of the space, even if it leaked only once.

Items are cut into parts of about a passage's length, and every passage is compared with every part by cosine in that space, so
that the cosine doesn't fall with the item's length. The passage's norm is that of its projection, and ``NORM_SHARE`` of what a passage
of its length has on average, so that a stray word is no match. What is at least ``COSINE`` is verified with the whole item against
the words around: the longest common subsequence must hold ``LCS`` of the item's words, or ``LCS_WITH_ANSWER`` of them
when most of the item's last words (its answer) are there, too. That catches inserted, dropped or replaced words.

The documents are tokenised once and read three times, however many items there are, up to ``ITEM_BLOCK`` parts (a bound on what is
broadcast); beyond that only the search is repeated.

Null texts have no words. Items that are null or have fewer than ``LEAST_WORDS`` words are too short to tell and are ignored; without
items nothing is found. Repeated documents are each found; repeated items count as the smallest item_id. Extra columns
pass through. Nothing is grouped by passage or item, so a passage may stand in any share of the documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICED, map_arrow, materialise, sliced, summed
from .tokens import parts_of
from .words import word_codes

STEP = 24
#: Parts of items that are searched at once: their words and vectors take some 40 MB.
ITEM_BLOCK = 50_000
#: Parts that a chunk of passages is compared with at a time.
PARTS_AT_ONCE = 2048
FEATURES = 1 << 14
DIMENSIONS = 64
ITEM_ENERGY = 1.0
COSINE = 0.28
NORM_SHARE = 0.5
LCS = 0.7
LCS_WITH_ANSWER = 0.55
ANSWER_WORDS = 8
LEAST_WORDS = 8
#: Segments that are summed one by one.
FEW_SEGMENTS = 8
#: Bits of a word's code by which an item's words are looked up before a subsequence is sought.
LOOKUP = 12
#: Inverse document frequencies are held between these, so that a passage found in many documents keeps its weight.
LEAST_IDF, MOST_IDF = 1.0, 3.0
#: Share of blocks beyond which a bucket is no feature, and the share of its words that an item keeps at least.
COMMON, KEPT = 0.01, 0.3


def words_of(text: str | None) -> list[str]:
    return re.sub(r"[^\w\s]|_", " ", (text or "").lower()).split()


def codes_of(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), np.uint32, len(words))


def n_parts(n_words: int) -> int:
    """In how many parts an item is searched: each about as long as a passage, and none above one and a half."""
    return max(1, round(n_words / (2 * STEP)))


@dataclass
class Items:
    """Benchmark items: ids, and their words as codes."""

    ids: list[int] = field(default_factory=list)
    codes: list[np.ndarray] = field(default_factory=list)

    def parts(self) -> tuple[list[np.ndarray], np.ndarray]:
        """The items cut for the search: the codes of each part, and its item's position."""
        cut = [np.array_split(c, n_parts(len(c))) for c in self.codes]
        return [part for parts in cut for part in parts], np.repeat(np.arange(len(cut)), [len(parts) for parts in cut])


def item_blocks(benchmark: DataFrame, size: int = ITEM_BLOCK) -> Iterator[Items]:
    """The benchmark, read once as a stream of rows, in blocks of up to ``size`` parts of items; an item of more has one of its own."""
    seen: set[bytes] = set()
    block, parts = Items(), 0
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    for item_id, text in rows.orderBy("item_id", "text").toLocalIterator():
        codes = codes_of(words_of(text))
        if len(codes) < LEAST_WORDS or codes.tobytes() in seen:
            continue
        if block.ids and parts + n_parts(len(codes)) > size:
            yield block
            block, parts = Items(), 0
        seen.add(codes.tobytes())
        block.ids.append(item_id)
        block.codes.append(codes)
        parts += n_parts(len(codes))
    if block.ids:
        yield block


def coded(docs: DataFrame) -> DataFrame:
    """doc_id and codes (binary, uint32) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in parts_of(batch):
                codes, counts = word_codes(b.column("text"), codes_of, bare=True)
                ends = np.cumsum(counts)
                rows = [codes[i:j].tobytes() for i, j in zip(ends - counts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "codes"])

    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(picked, run, "doc_id bigint, codes binary")


def _chunks(codes: np.ndarray, counts: np.ndarray, most: int = 1 << 13) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of documents with about ``most`` words, and their codes."""
    ends = np.cumsum(counts)
    group = ends // most
    edges = np.flatnonzero(np.diff(group, prepend=-1, append=-2))
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        yield int(i), int(j), codes[ends[i] - counts[i] : ends[j - 1]]


def _blocks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block of each word; the document of each block; whether a block is the last of its document. A last block of
    under half a step goes to the one before it."""
    per = np.maximum(1, (counts + STEP // 2) // STEP)
    first = np.cumsum(per) - per
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    of = np.repeat(first, counts) + np.minimum(place // STEP, np.repeat(per - 1, counts))
    doc = np.repeat(np.arange(len(counts)), per)
    last = np.zeros(len(doc), bool)
    last[np.cumsum(per) - 1] = True
    return of, doc, last


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        rows = b.column("codes").to_pylist()
        counts = np.array([len(x) // 4 for x in rows], np.int64)
        for i, j, part in _chunks(np.frombuffer(b"".join(rows), np.uint32), counts):
            yield part, counts[i:j]


def buckets(codes: np.ndarray) -> np.ndarray:
    return (codes & np.uint32(FEATURES - 1)).astype(np.int64)


def frequencies(codes: DataFrame) -> tuple[np.ndarray, int]:
    """In how many blocks each bucket stands, and the number of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, np.int64)
        for got, counts in _read(batches):
            of, doc, _ = _blocks(counts)
            bucket = buckets(got)
            order = np.argsort(bucket.astype(np.uint16), kind="stable")  # blocks ascend within a bucket
            bucket, of = bucket[order], of[order]
            first = (np.diff(bucket, prepend=-1) > 0) | (np.diff(of, prepend=-1) != 0)
            total[:FEATURES] += np.bincount(bucket[first], minlength=FEATURES)
            total[FEATURES] += len(doc)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["word", "n"])

    rows = map_arrow(codes, run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(FEATURES + 1, np.int64)
    out[rows["word"].to_numpy()] = rows["n"].to_numpy()
    return out[:FEATURES], int(out[FEATURES])


def weights(df: np.ndarray, n_blocks: int, parts: list[np.ndarray]) -> np.ndarray:
    """The weight of each bucket: its held inverse document frequency; 0 where it is no feature."""
    idf = np.clip(np.log((n_blocks + 1) / (df + 1)) / 2, LEAST_IDF, MOST_IDF)
    use = df <= COMMON * n_blocks
    for part in parts:
        # a part whose passage stands in very many documents has no rare words; then its less frequent ones serve
        own = buckets(part)
        for most in (0.1, 1.0):
            if use[own].sum() >= max(5, KEPT * len(own)):
                break
            use[own] |= df[own] <= most * n_blocks
    return np.where(use, idf, 0.0).astype(np.float32)


def _segment_sums(rows: np.ndarray, index: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of ``rows[index]`` of each segment; segments begin ``at`` these places and none is empty.

    The k-th rows of all segments that have so many are added at once; when few such segments are left, one after the other.
    """
    if not len(at):
        return np.zeros((0, rows.shape[1]), rows.dtype)
    sizes = np.diff(at, append=len(index))
    order = np.argsort(-sizes, kind="stable")
    at, sizes = at[order], sizes[order]
    sums = np.take(rows, index[at], axis=0)
    longer = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), side="left").tolist()  # segments of more than k rows
    for k, n in enumerate(longer, 1):
        if n < FEW_SEGMENTS:
            for i in range(n):
                sums[i] += np.take(rows, index[at[i] + k : at[i] + sizes[i]], axis=0).sum(0)
            break
        sums[:n] += np.take(rows, index[at[:n] + k], axis=0)
    out = np.empty_like(sums)
    out[order] = sums
    return out


def _sums(rows: np.ndarray, bucket: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of ``rows[bucket]`` of each block that has words (``block`` ascends): blocks and sums."""
    at = np.flatnonzero(np.diff(block, prepend=-1))
    return block[at], _segment_sums(rows, bucket, at)


def _add_gram(total: np.ndarray, bucket: np.ndarray, block: np.ndarray, weighted: np.ndarray) -> None:
    """Add A'AR of the blocks to ``total``, but for the weights on its left; ``weighted`` are the weighted directions."""
    if not len(bucket):
        return
    _, sums = _sums(weighted, bucket, block)
    nth = np.cumsum(np.diff(block, prepend=block[0]) > 0)
    order = np.argsort(bucket.astype(np.uint16), kind="stable")
    found = bucket[order]
    at = np.flatnonzero(np.diff(found, prepend=-1))
    total[found[at]] += _segment_sums(sums, nth[order], at)


def latent_space(codes: DataFrame, idf: np.ndarray, parts: list[np.ndarray], k: int = DIMENSIONS, seed: int = 9) -> tuple[np.ndarray, float]:
    """Orthonormal columns, the right singular vectors of the weighted blocks and items; and the share of the energy in them."""
    directions = np.linalg.qr(np.random.default_rng(seed).normal(size=(FEATURES, k)))[0].astype(np.float32)
    weighted = directions * idf[:, None]
    model = codes.sparkSession.sparkContext.broadcast((idf, weighted))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, weighted = model.value
        total, energy = np.zeros((FEATURES, k), np.float32), 0.0
        for got, counts in _read(batches):
            bucket = buckets(got)
            keep = idf[bucket] > 0
            bucket = bucket[keep]
            energy += float((idf[bucket] ** 2).sum())
            _add_gram(total, bucket, _blocks(counts)[0][keep], weighted)
        if energy:
            yield sliced((total * idf[:, None]).ravel(), energy)

    got = summed(map_arrow(codes, run, SLICED), FEATURES * k)
    y, energy = (got[0].reshape(FEATURES, k).astype(np.float64), got[1]) if got else (np.zeros((FEATURES, k)), 0.0)
    bucket, block = buckets(np.concatenate(parts)), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    keep = idf[bucket] > 0
    own = np.zeros((FEATURES, k))
    _add_gram(own, bucket[keep], block[keep], weighted)
    mine = float((idf[bucket] ** 2).sum())
    whole = ITEM_ENERGY * max(energy, 1.0)
    y = y + own * idf[:, None] * (whole / max(mine, 1e-9))
    # C is about Y (R'Y)^-1 Y', with R's columns orthonormal
    y = y + 1e-7 * np.linalg.norm(y) * directions
    inner = directions.T.astype(np.float64) @ y
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    keep = values > values.max() * 1e-9
    space, sizes, _ = np.linalg.svd(y @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    return space.astype(np.float32), min(1.0, float((sizes**2).sum()) / (whole + energy))


def lcs(masks: dict[int, int], n: int, words) -> int:
    """Length of the longest common subsequence of an item of ``n`` words, given as bit masks of its words' places, and
    ``words``; one addition and two bit operations a word (bit-vector form of the dynamic programme)."""
    all_set = (1 << n) - 1
    state = all_set
    for w in words:
        m = masks.get(w)
        if m:
            hit = state & m
            state = ((state + hit) | (state - hit)) & all_set
    return n - state.bit_count()


def _masks(codes) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, c in enumerate(codes):
        out[c] = out.get(c, 0) | 1 << i
    return out


@dataclass
class Model:
    """What a task needs to search texts for a block of items."""

    items: Items
    idf: np.ndarray
    space: np.ndarray
    share: float

    def __post_init__(self) -> None:
        parts, self.item_of = self.items.parts()
        self.rows = self.space * self.idf[:, None]  # a word's vector in the latent space
        bucket, block = buckets(np.concatenate(parts)), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        at, sums = _sums(self.rows, bucket, block)
        self.vectors = np.zeros((len(parts), self.rows.shape[1]), np.float32)
        self.vectors[at] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        self.masks: dict[int, tuple[dict[int, int], np.ndarray]] = {}

    def masks_of(self, item: int) -> tuple[dict[int, int], np.ndarray]:
        """The masks of an item's words, and which low bits of codes its words have."""
        if item not in self.masks:
            if len(self.masks) > 4096:
                self.masks.clear()
            codes = self.items.codes[item]
            has = np.zeros(1 << LOOKUP, bool)
            has[codes & np.uint32((1 << LOOKUP) - 1)] = True
            self.masks[item] = _masks(codes.tolist()), has
        return self.masks[item]

    def near(self, got: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(passages, parts, cosines) of what is to be verified; a passage is known by its first block."""
        of, doc, last = _blocks(counts)
        n, bucket = len(doc), buckets(got)
        weight = self.idf[bucket]
        z = np.zeros((n, self.rows.shape[1]), np.float32)
        at, sums = _sums(self.rows, bucket[weight > 0], of[weight > 0])
        z[at] = sums
        # counts above one in a block are rare: the sum of squares takes them as separate words
        square = np.bincount(of, np.where(weight > 0, weight, LEAST_IDF) ** 2, n)
        follows = np.flatnonzero(~last)
        if len(follows):
            z[follows] += z[follows + 1].copy()
            square[follows] += square[follows + 1].copy()
        z /= np.sqrt((z**2).sum(1) + NORM_SHARE * self.share * square + 1e-9)[:, None].astype(np.float32)
        for k in range(0, len(self.vectors), PARTS_AT_ONCE):
            dots = z @ self.vectors[k : k + PARTS_AT_ONCE].T
            p, part = np.nonzero(dots >= COSINE)
            yield p, part + k, dots[p, part]

    def search(self, codes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, float, int, bool]]:
        """(document, item, cosine, common words, answer found) of what is verified, documents by their position."""
        for i, j, got in _chunks(codes, counts):
            per_doc = counts[i:j]
            _, doc, _ = _blocks(per_doc)
            starts = np.cumsum(per_doc) - per_doc
            first_block = np.searchsorted(doc, np.arange(len(per_doc)))
            low = got & np.uint32((1 << LOOKUP) - 1)
            done: set[tuple[int, int]] = set()
            for p, part, cosine in (x for near in self.near(got, per_doc) for x in zip(*(a.tolist() for a in near), strict=True)):
                d, item = int(doc[p]), int(self.item_of[part])
                if (d, item) in done:
                    continue
                own, place = self.items.codes[item], (p - int(first_block[d])) * STEP
                size, (masks, has) = len(own), self.masks_of(item)
                a = int(starts[d]) + max(0, place - size)
                b = int(starts[d]) + min(int(per_doc[d]), place + 3 * STEP + size)
                # a common subsequence has no more words than the item's words here, by their low bits
                if np.count_nonzero(has[low[a:b]]) < LCS_WITH_ANSWER * size:
                    continue
                if lcs(masks, size, got[a:b].tolist()) < LCS_WITH_ANSWER * size:
                    continue
                # the passage may have been near by chance and the item beside it
                around = got[max(int(starts[d]), a - size) : min(int(starts[d] + per_doc[d]), b + size)].tolist()
                # a long region has common words by chance: only a stretch not much longer than the item counts
                width, step = size + size // 4 + 2, max(2, size // 16)
                stretch = lambda k: lcs(masks, size, around[k : k + width])
                best = max(range(0, max(1, len(around) - width + step), step), key=stretch)
                common = max(stretch(k) for k in range(max(0, best - step + 1), best + step))
                tail = min(ANSWER_WORDS, size)
                answer = lcs(_masks(own[-tail:].tolist()), tail, around) >= 0.75 * tail
                if common >= LCS * size or (answer and common >= LCS_WITH_ANSWER * size):
                    done.add((d, item))
                    yield i + d, item, float(cosine), common, answer


def models(docs: DataFrame, benchmark: DataFrame) -> tuple[list[Model], DataFrame | None]:
    """A fitted model for each block of items, all with one space, and the documents' codes."""
    blocks = list(item_blocks(benchmark))  # the query set; what is broadcast of it is one block
    if not blocks:
        return [], None
    codes = materialise(coded(docs), "passage-words")
    parts = [p for b in blocks for p in b.parts()[0]]
    idf = weights(*frequencies(codes), parts)
    space, share = latent_space(codes, idf, parts)
    return [Model(b, idf, space, share) for b in blocks], codes


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, common_words, item_words and answer_found of every document and item found in it."""
    schema = "doc_id bigint, item_id bigint, cosine double, common_words int, item_words int, answer_found boolean"
    out = docs.sparkSession.createDataFrame([], schema)
    fitted, codes = models(docs, benchmark)
    for model in fitted:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for b in batches:
                rows = b.column("codes").to_pylist()
                counts = np.array([len(x) // 4 for x in rows], np.int64)
                doc_ids = b.column("doc_id").to_pylist()
                got = list(m.search(np.frombuffer(b"".join(rows), np.uint32), counts))
                columns = [
                    pa.array([doc_ids[g[0]] for g in got], pa.int64()),
                    pa.array([m.items.ids[g[1]] for g in got], pa.int64()),
                    pa.array([g[2] for g in got], pa.float64()),
                    pa.array([g[3] for g in got], pa.int32()),
                    pa.array([len(m.items.codes[g[1]]) for g in got], pa.int32()),
                    pa.array([g[4] for g in got], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

        out = out.unionByName(map_arrow(codes, run, schema))
    return out


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in whose text no item is found; columns as they are. Nothing is joined or shuffled."""
    at = docs.columns.index("text")
    for model in models(docs, benchmark)[0]:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in parts_of(batch, column=at):
                    codes, counts = word_codes(b.column(at), codes_of, bare=True)
                    clean = np.ones(b.num_rows, bool)
                    clean[[g[0] for g in shared.value.search(codes, counts)]] = False
                    yield b.filter(pa.array(clean))

        docs = map_arrow(docs, run, docs.schema)
    return docs


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, a row for each document and item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
