"""Masked pseudo-likelihood: a bidirectional window network scores every token from both of its sides.

Tokens are lower-cased words, hashed into ``BINS`` bins; the most frequent bins of the whole corpus have an id of their own, the rest
share ``REST`` ids. The network sums position-dependent embeddings of the two words on either side, applies tanh, and
predicts the id's frequency class and the id within its class; log P(bin | id), by the counts of the whole corpus, is added, so that the
bins of a rest id are told apart and the probabilities of all bins add up to one. A document's score is the sum of the
conditional log-probabilities of all its tokens.

Training covers every token: a hash of doc_id and position deals the positions out to the rounds, so that each is masked in exactly one.
Tasks train from the same start on their own documents with AdaGrad, and their
parameters, weighted by the targets they saw, are summed by Spark in slices; so the data that is gathered grows with the corpus,
and the driver holds one model of fixed size. No document is sampled away and no task sees more than its own partition.

A null or empty text has no tokens, a log-probability of 0 and a null mean. Rows are scored one by one, so repeated rows get equal
scores. No documents give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICED, map_arrow, materialise, sliced, summed
from .tokens import parts_of
from .words import word_codes

BINS = 1 << 16
CLASSES = 64
PER_CLASS = 64
WORDS = CLASSES * PER_CLASS
REST = 64
PAD = WORDS
OFFSETS = (-2, -1, 1, 2)
WIDTH = 24
ROUNDS = 2
RATE = 0.1
#: Targets of a step at most.
LARGEST_STEP = 4096


def shapes() -> list[tuple[str, tuple[int, ...]]]:
    return [
        ("e", (len(OFFSETS), WORDS + 1, WIDTH)),
        ("b", (WIDTH,)),
        ("c", (CLASSES, WIDTH)),
        ("cb", (CLASSES,)),
        ("w", (WORDS, WIDTH)),
        ("wb", (WORDS,)),
    ]


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def start(counts: np.ndarray) -> np.ndarray:
    """First parameters; the biases say how often each class and word is."""
    rng = np.random.default_rng(5)
    flat = np.concatenate([rng.normal(0, 0.1, int(np.prod(s))) for _, s in shapes()]).astype(np.float32)
    p = unpack(flat)
    by_class = counts.reshape(CLASSES, PER_CLASS).astype(np.float64) + 0.5
    p["cb"][:] = np.log(by_class.sum(1) / by_class.sum())
    p["wb"][:] = np.log(by_class / by_class.sum(1, keepdims=True)).ravel()
    p["b"][:] = 0
    return flat


def contexts(ids: np.ndarray, doc: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Ids around each target, ``PAD`` beyond the ends of its document."""
    out = np.empty((len(OFFSETS), len(targets)), np.int32)
    for k, d in enumerate(OFFSETS):
        at = targets + d
        inside = (at >= 0) & (at < len(ids))
        at = np.where(inside, at, 0)
        out[k] = np.where(inside & (doc[at] == doc[targets]), ids[at], PAD)
    return out


def _hidden(p: dict, around: np.ndarray) -> np.ndarray:
    h = np.take(p["e"][0], around[0], axis=0)
    h += p["b"]
    for k in range(1, len(OFFSETS)):
        h += np.take(p["e"][k], around[k], axis=0)
    return np.tanh(h, out=h)


def _row_sums(z: np.ndarray) -> np.ndarray:
    return z @ np.ones(z.shape[1], z.dtype)


def _turned(w: np.ndarray) -> np.ndarray:
    """The matrix of each class, as the product with its targets takes it."""
    return np.ascontiguousarray(w.reshape(CLASSES, PER_CLASS, WIDTH).transpose(0, 2, 1))


def _by_id(ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sums of the ``rows`` of each of ``n`` ids."""
    width = rows.shape[1]
    spots = (ids.astype(np.int64)[:, None] * width + np.arange(width)).ravel()
    return np.bincount(spots, rows.ravel(), n * width).astype(np.float32).reshape(n, width)


def _by_class(words: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Targets in order of their class, where each class begins, and their ids within it."""
    of = (words // PER_CLASS).astype(np.uint8)
    order = np.argsort(of, kind="stable")
    return order, np.searchsorted(of[order], np.arange(CLASSES + 1)).tolist(), (words % PER_CLASS)[order]


def log_probabilities(p: dict, around: np.ndarray, words: np.ndarray) -> np.ndarray:
    """log P(word | both sides) of each target."""
    h = _hidden(p, around)
    of = words // PER_CLASS
    z = h @ p["c"].T + p["cb"]
    got = z[np.arange(len(words)), of] - np.log(_row_sums(np.exp(z)))
    order, edges, place = _by_class(words)
    h, inner, turned = h[order], np.empty(len(words), np.float32), _turned(p["w"])
    for c in range(CLASSES):
        i, j = edges[c], edges[c + 1]
        if i < j:
            own = slice(c * PER_CLASS, (c + 1) * PER_CLASS)
            z = h[i:j] @ turned[c] + p["wb"][own]
            inner[i:j] = z[np.arange(j - i), place[i:j]] - np.log(_row_sums(np.exp(z)))
    got[order] += inner
    return got


def _step(p: dict, g: dict, around: np.ndarray, words: np.ndarray) -> None:
    """One AdaGrad step on a batch of targets.

    Each array of parameters is changed as a whole, once; what no target names has a gradient of 0 and stays.
    """
    n = np.float32(len(words))
    h = _hidden(p, around)
    of = words // PER_CLASS
    dz = h @ p["c"].T
    dz += p["cb"]
    np.exp(dz, out=dz)
    dz *= (1 / (n * _row_sums(dz)))[:, None]
    dz[np.arange(len(words)), of] -= 1 / n
    dh = dz @ p["c"]

    def put(p: np.ndarray, g: np.ndarray, d: np.ndarray) -> None:
        g += d * d
        d *= RATE
        d /= np.sqrt(g)
        p -= d

    put(p["c"], g["c"], dz.T @ h)
    put(p["cb"], g["cb"], dz.sum(0))
    order, edges, place = _by_class(words)
    by_class, back = h[order], np.empty_like(h)
    dw, dwb, turned = np.zeros_like(p["w"]), np.zeros_like(p["wb"]), _turned(p["w"])
    for c in range(CLASSES):
        i, j = edges[c], edges[c + 1]
        if i == j:
            continue
        own = slice(c * PER_CLASS, (c + 1) * PER_CLASS)
        dz = by_class[i:j] @ turned[c]
        dz += p["wb"][own]
        np.exp(dz, out=dz)
        dz *= (1 / (n * _row_sums(dz)))[:, None]
        dz[np.arange(j - i), place[i:j]] -= 1 / n
        np.matmul(dz, p["w"][own], out=back[i:j])
        np.matmul(dz.T, by_class[i:j], out=dw[own])
        dz.sum(0, out=dwb[own])
    put(p["w"], g["w"], dw)
    put(p["wb"], g["wb"], dwb)
    dh[order] += back
    dh *= 1 - h * h
    put(p["b"], g["b"], dh.sum(0))
    for k in range(len(OFFSETS)):
        put(p["e"][k], g["e"][k], _by_id(around[k], dh, WORDS + 1))


def _bins(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) & (BINS - 1) for w in words), np.uint16, len(words))


def binned(docs: DataFrame) -> DataFrame:
    """doc_id and bins (binary, uint16) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in parts_of(batch):
                bins, counts = word_codes(b.column("text"), _bins)
                ends = np.cumsum(counts)
                rows = [bins[i:j].tobytes() for i, j in zip(ends - counts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "bins"])

    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(picked, run, "doc_id bigint, bins binary")


def _chunks(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about ``most`` tokens: the rows, all their bins, and the number of each."""
    for b in batches:
        counts = np.array([len(x) // 2 for x in b.column("bins").to_pylist()], np.int64)
        group = np.cumsum(counts) // most
        edges = np.flatnonzero(np.diff(group, prepend=-1, append=-2))
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            part = b.slice(int(i), int(j - i))
            yield part, np.frombuffer(b"".join(part.column("bins").to_pylist()), np.uint16), counts[i:j]


def histogram(bins: DataFrame) -> DataFrame:
    """bin and n over all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for _, got, _ in _chunks(batches):
            total += np.bincount(got, minlength=BINS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bin", "n"])

    return map_arrow(bins, run, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n"))


def numbering(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id of each bin, the most frequent first, and the tokens of each id."""
    ids = np.empty(BINS, np.int32)
    order = np.lexsort((np.arange(BINS), -counts))
    own = WORDS - REST
    ids[order[:own]] = np.arange(own)
    ids[order[own:]] = own + np.arange(BINS - own) % REST
    return ids, np.bincount(ids, counts, WORDS)


def within(counts: np.ndarray, ids_of: np.ndarray) -> np.ndarray:
    """log P(bin | its id) of each bin; 0 where the id is the bin's own."""
    smooth = counts + 0.5
    return np.log(smooth / np.bincount(ids_of, smooth, WORDS)[ids_of])


def rounds_of(doc_id: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The round in which each position of each document is masked."""
    x = doc_id.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(ROUNDS)).astype(np.int64)


def train(bins: DataFrame, ids_of: np.ndarray, flat: np.ndarray, nth: int) -> np.ndarray:
    """One round: local training in each task, and the mean of the parameters weighted by targets."""
    model = bins.sparkSession.sparkContext.broadcast((ids_of, flat))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, flat = model.value
        flat = flat.copy()
        p, g = unpack(flat), unpack(np.full(len(flat), 1e-4, np.float32))
        seen = 0
        for part, got, counts in _chunks(batches):
            doc = np.repeat(np.arange(len(counts)), counts)
            ids = ids_of[got]
            place = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
            doc_id = part.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            targets = np.flatnonzero(rounds_of(doc_id[doc], place) == nth)
            targets = np.random.default_rng(len(targets)).permutation(targets)
            around = contexts(ids, doc, targets)
            # small shares take smaller steps, so that they make enough of them
            size = int(np.clip(len(targets) // 64, 32, LARGEST_STEP))
            for at in range(0, len(targets), size):
                _step(p, g, around[:, at : at + size], ids[targets[at : at + size]])
            seen += len(targets)
        if seen:
            yield sliced(flat * seen, float(seen))

    total = summed(map_arrow(bins, run, SLICED), len(flat))
    return flat if total is None else (total[0] / total[1]).astype(np.float32)


def fit(bins: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of bins, log P(bin | id), and the parameters after ``ROUNDS`` rounds over the corpus."""
    rows = histogram(bins).toArrow()  # at most BINS rows
    counts = np.zeros(BINS, np.int64)
    counts[rows["bin"].to_numpy()] = rows["n"].to_numpy()
    ids_of, per_id = numbering(counts)
    flat = start(per_id)
    for nth in range(ROUNDS):
        flat = train(bins, ids_of, flat, nth)
    return ids_of, within(counts, ids_of), flat


def score_binned(bins: DataFrame, ids_of: np.ndarray, in_id: np.ndarray, flat: np.ndarray) -> DataFrame:
    model = bins.sparkSession.sparkContext.broadcast((ids_of, in_id, flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, in_id, flat = model.value
        p = unpack(flat)
        for part, got, counts in _chunks(batches, 1 << 18):
            ids, doc = ids_of[got], np.repeat(np.arange(len(counts)), counts)
            out = np.zeros(len(counts))
            for at in range(0, len(ids), 1 << 15):
                targets = np.arange(at, min(at + (1 << 15), len(ids)))
                lp = log_probabilities(p, contexts(ids, doc, targets), ids[targets]) + in_id[got[targets]]
                out += np.bincount(doc[targets], lp, len(counts))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(out)], ["doc_id", "n_tokens", "log_prob"]
            )

    scored = map_arrow(bins, run, "doc_id bigint, n_tokens bigint, log_prob double")
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return scored.select("doc_id", "n_tokens", "log_prob", mean.alias("mean_log_prob"), F.exp(-mean).alias("perplexity"))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_prob, mean_log_prob and perplexity of every row, by a network trained on all of them."""
    bins = materialise(binned(docs), "word-bins")
    return score_binned(bins, *fit(bins))


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihood of every document."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
