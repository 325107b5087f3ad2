"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its distinct lower-cased words, hashed, with weights 1 + log(count), scaled to length one; buckets of
structure statistics (shares of capitals, digits, punctuation and white space, word and line lengths, repeats, ...);
and its size. The score is w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2) through a sigmoid, which takes time
linear in the features. Labels, language, source and doc_id are never features.

The model is fitted on the driver on a bounded sample: at most ``most`` labelled documents (``MOST_ROWS``, documented; by
hash order of the doc_id, outside the held-out fold), whose features are made on the executors. All documents are scored in
Arrow batches, without a shuffle.

Null or empty texts have only their (zero) statistics and are scored like any other. A doc_id with several labels counts
with its smallest one. Without usable labels the score is 0.5 for all. No documents give no rows; extra columns pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

BUCKETS = 1 << 15
FACTORS = 6
#: Bins of a structure statistic.
BINS = 12
MOST_ROWS = 6000
THRESHOLD = 0.3
STATS = (
    "chars", "words", "capitals", "digits", "punctuation", "space", "lines", "word_length", "distinct_words", "line_repeats",
    "bangs", "bars", "symbols", "capital_words", "stops", "controls", "other_letters", "long_words", "word_runs", "at_signs", "stutters",
)


def statistics(text: str, words: list[str], counts: dict[str, int]) -> list[float]:
    """The structure statistics of a text, each between 0 and 1."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, len(raw))
    tally = np.bincount(raw, minlength=256)
    lines = text.split("\n")
    n_words = max(1, len(words))
    share = lambda s: float(tally[np.frombuffer(s, np.uint8)].sum()) / n
    capitals = int(tally[65:91].sum())
    letters = capitals + int(tally[97:123].sum()) + int(tally[128:].sum())
    return [
        min(1.0, np.log1p(len(raw)) / 14),
        min(1.0, np.log1p(len(words)) / 12),
        capitals / max(1, letters),
        float(tally[48:58].sum()) / n,
        share(b".,;:'\"()-"),
        float(tally[[9, 10, 11, 12, 13, 32]].sum()) / n,
        min(1.0, 10 * len(lines) / n_words),
        min(1.0, sum(map(len, words)) / n_words / 24),
        len(counts) / n_words,
        1 - len(set(lines)) / len(lines),
        min(1.0, 8 * share(b"!")),
        min(1.0, 8 * share(b"|")),
        min(1.0, 8 * share(b"#$%&*+<=>@[]^_{}~`\\/")),
        sum(w.isupper() for w in words) / n_words,
        min(1.0, 10 * tally[46] / n_words),
        min(1.0, 20 * float(tally[:9].sum() + tally[14:32].sum()) / n),
        float(tally[128:].sum()) / n,
        sum(len(w) > 18 for w in words) / n_words,
        min(1.0, max(counts.values(), default=0) / n_words),
        min(1.0, 40 * share(b"@") * n / max(n_words, 1)),
        sum(map(str.__eq__, words, words[1:])) / n_words,
    ]


_hashed: dict[str, int] = {}


def _bucket(word: str) -> int:
    got = _hashed.get(word)
    if got is None:
        got = zlib.crc32(word.encode("utf-8", "replace")) & (BUCKETS - 1)
        if len(_hashed) < 300_000:
            _hashed[word] = got
    return got


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids and values. Words come first in the id space, then the bins of the statistics."""
    text = text or ""
    words = text.split()
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    stats = np.array(statistics(text, words, counts))
    bins = np.minimum((np.sqrt(np.clip(stats, 0, 1)) * BINS).astype(np.int64), BINS - 1)
    fixed = BUCKETS + np.arange(len(stats)) * BINS + bins
    ids = np.fromiter((_bucket(w.lower()) for w in counts), np.int64, len(counts))
    x = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
    if len(x):
        x /= np.linalg.norm(x)
    return np.concatenate([ids, fixed]).astype(np.int32), np.concatenate([x, np.full(len(fixed), 0.5)]).astype(np.float32)


@dataclass
class Machine:
    """w0, w and v of a factorisation machine."""

    w0: float
    w: np.ndarray
    v: np.ndarray

    def margins(self, ids: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores before the sigmoid of documents whose features begin at ``starts``; none is without features."""
        vx = self.v[ids] * x[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(1), starts)
        return self.w0 + np.add.reduceat(self.w[ids] * x, starts) + 0.5 * ((sums * sums).sum(1) - squares)

    def scores(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not docs:
            return np.zeros(0)
        starts = np.cumsum([0] + [len(i) for i, _ in docs[:-1]])
        m = self.margins(np.concatenate([i for i, _ in docs]), np.concatenate([x for _, x in docs]), starts)
        return 1 / (1 + np.exp(-np.clip(m.astype(np.float64), -40, 40)))


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 14, rate: float = 0.08, decay: float = 2e-4) -> Machine:
    """Mini-batch AdaGrad on the logistic loss."""
    n = BUCKETS + len(STATS) * BINS
    rng = np.random.default_rng(11)
    w, v = np.zeros(n, np.float32), rng.normal(0, 0.02, (n, FACTORS)).astype(np.float32)
    if not len(labels) or labels.min() == labels.max():
        return Machine(0.0, w, np.zeros_like(v))
    share = labels.mean()
    w0 = float(np.log(share / (1 - share)))
    gw, gv, g0 = np.full(n, 1e-6, np.float32), np.full((n, FACTORS), 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            ids = np.concatenate([docs[i][0] for i in some])
            x = np.concatenate([docs[i][1] for i in some])
            size = np.array([len(docs[i][0]) for i in some])
            starts = np.cumsum(size) - size
            vx = v[ids] * x[:, None]
            sums = np.add.reduceat(vx, starts, axis=0)
            m = w0 + np.add.reduceat(w[ids] * x, starts) + 0.5 * ((sums**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts))
            err = (1 / (1 + np.exp(-m)) - labels[some]) / len(some)
            each = np.repeat(err, size).astype(np.float32) * x
            d0 = float(err.sum())
            g0 += d0 * d0
            w0 -= rate * d0 / g0**0.5
            spots, back = np.unique(ids, return_inverse=True)
            dw = np.bincount(back, each, len(spots)).astype(np.float32) + decay * w[spots]
            gw[spots] += dw * dw
            w[spots] -= rate * dw / np.sqrt(gw[spots])
            dv_each = each[:, None] * (np.repeat(sums, size, axis=0) - vx)
            dv = np.stack([np.bincount(back, dv_each[:, f], len(spots)) for f in range(FACTORS)], axis=1).astype(np.float32)
            dv += decay * v[spots]
            gv[spots] += dv * dv
            v[spots] -= rate * dv / np.sqrt(gv[spots])
    return Machine(w0, w, v)


def held_out(doc_id):
    """Whether crc32 of the doc_id as text leaves 0 on division by 5; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _featurised(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t) for t in b.column("text").to_pylist()]
            ids, x = (pa.array([g[k].tobytes() for g in got], pa.binary()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), ids, x], ["doc_id", "quality", "ids", "x"])

    return map_arrow(docs, run, "doc_id bigint, quality int, ids binary, x binary")


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Machine:
    """Fit on at most ``most`` labelled documents outside the held-out fold."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    picked = (
        usable.groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    # at most ``most`` rows of 12 bytes, so it may be broadcast
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = _featurised(text.join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text")).toArrow()
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    ids, x = rows["ids"].to_pylist(), rows["x"].to_pylist()
    y = rows["quality"].to_numpy().astype(np.float64)
    return train([(np.frombuffer(ids[i], np.int32), np.frombuffer(x[i], np.float32)) for i in order], y[order])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(machine)  # a fixed size, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b.column("text"), []
            for at in range(0, len(texts), 256):
                out.append(model.value.scores([features(t) for t in texts[at : at + 256].to_pylist()]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "score"]
            )

    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(picked, run, "doc_id bigint, score double")


def keep(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more; columns as they are. Nothing is joined or shuffled."""
    model, at = docs.sparkSession.sparkContext.broadcast(machine), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                good = model.value.scores([features(t) for t in part.column(at).to_pylist()]) >= threshold
                yield part.filter(pa.array(good))

    return map_arrow(docs, run, docs.schema)


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score(docs, fit(docs, labels)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
