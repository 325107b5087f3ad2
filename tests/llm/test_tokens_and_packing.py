import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import ODD

from lodestack.llm import packing, tokens


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary())


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def test_encoding_is_the_librarys(tok):
    r = random.Random(3)
    texts = [None, "", " ", "  ", "   ", "a  b", "a   b", " a ", "a\n  b", "a \n b", "\t\t\tx", "<|endoftext|> b<|endoftext|>", "a <|endoftext|>   b", "it's  we'll x　 y"]
    texts += ["".join(r.choice(" \n\ta b.1é'日<|endoftext|>") for _ in range(r.randint(1, 60))) for _ in range(1500)]
    ids, counts = tokens.encode(pa.array(texts), tokens.vocabulary())
    ends = np.cumsum(counts)
    for t, e, n in zip(texts, ends, counts, strict=True):
        assert ids[e - n : e].tolist() == ids_of(tok, t)
    sliced = pa.array(texts).slice(700, 40)
    assert tokens.encode(sliced, tokens.vocabulary())[1].tolist() == counts[700:740].tolist()


def test_elias_fano():
    rng = np.random.default_rng(1)
    for values in ([], [0], [5], [0, 0, 0], np.sort(rng.integers(0, 10**6, 500)), np.sort(rng.integers(0, 40, 300)), [2**62]):
        values = np.array(values, np.int64)
        e = tokens.EliasFano.build(values)
        assert e.values().tolist() == values.tolist()
        assert [e.select(k) for k in range(len(values))] == values.tolist()
    values = np.sort(rng.integers(0, 10**9, 10_000))
    assert len(tokens.EliasFano.build(values).tobytes()) < 10_000 * 20 / 8  # under 20 bits each, not 64


def test_images_round_trip():
    data = tokens.image([None, None, -5, 7, 7], np.array([1, 0, 2, 0, 3]), np.array([70_000, 1, 2, 3, 4, 5]))
    ids, ends, flat = tokens.read_image(data)
    assert ids == [None, None, -5, 7, 7] and ends.values().tolist() == [1, 1, 3, 3, 6] and flat.tolist() == [70_000, 1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        tokens.read_image(b"x" * 100)


def test_files_hold_all_documents_in_order(spark, docs, tok):
    for size in (50, 1 << 20):
        files = tokens.write(docs(ODD), shard_tokens=size)
        got = sorted(tokens.read(files).collect(), key=lambda r: r.start)
        order = sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0))
        assert [r.doc_id for r in got] == [i for i, _ in order]
        at = 0
        for r, (_, text) in zip(got, order, strict=True):
            want = np.array(ids_of(tok, text) + [2], "<u4")
            assert (r.start, r.n_tokens, bytes(r.ids)) == (at, len(want), want.tobytes())
            at += len(want)
    assert tokens.read(tokens.write(docs([]))).count() == 0


def test_token_files_entry(spark, sf, tok):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    at = 0
    for r in sorted(tokens.op8_token_files(spark, sf).collect(), key=lambda r: r.doc_id):
        want = ids_of(tok, texts[r.doc_id]) + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)


def check_packing(rows, texts, tok, capacity=2048):
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, text in texts:
        ids = ids_of(tok, text) + [0]
        parts = sorted(by_doc[doc_id], key=lambda r: r.piece)
        want = [(k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), capacity))]
        copies = sum(1 for i, t in texts if (i, t) == (doc_id, text))
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in parts] == sorted(want * copies)
    return len(bins), -(-sum(r.length for r in rows) // capacity)


def test_packing(spark, docs, tok):
    rows = packing.pack(docs(ODD)).collect()
    check_packing(rows, ODD, tok)
    assert packing.pack(docs([])).count() == 0


def test_packing_entry(spark, sf, tok):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n, least = check_packing(packing.op10_best_fit_packing(spark, sf).collect(), texts, tok)
    assert n <= least + 2


def test_cut():
    assert packing.cut(1, 8) == [(0, 1)] and packing.cut(8, 8) == [(0, 8)]
    assert packing.cut(16, 8) == [(0, 8), (8, 8)] and packing.cut(17, 8) == [(0, 1), (1, 8), (9, 8)]


def test_plans_place_every_piece():
    r = random.Random(2)
    for make in (lambda: r.randint(1, 100), lambda: r.randint(30, 70), lambda: r.choice([51, 50, 49, 34, 33, 32, 1]), lambda: 100):
        counts = Counter(make() for _ in range(3000))
        start = packing.best_fit(dict(counts), 100)
        better = packing.improve(start, 100)
        for groups in (start, better):
            held = Counter()
            for times, room, lengths in groups:
                assert room == 100 - sum(k * v for k, v in lengths.items()) >= 0
                for k, v in lengths.items():
                    held[k] += times * v
            assert held == counts
        assert sum(g[0] for g in better) <= sum(g[0] for g in start)
        packing.plan(dict(counts), 100)


def test_local_search_empties_sequences():
    # best fit leaves two sequences that one exchange turns into one full and one shorter, until one is empty
    start = [(1, 30, {70: 1}), (1, 40, {60: 1}), (1, 70, {30: 1}), (1, 60, {40: 1})]
    assert sum(g[0] for g in packing.improve(start, 100)) == 2


def sums_of(held):
    """Every choice of one or two pieces, by their number."""
    sizes = sorted(held)
    return [(x,) for x in sizes], [(x, y) for i, x in enumerate(sizes) for y in sizes[i:] if x != y or held[x] > 1]


def test_local_search_leaves_no_change():
    r = random.Random(11)
    for capacity, make, n in ((2048, lambda: r.randint(512, 1024), 700), (300, lambda: r.randint(75, 150), 1500), (60, lambda: r.randint(1, 59), 300)):
        counts = dict(Counter(make() for _ in range(n)))
        start = packing.best_fit(counts, capacity)
        groups = packing.improve(start, capacity)
        held = Counter()
        for times, room, lengths in groups:
            assert room == capacity - sum(k * v for k, v in lengths.items()) >= 0
            held.update({k: times * v for k, v in lengths.items()})
        assert held == counts
        if sum(g[0] for g in groups) == packing.least(counts, capacity):
            continue
        merged = Counter()
        for times, room, lengths in groups:
            if room:
                merged[tuple(sorted(lengths.items()))] += times
        rooms = {k: capacity - sum(x * y for x, y in k) for k in merged}
        parts = {k: [[sum(c) for c in p] for p in sums_of(dict(k))] for k in merged}
        for giver in merged:
            for taker, room in rooms.items():
                if room <= rooms[giver] and (giver != taker or merged[giver] > 1):
                    (ones, twos), (back, backs) = parts[giver], parts[taker]
                    gains = [x - y for x in ones for y in [0, *back, *backs]] + [x - y for x in twos for y in back]
                    assert not any(0 < g <= room for g in gains)


def test_two_of_many_lengths_for_one():
    giver = {x: 1 for x in range(10, 40)}
    assert packing._best_change(giver, {70: 1}, 7) == (7, [38, 39], [70])
    assert packing._best_change({5: 1}, {70: 1}, 4) is None and packing._best_change({5: 2}, {6: 1}, 4) == (4, [5, 5], [6])
    assert packing._best_change({70: 1}, giver, 5) in [(5, [70], [x, 65 - x]) for x in range(26, 33)]


def test_least_is_a_lower_bound():
    r = random.Random(4)
    met = 0
    for _ in range(150):
        pieces = [r.randint(1, 20) for _ in range(r.randint(1, 8))]
        # the fewest sequences, then the least content of the last one, for each subset
        best = [(0, 20)] + [(99, 0)] * (2 ** len(pieces) - 1)
        for s in range(1, 2 ** len(pieces)):
            for i, x in enumerate(pieces):
                if s >> i & 1:
                    n, used = best[s ^ 1 << i]
                    best[s] = min(best[s], (n, used + x) if used + x <= 20 else (n + 1, x))
        least = packing.least(dict(Counter(pieces)), 20)
        assert least <= best[-1][0]
        met += least == best[-1][0]
    assert met > 120 and packing.least({}, 20) == 0
    assert packing.least({11: 5, 9: 3, 3: 1}, 20) == 5 and packing.least({11: 5, 10: 5}, 20) == 8


def test_local_search_goes_beyond_the_least_full():
    # many sequences are less full than the first that can give anything
    r = random.Random(3)
    start = packing.best_fit(dict(Counter(r.randint(409, 716) for _ in range(3000))), 2048)
    assert sum(g[0] for g in packing.improve(start, 2048)) <= sum(g[0] for g in start) - 30
