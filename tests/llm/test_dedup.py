import random

import numpy as np
from llm_cases import ODD
from xxhash import xxh64_intdigest

from lodestack.llm import multiindex, simhash
from lodestack.llm.components import connected_components


def fingerprint(text):
    words = (text or "").encode().lower().split()
    hashes = [xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_copies(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    out = []
    for g in range(40):
        base = [word() for _ in range(200)]
        for _ in range(r.choice([1, 1, 2, 12])):
            own = list(base)
            for _ in range(r.randint(0, 2)):
                own[r.randrange(len(own))] = word()
            out.append(" ".join(own))
    return out


def test_components_match_brute_force(docs):
    rows = ODD + list(enumerate(near_copies(), 100))
    got = simhash.components(docs(rows)).collect()
    prints = [fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    of = classes(len(rows), pairs)
    least = {}
    for (i, _), c in zip(rows, of, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted((i if i is not None else -1, p, least[c]) for (i, _), p, c in zip(rows, prints, of, strict=True))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint % 2**64, r.component_id) for r in got) == want


def test_large_keys_are_cut_into_tiles(spark):
    r = random.Random(3)
    prints = {sum(1 << b for b in r.sample(range(12), r.randint(0, 6))) for _ in range(900)}
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint bigint")
    for tile in (64, 4096):
        found = simhash.links(df, tile=tile).collect()
        index = {p: i for i, p in enumerate(sorted(prints))}
        mine = classes(len(index), [(index[x.a], index[x.b]) for x in found])
        brute = classes(len(index), [(index[a], index[b]) for a in index for b in index if (a ^ b).bit_count() <= 3])
        assert mine == brute


def test_deduplicate_keeps_one_of_each(docs):
    rows = ODD + list(enumerate(near_copies(), 100))
    df = docs(rows)
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    want = {r.component_id for r in simhash.components(df).collect()}
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert simhash.components(docs([])).count() == 0 and simhash.deduplicate(docs([])).count() == 0


def test_deduplicate_tells_rows_of_one_id_apart(docs):
    """Brute force over rows with shared, null and repeated ids: one row of each component, the best by id and fingerprint."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(400)) for x in "abc")
    near = a + " a119"
    assert (fingerprint(a) ^ fingerprint(near)).bit_count() <= 3
    for rows in (
        [(3, a), (5, near), (5, b)], [(5, a), (5, b)], [(5, a), (5, a), (None, b), (None, b), (None, c), (7, c), (7, None), (None, "")],
        [(2, a), (2, near), (1, b), (1, a), (None, near)],
    ):
        prints = [fingerprint(t) for _, t in rows]
        of = classes(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
        best = {}
        for (i, t), p, k in zip(rows, prints, of, strict=True):
            best[k] = min(best.get(k, (2, 0, 0, "")), (i is None, i or 0, p - (p >> 63 << 64), t or ""))
        got = simhash.deduplicate(docs(rows)).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got) == sorted((x[0], x[1], x[3]) for x in best.values())


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 7), (9, 9), (-5, 7)] + [(1000, 1000 + i) for i in range(1, 50)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert {got.get(i, i) for i in range(100, 161)} == {100}
    assert got[7] == got[3] == -5 and all(got[1000 + i] == 1000 for i in range(1, 50)) and 9 not in got
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    import pytest

    from lodestack.llm.common import shared_folder

    conf = SimpleNamespace(get=lambda *a: None)
    remote = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(remote)
    assert shared_folder(spark)


def vectors(seed=4, n=900, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for i in range(0, 300, 3):  # near copies
        x[i + 1] = x[i] + rng.normal(size=d) * 0.05
    x[400:440] = x[400] + rng.normal(size=(40, d)) * 0.05
    x[500:520] = x[500]  # exact copies
    return [(i, v.tolist(), i % 3, "x") for i, v in enumerate(x.astype(np.float32).astype(float))]


def brute_links(rows):
    sound = [(i, np.array(v, float)) for i, v, *_ in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([v / np.linalg.norm(v) for _, v in sound])
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    return [i for i, _ in sound], near


def test_embedding_links(spark):
    rows = vectors()
    rows += [(1000, None, 0, "x"), (1001, [0.0] * 16, 0, "x"), (1002, [float("nan")] * 16, 0, "x"), (1003, [1.0] * 5, 0, "x"),
             (1004, [1.0] * 15 + [None], 0, "x"), (1005, [float("inf")] * 16, 0, "x"), (1006, [], 0, "x"), (1007, rows[500][1], 0, "x"),
             (1010, [1.0, 2.0, 3.0], 0, "x"), (1009, [2.0, 4.0, 6.0], 0, "x"), (1011, [1.0, 2.0, 3.0], 0, "x"), (1012, [9.0, -1.0, 0.0], 0, "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, node string")
    for tile in (400, 2048):  # with an index, and as one cell
        got = {r.vec_id: r for r in multiindex.near_duplicates(df, tile=tile).collect()}
        assert len(got) == len(rows)
        ids, near = brute_links(rows)
        n_true, n_got = near.sum(), sum(got[i].n_links for i in ids)
        assert n_got == n_true if tile == 2048 else 0.99 * n_true <= n_got <= n_true
        for i, row in zip(ids, near, strict=True):
            assert got[i].n_links <= row.sum()
        for i in range(1000, 1007):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
        assert got[1007].component_id == 500 and got[510].n_links == 20
        # vectors of other numbers of dimensions link among themselves
        assert [got[i].n_links for i in (1009, 1010, 1011, 1012)] == [2, 2, 2, 0] and got[1011].component_id == 1009
    assert multiindex.near_duplicates(df.limit(0)).count() == 0


def test_visits_stay_few_as_vectors_grow():
    """Recall of links at exactly the least cosine, and the cells looked into, from 10^4 to 10^6 vectors."""
    rng = np.random.default_rng(5)
    looked = {}
    for n in (10_000, 1_000_000):
        x = multiindex.unit(rng.normal(size=(14_000, 32)))
        books, looked[n] = multiindex.fit(x[:12_000], multiindex.codes_for(n))
        some = x[12_000:]
        away = rng.normal(size=some.shape)
        away -= (away * some).sum(1, keepdims=True) * some
        other = 0.95 * some + np.sqrt(1 - 0.95**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
        a, b = (multiindex.visits(v, books, looked[n]) for v in (some, other))
        found = (a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)
        assert found.mean() >= 0.97
    assert looked[1_000_000] <= 4 * looked[10_000] <= 4 * multiindex.MOST_VISITS


def test_hot_cells_are_cut_into_tiles(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=16) + rng.normal(size=(300, 16)) * 0.02
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = multiindex.near_duplicates(df, tile=40).collect()
    ids, near = brute_links([(i, v, 0) for i, v in rows])
    assert sum(r.n_links for r in got) >= 0.9 * near.sum() and {r.component_id for r in got} == {0}


def test_multi_sequence_order():
    rng = np.random.default_rng(2)
    books = (rng.normal(size=(9, 4)), rng.normal(size=(7, 4)))
    x = multiindex.unit(rng.normal(size=(20, 8)))
    got = multiindex.visits(x, books, 12)
    for v, cells in zip(x, got, strict=True):
        all_cells = sorted((((v[:4] - a) ** 2).sum() + ((v[4:] - b) ** 2).sum(), i * 7 + j) for i, a in enumerate(books[0]) for j, b in enumerate(books[1]))
        assert cells.tolist() == [c for _, c in all_cells[:12]]
