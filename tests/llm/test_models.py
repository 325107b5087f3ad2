import random
import zlib

import numpy as np
from llm_cases import ODD
from pyspark.sql import functions as F

from lodestack.llm import decontaminate, masked_lm, quality


def test_machine_identity():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=50).astype("f4"), rng.normal(size=(50, 4)).astype("f4"))
    docs = [(rng.integers(0, 50, n).astype(np.int32), rng.random(n).astype("f4")) for n in (1, 5, 30)]
    for (ids, x), got in zip(docs, m.scores(docs), strict=True):
        z = m.w0 + (m.w[ids] * x).sum()
        z += sum(m.v[ids[i]] @ m.v[ids[j]] * x[i] * x[j] for i in range(len(ids)) for j in range(i))
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-4


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op6_quality_classifier(spark, sf).collect()}
    assert len(got) == 1000
    hits = []
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= g.score <= 1
        assert g.predicted == int(g.score >= 0.3)
        if g.held_out:
            hits.append((r.quality, g.predicted))
    assert np.mean([a == b for a, b in hits]) > 0.9
    assert all(b for a, b in hits if a == 1)


def test_quality_odd_rows(spark, docs, odd):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (5, 1, 0), (8, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(odd, labels)
    assert quality.score(odd, model).count() == len(ODD)
    kept = quality.keep(odd, model, 0.0)
    assert kept.columns == odd.columns and kept.count() == len(ODD) and quality.keep(odd, model, 1.1).count() == 0
    nothing = quality.fit(odd, labels.limit(0))
    assert {r.score for r in quality.score(odd, nothing).collect()} == {0.5}
    assert quality.score(docs([]), model).count() == 0


def test_lm_scores_sum_conditional_probabilities(spark, docs):
    rng = np.random.default_rng(3)
    flat = masked_lm.start(rng.integers(1, 50, masked_lm.WORDS).astype(float)) * 3
    p = masked_lm.unpack(flat)
    ids, doc = rng.integers(0, masked_lm.WORDS, 40).astype(np.int32), np.repeat([0, 1, 2], [25, 1, 14])
    got = masked_lm.log_probabilities(p, masked_lm.contexts(ids, doc, np.arange(40)), ids)
    for t in range(40):
        h = p["b"].astype(float)
        for k, d in enumerate(masked_lm.OFFSETS):
            at = t + d
            h = h + p["e"][k][ids[at] if 0 <= at < 40 and doc[at] == doc[t] else masked_lm.PAD]
        h = np.tanh(h)
        c = ids[t] // masked_lm.PER_CLASS
        z = p["c"] @ h + p["cb"]
        own = slice(c * masked_lm.PER_CLASS, (c + 1) * masked_lm.PER_CLASS)
        y = p["w"][own] @ h + p["wb"][own]
        want = z[c] - np.log(np.exp(z).sum()) + y[ids[t] % masked_lm.PER_CLASS] - np.log(np.exp(y).sum())
        assert abs(got[t] - want) < 1e-3


def test_lm_learns_and_ranks(spark, docs):
    r = random.Random(5)
    cycle = "the cat sat on a mat and then it ran far away from here".split()
    text = lambda n: " ".join(cycle[(r.randrange(14) * 0 + i) % 14] for i in range(n))
    rows = [(i, text(300)) for i in range(120)]
    mixed = text(300).split()
    r.shuffle(mixed)
    rows += [(500, text(300)), (501, " ".join(mixed))]
    got = {x.doc_id: x for x in masked_lm.score(docs(rows)).collect()}
    assert got[500].mean_log_prob > got[501].mean_log_prob + 1
    assert got[500].n_tokens == 300 and abs(got[500].perplexity - np.exp(-got[500].mean_log_prob)) < 1e-6


def test_lm_tells_rare_words_apart():
    counts = np.random.default_rng(2).zipf(1.3, masked_lm.BINS).clip(max=10**6)
    ids, _ = masked_lm.numbering(counts)
    lp = masked_lm.within(counts, ids)
    assert np.allclose(np.bincount(ids, np.exp(lp), masked_lm.WORDS), 1)  # so all bins' probabilities add up to one
    own = ids < masked_lm.WORDS - masked_lm.REST
    assert np.allclose(lp[own], 0) and (lp[~own] < -1).all()
    a, b = (np.flatnonzero(~own & (counts == n))[0] for n in (counts[~own].max(), counts[~own].min()))
    assert lp[a] > lp[b]


def test_lm_scores_hold_the_place_in_the_rest_id(docs):
    # distinct words only: what is beyond the ids of their own scores far below one of a few ids
    text = " ".join(f"w{i}" for i in range(30_000))
    bins = masked_lm.binned(docs([(1, text)])).cache()
    ids, lp, flat = masked_lm.fit(bins)
    with_, without = (masked_lm.score_binned(bins, ids, x, flat).first().log_prob for x in (lp, lp * 0))
    assert without - with_ > 30_000  # above a nat a token, rest tokens being most


def test_lm_every_position_is_a_target_once():
    doc_id = np.repeat(np.array([-1, 5, 6, 10**12]), 1000)
    got = masked_lm.rounds_of(doc_id, np.tile(np.arange(1000), 4))
    assert set(got.tolist()) == set(range(masked_lm.ROUNDS))
    assert (got[:1000] != got[1000:2000]).any() and abs(got.mean() - 0.5) < 0.05


def test_lm_trains_on_every_token(docs, monkeypatch):
    rows = [(1, "a b c"), (2, "a b c"), (None, "d"), (4, " ".join("abcdefgh" * 40)), (5, None)]
    weights = []
    summed = masked_lm.summed
    monkeypatch.setattr(masked_lm, "summed", lambda *a: weights.append((got := summed(*a))[1]) or got)
    masked_lm.fit(masked_lm.binned(docs(rows)))
    assert sum(weights) == sum(len((t or "").split()) for _, t in rows)


def test_lm_odd_rows(docs, odd):
    got = masked_lm.score(odd).collect()
    assert len(got) == len(ODD)
    want = {i: len((t or "").split()) for i, t in ODD}
    for r in got:
        assert r.n_tokens == want[r.doc_id]
        assert (r.mean_log_prob is None) == (r.n_tokens == 0) and r.log_prob <= 0
    assert masked_lm.score(docs([])).count() == 0


def words(r, n):
    return ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9))) for _ in range(n)]


def leaks(seed=7):
    r = random.Random(seed)
    vocabulary = words(r, 3000)
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(r.randint(15, 60)))) for i in range(60)]
    docs, planted = [], set()
    for d in range(400):
        body = some(r.choice([10, 80, 400]))
        if d % 4 == 0:
            item, own = r.choice(items)
            own = own.split()
            if d % 8 == 0:  # a paraphrase: some words are dropped, replaced or put in
                for _ in range(len(own) // 8):
                    own[r.randrange(len(own))] = r.choice(vocabulary)
                own.insert(r.randrange(len(own)), r.choice(vocabulary))
            at = r.randrange(len(body))
            body[at:at] = own
            planted.add((d, item))
        docs.append((d, " ".join(body).capitalize() + "."))
    return items, docs, planted


def test_leaks_are_found(spark, docs):
    items, rows, planted = leaks()
    bench = spark.createDataFrame(items + [(900, None), (901, ""), (902, "too short")], "item_id bigint, text string")
    df = docs(rows)
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(df, bench).collect()}
    assert got == planted
    clean = decontaminate.remove(df, bench)
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in planted}


def test_a_passage_in_many_documents(spark, docs):
    items, rows, _ = leaks(9)
    item = items[3][1]
    rows = [(d, f"{t} {item} {t}" if d % 3 == 0 else t) for d, t in rows if d % 4]
    got = {r.doc_id for r in decontaminate.find(docs(rows), spark.createDataFrame(items, "item_id bigint, text string")).where("item_id = 3").collect()}
    assert got == {d for d, _ in rows if d % 3 == 0}


def test_long_items_are_found(spark, docs):
    items, rows, _ = leaks(11)
    r = random.Random(12)
    vocabulary = words(r, 3000)
    some = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    long = {1000 + n: some(n) for n in (600, 1000, 2000, 4000)}
    rows = rows + [(i, f"{some(90)} {t} {some(70)}") for i, t in long.items()] + [(7000, some(3000))]
    bench = spark.createDataFrame(items + list(long.items()), "item_id bigint, text string")
    found = decontaminate.find(docs(rows), bench).where("item_id >= 1000").collect()
    assert sorted((x.doc_id, x.item_id, x.common_words) for x in found) == [(i, i, i - 1000) for i in long]
    left = {x.doc_id for x in decontaminate.remove(docs(rows), bench).collect()}
    assert not left & long.keys() and 7000 in left


def test_blocks_hold_parts_of_long_items(spark):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(n))) for i, n in enumerate([20, 480, 20, 2000, 60])]
    blocks = list(decontaminate.item_blocks(spark.createDataFrame(items, "item_id bigint, text string"), 12))
    assert [b.ids for b in blocks] == [[0, 1, 2], [3], [4]]
    parts, of = blocks[0].parts()
    assert np.bincount(of).tolist() == [1, 10, 1]
    assert np.concatenate(parts).tolist() == np.concatenate(blocks[0].codes).tolist()


def test_items_go_in_blocks(spark):
    items, _, _ = leaks()
    bench = spark.createDataFrame(items + items[:4], "item_id bigint, text string")
    blocks = list(decontaminate.item_blocks(bench, 25))
    assert [len(b.ids) for b in blocks] == [25, 25, 10]
    # an item that comes again in a later block is the same item
    again = spark.createDataFrame(items + [(i + 500, t) for i, t in items[:4]], "item_id bigint, text string")
    assert [i for b in decontaminate.item_blocks(again, 25) for i in b.ids] == [i for i, _ in items]


def test_blocks_of_items_find_the_same(spark, docs, monkeypatch):
    items, rows, planted = leaks(13)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (20,))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(docs(rows), bench).collect()}
    assert got == planted


def test_latent_space_retrieves_paraphrases_that_words_miss(spark, docs, monkeypatch):
    """Topics whose words have synonyms that stand in the same company: a paraphrase that shares few words with its item is found
    in the latent space, and isn't by the words alone."""
    r = random.Random(21)
    topics = [[(a, b) for a, b in zip(words(r, 24), words(r, 24), strict=True)] for _ in range(40)]
    other = words(r, 2000)
    texts = []
    for d in range(1200):
        own = [r.choice(pair) for pair in r.choices(topics[d % 40], k=40)]
        texts.append((d, " ".join(w if r.random() < 0.7 else r.choice(other) for w in own)))
    items = [(i, " ".join(a for a, _ in topic)) for i, topic in enumerate(topics)]
    # 18 of 24 words are replaced
    said = [" ".join(b if k % 4 else a for k, (a, b) in enumerate(topic)) for topic in topics]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    # topics are frequent here, as there are only 40 of them
    monkeypatch.setattr(decontaminate, "COMMON", 0.2)
    monkeypatch.setattr(decontaminate, "ITEM_ENERGY", 0.1)
    (model,), _ = decontaminate.models(docs(texts), bench)
    plain = decontaminate.Model(model.items, model.idf, np.eye(decontaminate.FEATURES, dtype=np.float32), 1.0)

    def cosines(m):
        out = []
        for i, text in enumerate(said):
            codes = decontaminate.codes_of(text.split())
            hits = [c for p, part, cos in m.near(codes, np.array([len(codes)])) for q, c in zip(part, cos, strict=True) if q == i]
            out.append(max(hits, default=0.0))
        return np.array(out)

    monkeypatch.setattr(decontaminate, "COSINE", 0.5)
    latent, by_words = cosines(model), cosines(plain)
    assert (latent >= 0.5).mean() >= 0.9 and (by_words >= 0.5).mean() <= 0.1


def test_decontamination_odd_rows(spark, docs, odd):
    items, _, _ = leaks()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert decontaminate.find(odd, bench).count() == 0 and decontaminate.remove(odd, bench).count() == len(ODD)
    assert decontaminate.find(odd, bench.limit(0)).count() == 0
    assert decontaminate.find(docs([]), bench).count() == 0


def test_lcs():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randint(0, 14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.lcs(decontaminate._masks(a), len(a), b) == table[-1][-1]


def test_leak_entry(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    planted = {(d, i) for d, t in texts.items() for i, b in bench.items() if b in t}
    got = {(r.doc_id, r.item_id) for r in decontaminate.op7_decontamination(spark, sf).select("doc_id", "item_id").collect()}
    assert planted <= got and len(got - planted) <= 2


def test_pipeline_matches_brute_force(spark, sf):
    """The whole pipeline against its decisions made one by one in plain Python."""
    import corpus_pipeline
    from test_dedup import classes, fingerprint

    from lodestack.llm import packing, secrets, tokens

    source = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame(
        [(-1, None, "en", "s", None), (-2, "", "en", "s", 0), (10**6, "x " * 30_000, "en", "s", 60_000), (None, "y y", None, None, 3)],
        source.schema,
    )
    rows = [tuple(r) for r in source.unionByName(odd).collect()]
    machine = quality.fit(source.unionByName(odd), spark.read.parquet(f"{sf}/labels.parquet"))
    good = machine.scores([quality.features(r[1]) for r in rows]) >= quality.THRESHOLD
    rows = [r for r, g in zip(rows, good, strict=True) if g]
    prints = [fingerprint(r[1]) for r in rows]
    of = classes(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    best = {}
    for i, (r, p, k) in enumerate(zip(rows, prints, of, strict=True)):
        best[k] = min(best.get(k, (2,)), (r[0] is None, r[0] or 0, p - (p >> 63 << 64), r[1] or "", i))
    rows = [rows[b[-1]] for b in best.values()]
    bench = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def leaked(text):
        joined = f" {' '.join(decontaminate.words_of(text))} "
        return any(f" {' '.join(b)} " in joined for b in bench)

    rows = [r for r in rows if not leaked(r[1])]
    spans = {r.doc_id: r.secret_spans for r in secrets.scan(spark.createDataFrame(rows, source.schema)).collect()}
    want = {}
    for doc_id, text, *_ in rows:
        out, at = "", -1
        for s in spans[doc_id]:
            if s.start > at or at < 0:
                out += text[max(at, 0) : s.start] + "[SECRET]"
            at = max(at, s.stop)
        ids = np.array([*tokens._tokenizer(tokens.vocabulary()).encode(out + (text or "")[max(at, 0) :], add_special_tokens=False).ids, 0])
        want[doc_id] = [(a, n, tokens.crc32(ids[a : a + n])) for a, n in packing.cut(len(ids), packing.CAPACITY)]
    docs = source.unionByName(odd)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
    got, full = {}, {}
    for r in docs.orderBy("doc_id", "piece").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    # near passages are the decontamination's own; verbatim ones must go
    assert got.keys() <= want.keys() and len(want) - len(got) <= 2
    assert all(got[k] == want[k] for k in got)
    for places in full.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_pipeline_takes_empty_tables(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_pipeline_stages_take_effect(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns
        if name in ("quality_filter", "simhash_dedup"):
            assert docs.count() < n
        n = docs.count()
    assert docs.where(F.col("text").rlike("token = \"[0-9a-f]{40}")).count() == 0
    whole = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in whole.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
