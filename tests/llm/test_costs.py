"""What the operators' inner loops are spared, and that their results are those of the plain form."""

import numpy as np
import pyarrow as pa

from lodestack.llm import decontaminate, masked_lm, tokens


class Counted(np.ndarray):
    """Counts how often it is changed."""

    changes = 0

    def __setitem__(self, at, value):
        self.changes += 1
        np.ndarray.__setitem__(self, at, value)

    def __iadd__(self, other):
        self.changes += 1
        return np.ndarray.__iadd__(self, other)


def plain_gradient(p, around, words):
    """Of the mean negative log-probability, target by target, in double precision."""
    p = {k: v.astype(np.float64) for k, v in p.items()}
    d = {k: np.zeros_like(v) for k, v in p.items()}
    for t, word in enumerate(words):
        h = np.tanh(p["b"] + sum(p["e"][k][around[k][t]] for k in range(len(around))))
        dh, of = 0, word // masked_lm.PER_CLASS
        for name, own, hit in (
            ("c", slice(None), of),
            ("w", slice(of * masked_lm.PER_CLASS, (of + 1) * masked_lm.PER_CLASS), word % masked_lm.PER_CLASS),
        ):
            dz = np.exp(p[name][own] @ h + p[name + "b"][own])
            dz /= dz.sum()
            dz[hit] -= 1
            d[name][own] += np.outer(dz, h) / len(words)
            d[name + "b"][own] += dz / len(words)
            dh = dh + dz @ p[name][own]
        dh = dh * (1 - h * h) / len(words)
        d["b"] += dh
        for k in range(len(around)):
            d["e"][k][around[k][t]] += dh
    return d


def test_a_step_changes_each_array_once():
    rng = np.random.default_rng(3)
    n = 400
    words = np.concatenate((np.arange(masked_lm.CLASSES) * masked_lm.PER_CLASS, rng.integers(0, 90, n - masked_lm.CLASSES)))
    around = rng.integers(0, 300, (len(masked_lm.OFFSETS), n)).astype(np.int32)
    around[0, :20] = masked_lm.PAD
    before = masked_lm.start(np.ones(masked_lm.WORDS))
    p = masked_lm.unpack(before.copy())
    g = {k: v.view(Counted) for k, v in masked_lm.unpack(np.full(len(before), 1e-4, np.float32)).items()}
    masked_lm._step(p, g, around, words.astype(np.int32))
    was = masked_lm.unpack(before)
    for name, d in plain_gradient(was, around, words).items():
        assert np.allclose(g[name], 1e-4 + d * d, rtol=1e-3, atol=1e-8)
        assert np.allclose(p[name], was[name] - masked_lm.RATE * d / np.sqrt(1e-4 + d * d), atol=1e-5)
    assert g["w"].changes == g["wb"].changes == 1  # all 64 classes have targets


def test_few_windows_reach_the_subsequence(monkeypatch):
    rng = np.random.default_rng(5)
    item = rng.permutation(400)[:48].astype(np.uint32)
    others = rng.integers(0, 400, (60, 48)).astype(np.uint32)  # with some of the item's words, but never half of them
    docs = [*others, np.concatenate((others[0], item, others[1]))]
    items = decontaminate.Items([7], [item])
    idf = np.ones(decontaminate.FEATURES, np.float32)
    space = np.linalg.qr(rng.normal(size=(decontaminate.FEATURES, 8)))[0].astype(np.float32)
    monkeypatch.setattr(decontaminate, "COSINE", -1.0)  # all windows are near
    calls, lcs = [], decontaminate.lcs
    monkeypatch.setattr(decontaminate, "lcs", lambda *a: calls.append(a) or lcs(*a))
    model = decontaminate.Model(items, idf, space, 1.0)
    counts = np.array([len(d) for d in docs])
    got = [x[:2] for x in model.search(np.concatenate(docs), counts)]
    assert got == [(60, 0)]
    assert len(calls) < 60  # the windows of the first 60 documents have too few of the item's words


def test_segment_sums():
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(50, 5)).astype(np.float32)
    for sizes in ([], [1], [3], [900, 1, 2], [1] * 30, rng.integers(1, 40, 200), [*([25] * 9), 70, 2000]):
        sizes = np.array(sizes, np.int64)
        index = rng.integers(0, 50, int(sizes.sum()))
        got = decontaminate._segment_sums(rows, index, np.cumsum(sizes) - sizes)
        want = [rows[index[e - n : e]].astype(float).sum(0) for e, n in zip(np.cumsum(sizes), sizes, strict=True)]
        assert got.shape == (len(sizes), 5) and np.allclose(got, np.array(want).reshape(-1, 5), atol=1e-3)


def test_words_are_encoded_together(monkeypatch):
    real = tokens._tokenizer(tokens.vocabulary())
    given = []

    class Spy:
        def __getattr__(self, name):
            return getattr(real, name)

        def encode_batch_fast(self, texts, **more):
            given.extend(texts)
            return real.encode_batch_fast(texts, **more)

    monkeypatch.setitem(tokens._loaded, tokens.vocabulary(), Spy())
    words = [f"w{chr(97 + i % 26)}ß{i}日,.\nX" for i in range(20_000)]
    odd = ["", "\n", "a\n", " b", "<|endoftext|>", "x<|endoftext|>y", "<|endof", "text|>", "'s", "'ll'", "_", " ", "\x1c"]
    texts = ["one " + " ".join(words), None, "", *odd, "two " + " ".join(odd * 3), " ".join(words[::2])]
    ids, counts = tokens.encode(pa.array(texts), tokens.vocabulary())
    ends = np.cumsum(counts)
    for t, e, n in zip(texts, ends, counts, strict=True):
        assert ids[e - n : e].tolist() == real.encode(t or "", add_special_tokens=False).ids
    assert sum(t.count("<|endoftext|>") for t in given) < 100  # no separator for each of the 20,000 words
