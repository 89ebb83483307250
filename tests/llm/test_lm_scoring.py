"""Language-model scores against plain counts, a plain model, and held-out texts."""

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from capital_access.llm import lm_scoring as m
from capital_access.llm.queries import op12

SPACES = " \t\n\x0b\x0c\r"
COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def tokens(text):
    out, word = [], ""
    for ch in (text or "") + " ":
        if ch in SPACES:
            if word:
                out.append(word.encode())
            word = ""
        else:
            word += ch.lower() if "A" <= ch <= "Z" else ch
    return [*out, b""]


def brute(rows):
    """(held_out, n_tokens, n_known, train_tokens, base_score) of each row, in order."""
    held = [None if i is None else crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    counts = Counter(t for h, (_, text) in zip(held, rows) if h is False for t in tokens(text))
    total, distinct, out = sum(counts.values()), len(counts), []
    for h, (_, text) in zip(held, rows):
        words = tokens(text)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        out.append((h, len(words), sum(counts[w] > 0 for w in words), total, base))
    return out


def check(got, rows):
    assert len(got) == len(rows)
    for r, (h, n, known, total, base) in zip(got, brute(rows)):
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-9) and -1e9 < r["score"] <= 1e-6


def test_pieces():
    for text in ("", None, "One two\x0bTHREE four é É", " x ", "a" * 50, "word " * 40):
        whole = tokens(text)
        for most in (1, 7, 1 << 20):
            assert [t for piece in m.token_pieces(text, most) for t in piece] == whole


def test_rows(spark, docs):
    long = "word other " * 150_000 + "x" * 3_000_000
    pairs = [(k, f"The cat {k % 7} sat on the mat {k % 3}") for k in range(60)] + [
        (60, None), (61, ""), (62, long), (63, "unheard of " + "y" * 200), (64, "y" * 200), (65, "y" * 200), (None, "The cat"), (66, "again"), (66, "again")]
    df = docs(pairs).withColumns({c: F.lit(1) for c in ("row", "rare", "token", "times", "held_out", "score")})
    for shape in (m.ModelShape(), m.ModelShape(head=4, buckets=3, looked_up=6, width=4, context=3, rounds=2, batch=16)):
        found = m.score_documents(df, shape=shape)
        assert found.columns == COLUMNS
        check(sorted(found.collect(), key=lambda r: str(r["doc_id"])), sorted(pairs, key=lambda p: str(p[0])))
    assert m.score_documents(docs([])).collect() == []


def test_nothing_to_learn_from(docs):
    rows = [(None, "a b"), (None, None)]
    got = m.score_documents(docs(rows)).collect()
    check(got, rows)


def vocabulary(counts, shape):
    ranked = sorted(counts.items(), key=lambda c: (-c[1], c[0]))
    weights, kinds = np.zeros(shape.buckets, "i8"), np.zeros(shape.buckets, "i8")
    for token, n in ranked[shape.head:]:
        weights[crc32(token) % shape.buckets] += n
        kinds[crc32(token) % shape.buckets] += 1
    top = ranked[:shape.looked_up]
    return m.Vocabulary(shape, [t for t, _ in top], np.array([n for _, n in top], "i8"), sum(counts.values()), len(counts), weights, kinds)


def test_vocabulary_of_a_table(spark, small):
    texts = [r["text"] for r in small("documents").select("text").collect()]
    counts = Counter(t for text in texts for t in tokens(text))
    shape = m.ModelShape(looked_up=500)
    found, others = m.build_vocabulary(m.token_counts(small("documents"), most=100), shape)
    plain = vocabulary(counts, shape)
    assert 400 <= len(found.tokens) <= 500 and found.tokens == plain.tokens[:len(found.tokens)]
    assert (found.total, found.distinct) == (plain.total, plain.distinct)
    assert found.weights.tolist() == plain.weights.tolist() and found.kinds.tolist() == plain.kinds.tolist()
    assert {bytes(r["token"]): r["times"] for r in others.collect()} == {t: n for t, n in counts.items() if t not in set(found.tokens)}


def test_shares_add_up_to_one_and_equal_a_plain_model():
    counts = Counter({b"": 5, b"a": 9, b"b": 4, b"c": 2, b"d": 1, b"e": 1})
    shape = m.ModelShape(head=3, buckets=2, width=5, context=2)
    v = vocabulary(counts, shape)
    model = m.LogBilinear(shape, v.unigrams)
    rng = np.random.default_rng(0)
    model.unpack(rng.normal(0, 1, model.packed().size))
    reader = m.Reader(v)
    unseen = {crc32(w) % 2: w for w in (b"zz", b"yy", b"xx", b"ww", b"vv")}
    outcomes = [*counts, *unseen.values()]
    for before in [(5, 5), (0, 5), (3, 1), (4, 4)]:
        hidden = sum(model.inputs[c].astype("f8") @ model.matrices[k] for k, c in enumerate(before))
        scores = np.exp(model.outputs @ hidden + model.bias)
        numbers = reader.numbers(outcomes)
        cells = reader.cell[numbers]
        got = model.log_probabilities(cells, np.tile(np.array(before, "i4"), (len(cells), 1)))
        assert np.allclose(got, np.log(scores[cells] / scores.sum()), atol=1e-5)
        own = np.array([math.log10(0.1) if w in unseen.values() else 0 for w in outcomes])
        assert np.exp(got).dot(10 ** (reader.within[numbers] + own)) == pytest.approx(1, abs=1e-5)
    model.unpack(model.packed() * 40)  # exponentials of such scores overflow
    far = model.log_probabilities(np.arange(5, dtype="i4"), np.full((5, 2), 5, "i4"))
    assert np.isfinite(far).all() and np.exp(far).sum() == pytest.approx(1, abs=1e-4)


def test_gradients():
    """A step goes down the noise-contrastive loss, by its numeric slope."""
    shape = m.ModelShape(width=3, noise=4, context=2)
    unigrams = np.array([0.4, 0.3, 0.2, 0.1])
    model = m.LogBilinear(shape, unigrams)
    model.unpack(np.random.default_rng(2).normal(0, 0.5, model.packed().size))
    targets, before = np.array([0, 1, 1, 3, 2], "i4"), np.array([[4, 4], [0, 4], [1, 0], [1, 1], [3, 1]], "i4")
    noise = np.minimum(np.searchsorted(np.cumsum(unigrams), np.random.default_rng(9).random(4)), 3)

    def loss(values):
        sized = [getattr(model, n).size for n in model.NAMES]
        inputs, outputs, bias, matrices = (v.reshape(getattr(model, n).shape) for v, n in zip(np.split(values, np.cumsum(sized)[:-1]), model.NAMES))
        hidden = sum(inputs[before[:, k]] @ matrices[k] for k in range(2))
        score = hidden @ outputs.T + bias - np.log(4 * unigrams)
        return (np.logaddexp(0, -score[np.arange(5), targets]).sum() + np.logaddexp(0, score[:, noise]).sum()) / 5

    given, slopes = model.packed(), {}
    trainer = m.Trainer(model, 9)
    trainer._move = lambda name, gradient: slopes.__setitem__(name, gradient.ravel())
    trainer.step(targets, before)
    mine = np.concatenate([slopes[n] for n in model.NAMES])
    for k in range(len(given)):
        up, down = given.copy(), given.copy()
        up[k] += 1e-4
        down[k] -= 1e-4
        assert mine[k] == pytest.approx((loss(up) - loss(down)) / 2e-4, abs=2e-4)


def test_held_out_texts_are_likelier_than_by_counts(spark):
    rows = sorted(op12(spark, "/root/testdata/sf0.01").collect(), key=lambda r: r["doc_id"])
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    check(rows, sorted(tuple(r) for r in documents))
    held = [r for r in rows if r["held_out"] and r["n_tokens"] > 20]
    assert len(held) > 50 and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
