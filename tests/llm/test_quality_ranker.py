"""Scores on the held-out fold, and the edges."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from capital_access.llm import quality_ranker as m


def test_pairs_recover_an_order():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, len(m.FEATURES)))
    good = x[:, 3] + 0.1 * rng.standard_normal(400) > -0.8
    model = m.fit_pairs(x, good)
    score = model.score(x)
    assert ((score >= 0.3) == good).mean() > 0.93
    assert abs((score < 0.3).mean() - (~good).mean()) < 0.01  # the cut is the quantile of the rejected share


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = m.score_documents(docs, labels)
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    flipped = labels.withColumn("quality", F.when(m.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = m.score_documents(docs, flipped)  # labels of the held-out fold change nothing
    assert sorted(map(tuple, scored.collect())) == sorted(map(tuple, other.collect()))


def test_edges(spark, docs):
    df = docs([(1, "Some good words stand here."), (None, None), (2, ""), (2, ""), (3, "JUNK!! JUNK!! JUNK!!")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in m.score_documents(df, none).collect()} == {(0.5, 1)}
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    train = docs([(i, "JUNK!! " * (i + 2) if i % 2 else f"A plain sentence number {i} that says some things." * (1 + i % 4)) for i in ids])
    labels = spark.createDataFrame([(i, 1 - i % 2, None) for i in ids] + [(None, 1, 0), (7, None, 0), (10 ** 9, 1, 0)], "doc_id long, quality int, toxic int")
    clash = train.withColumns({"score": F.lit("x"), "label": F.lit(3), "label_id": F.lit(4)})
    kept = m.keep_preferred(clash, labels)
    assert kept.columns == clash.columns
    assert {r.doc_id % 2 for r in kept.collect()} == {0}
    assert m.score_documents(docs([]), labels).collect() == [] and m.keep_preferred(docs([]), labels).collect() == []
    scored = m.score_documents(train.unionByName(df), labels)
    assert scored.where("score BETWEEN 0 AND 1").count() == scored.count() == len(ids) + 5
    assert {r.held_out for r in scored.where("doc_id IS NULL").collect()} == {None}


def test_features_of_long_and_odd_texts():
    assert not m.text_features(None).any() and not m.text_features(" \n").any()
    x = m.text_features("word " * 400_000 + "😀 é")
    assert np.isfinite(x).all() and x.shape == (len(m.FEATURES),)


def test_sample_is_bounded(spark):
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    from capital_access.llm.common import bounded_sample
    picked = [sorted(r.doc_id for r in bounded_sample(labels.repartition(n), 1000, "doc_id").collect()) for n in (1, 7)]
    assert picked[0] == picked[1] and 850 < len(picked[0]) <= 1000


def test_one_id_on_many_rows_is_bounded(spark, docs, monkeypatch):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    many = docs([(ids[0], f"text {'word ' * (k % 97)} number {k}") for k in range(3000)] + [(i, f"Plain text {i}. " * (1 + i % 5)) for i in ids[1:]])
    labels = spark.createDataFrame([(i, i % 2, None) for i in ids], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(m, "fit_pairs", lambda x, good, threshold: seen.append(x))
    for parts in (1, 5):
        m.fit_quality(many.repartition(parts), labels, texts_per_id=4)
    assert len(seen[0]) == len(ids) - 1 + 4 and (seen[0] == seen[1]).all()


def test_fit_equals_plain_descent():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((30, len(m.FEATURES)))
    good = x[:, 0] - 0.5 * x[:, 2] + 0.7 * rng.standard_normal(30) > 0
    model = m.fit_pairs(x, good, partners=max(good.sum(), (~good).sum()), ridge=0.01)  # every pair is met once
    z = np.clip((m._expand(x) - model.mean) / model.scale, -8, 8)
    pairs = np.array([a - b for a in z[good] for b in z[~good]])
    w = np.zeros(z.shape[1])
    for _ in range(20_000):
        p = 1 / (1 + np.exp(pairs @ w))
        w += 0.5 * ((pairs * p[:, None]).mean(0) - 0.01 * w)
    assert np.allclose(w, model.weights, atol=1e-4)
