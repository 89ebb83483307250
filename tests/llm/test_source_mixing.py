"""Replication numbers against the inverse distribution in plain Python."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from capital_access.llm import source_mixing as m

SHAPE = "doc_id long, text string, source string"


def plain_count(rate, doc_id, seed=42):
    draws = max(1, math.ceil(rate / 16.0))
    mean, total = rate / draws, 0
    for k in range(1, draws + 1):
        u = int(hashlib.md5(f"{seed}:{'null' if doc_id is None else doc_id}:{k}".encode()).hexdigest()[:13], 16) / 2 ** 52
        p = c = math.exp(-mean)
        n = 0
        while c <= u and n < 80:
            n += 1
            p *= mean / n
            c += p
            total += 1
    return total


def test_copies_and_weights(spark):
    rows = [(k, "t" * (k % 7 + 1), "big" if k % 3 else "small") for k in range(3000)]
    df = spark.createDataFrame(rows, SHAPE)
    mixed = m.mix_sources(df, weights={"big": 1.0, "small": 3.0})
    sizes = {s: sum(len(t) for _, t, x in rows if x == s) for s in ("big", "small")}
    rate = {s: w / 4 * sum(sizes.values()) / sizes[s] for s, w in (("big", 1), ("small", 3))}
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, _, s in rows if (n := plain_count(rate[s], i))}
    share = {r.source: r.chars for r in mixed.groupBy("source").agg(F.sum(F.length("text")).alias("chars")).collect()}
    assert abs(share["small"] / sum(share.values()) - 0.75) < 0.02
    keys = [r.shuffle_key for r in mixed.select("shuffle_key").collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert mixed.where("copy < 1").count() == 0


def test_large_rates_are_sums_of_draws(spark):
    df = spark.createDataFrame([(k, "x", "rare") for k in range(200)] + [(1000 + k, "x" * 400, "common") for k in range(200)], SHAPE)
    got = m.mix_sources(df, weights={"rare": 1.0, "common": 1.0}).where("source = 'rare'").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {k: plain_count(200.5, k) for k in range(200)}
    assert sum(r["count"] for r in got) / 200 == pytest.approx(200.5, rel=0.02)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "a"), (None, "text", "a"), (3, "z", "b"), (3, "z", "b")], SHAPE + "").withColumns(
        {"copy": F.lit(9), "rate": F.lit(8), "cdf": F.lit(7)})
    mixed = m.mix_sources(df, epochs=50.0)
    assert mixed.columns == [*df.columns, "copy_", "shuffle_key"]
    rows = mixed.collect()
    assert {r.source for r in rows} == {None, "a", "b"} and {r.copy for r in rows} == {9}
    assert m.mix_sources(df.where("false")).collect() == []
    rates = {r.mix_source: r.rate for r in m.repetition_rates(df, "source", "text", {"a": 1.0, None: 1.0}).collect()}
    assert rates["b"] == 1.0 and rates["a"] == pytest.approx(3 / 5) and rates[None] == pytest.approx(3.0)
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
