"""One key holds a third of the rows: results stay whole and the hot partition is split."""

import pytest
from pyspark.sql import functions as F

from capital_access.operators import joins, rows as row_ops
from capital_access.operators.quality import join_accounting

TINY = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture
def no_broadcast(spark):
    before = {k: spark.conf.get(k, None) for k in TINY}
    for key, value in TINY.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def facts(spark):
    n = 60_000
    hot = F.col("id") % 3 == 0
    return spark.range(0, n, 1, 12).select(
        F.when(hot, -1).otherwise(F.col("id") % 5000).alias("k"), F.xxhash64("id").alias("v"), F.col("id")
    )


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def counts(df, *columns):
    return df.agg(F.count(F.lit(1)), *[F.sum(F.hash(c).cast("long")) for c in columns]).first()[:]


def test_dimension_first_join_splits_the_hot_key(spark, facts, no_broadcast):
    dim = spark.range(-1, 6000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("d"))
    joined = joins.left_join_from_dim(dim, facts, "k")
    assert "skew=true" in final_plan(joined)
    assert counts(joined, "k", "v", "d") == counts(dim.join(facts, ["k"], "left"), "k", "v", "d")


def test_full_join_splits_the_hot_key(spark, facts, no_broadcast):
    right = spark.range(-1, 9000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("d"))
    joined = joins.full_join(facts, right, "k")
    assert "skew=true" in final_plan(joined)
    assert counts(joined, "k", "v", "d") == counts(facts.join(right, ["k"], "full"), "k", "v", "d")


def test_full_join_splits_a_key_hot_on_both_sides(spark, facts, no_broadcast):
    right = spark.range(0, 300, 1, 4).select(F.when(F.col("id") < 100, -1).otherwise(F.col("id") * 40).alias("k"), (F.col("id") * 2).alias("d"))
    joined = joins.full_join_many(facts, right, "k")
    assert "skew=true" in final_plan(joined)
    assert counts(joined, "k", "v", "d") == counts(facts.join(right, ["k"], "full"), "k", "v", "d")


def test_best_rows_of_a_hot_group_with_many_ties(spark, facts, no_broadcast):
    rated = facts.withColumn("m", F.col("id") % 2)
    best = row_ops.top_with_ties(rated, ["k"], ["m"])
    assert "Window" not in final_plan(best)
    expected = rated.join(rated.groupBy("k").agg(F.max("m").alias("m")), ["k", "m"])
    assert counts(best, "k", "id") == counts(expected, "k", "id")
    assert best.filter("k = -1").count() == 10_000


def test_accounting_joins_one_row_per_key(spark, facts):
    dim = spark.range(-1, 100).select(F.col("id").alias("k"))
    assert join_accounting(facts, dim, ["k"]).first()[1:] == (60_000, 20_800, 39_200, 60_000)


def test_distinct_keys_are_resolved_once(spark, facts):
    seen = []

    def resolve(keys):
        seen.append(keys.count())
        return keys.withColumn("code", F.col("k") * 10)

    located = joins.resolve_and_join_back(facts, ["k"], resolve)
    assert located.count() == 60_000 and seen == [5001]
