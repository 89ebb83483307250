"""Grouped aggregates with generated names, and whole-column statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from capital_access.functions.nulls import as_col, max_of, ratio, sum_of, weighted_mean
from capital_access.functions.text import first_chars
from capital_access.session import settle


def many(
    columns: Iterable[str],
    functions: Mapping[str, Callable[[str], Column]],
    name: str = "{column}_{function}",
) -> list[Column]:
    """One aggregate per column and function, all for a single ``agg``."""
    return [
        fn(c).alias(name.format(column=c, function=label))
        for c in columns
        for label, fn in functions.items()
    ]


def weighted_means(x: Column | str, weights: Mapping[str, Column | str], na_rm: bool = True) -> list[Column]:
    """The mean of one measure under several weights, ``{output name: weight}``."""
    return [weighted_mean(x, w, na_rm).alias(name) for name, w in weights.items()]


def roll_up_code(
    df: DataFrame, code: str, length: int, measures: Sequence[str], into: str, na_rm: bool = False
) -> DataFrame:
    """Sum measures to a coarser geography, whose code is a prefix of the finer one."""
    return df.groupBy(first_chars(code, length).alias(into)).agg(
        *[sum_of(m, na_rm).alias(m) for m in measures]
    )


def peer_stats(df: DataFrame, rates: Mapping[str, tuple]) -> Column:
    """Best and average rate over all rows, as a scalar subquery.

    ``rates`` maps a name to ``(rate, weight)`` or ``(rate, weight, na_rm_max,
    na_rm_mean)``; the result is a struct ``name -> (best, average)``. All come
    from one one-row aggregate: nothing is sorted or gathered in one partition.
    The rows are read twice, here and by the caller, so settle what was
    aggregated from facts before.
    """
    stats = []
    for name, (rate, weight, *na_rm) in rates.items():
        na_max, na_mean = na_rm or (True, True)
        stats.append(
            F.struct(
                max_of(rate, na_max).cast("double").alias("best"),
                weighted_mean(rate, weight, na_mean).alias("average"),
            ).alias(name)
        )
    return df.agg(F.struct(*stats).alias("peers")).scalar()


def compare_to_peers(df: DataFrame, gaps: Mapping[str, tuple]) -> DataFrame:
    """Add the distance to the best and to the average row for each compared rate.

    ``gaps`` is given as in ``peer_stats``: ``name`` becomes (best rate - rate)
    * weight and ``name_avg`` the same for the mean rate weighted by ``weight``.
    """
    added = {}
    for name, (rate, weight, *_) in gaps.items():
        peers = F.col("_peers")[name]
        added[name] = (peers["best"] - as_col(rate)) * as_col(weight)
        added[f"{name}_avg"] = (peers["average"] - as_col(rate)) * as_col(weight)
    return df.withColumn("_peers", peer_stats(df, gaps)).withColumns(added).drop("_peers")


def shares(df: DataFrame, total: str, parts: Mapping[str, str]) -> DataFrame:
    """Add ``{output name: part}`` as shares of ``total``."""
    return df.withColumns({name: ratio(part, total) for name, part in parts.items()})


# Buckets per doubling of a value, and an offset above the exponent range of doubles.
_BUCKETS_PER_DOUBLING = 64
_BUCKET_OFFSET = 100_000


def _magnitude_bucket(v: Column) -> Column:
    """Bucket number that never falls when the value rises; about 1% wide, infinities at the ends."""
    size = F.abs(v)
    finite = F.when(size < float("inf"), size)
    steps = F.coalesce(F.floor(F.log2(finite) * _BUCKETS_PER_DOUBLING), F.lit(_BUCKET_OFFSET).cast("long")) + _BUCKET_OFFSET
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, steps).when(v < 0, -steps)


def _present(column: str) -> Column:
    """The column as a double, NaN counted as missing."""
    return F.nanvl(as_col(column).cast("double"), F.lit(None).cast("double"))


def _bucket_totals(df: DataFrame, column: str) -> DataFrame:
    """Count, sum, least and largest value per magnitude bucket; missing values have none.

    At most about 270,000 rows (64 per doubling over the exponents of doubles, for
    both signs) whatever the size of the data, reduced before their shuffle and
    settled, so that the data is scanned once for all of them.
    """
    v = _present(column)
    totals = df.groupBy(_magnitude_bucket(v).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(v).alias("sum"), F.min(v).alias("least"), F.max(v).alias("most")
    )
    return settle(totals, "buckets")


# Rows that one task may rank; larger intervals are split into this many parts first.
_RANKED_AT_ONCE = 100_000
_PARTS = 256


def _wanted_ranks(totals: DataFrame, probabilities: Sequence[float]) -> list[dict]:
    """For each probability the one or two ranks it lies between: interval of values, rank in it, rows in it."""
    # The exponent range of doubles limits the number of buckets, so one partition can order them.
    across = Window.orderBy("bucket")
    buckets = totals.filter(F.col("bucket").isNotNull()).select(
        "least", "most", F.col("n").alias("inside"),
        (F.sum("n").over(across.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    wanted = (
        buckets.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
        .withColumn("position", (F.col("total") - 1) * F.col("p"))
        .withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("position"), F.ceil("position")))))
        .withColumn("rank", F.col("rank") - F.col("before"))
        .filter((F.col("rank") >= 0) & (F.col("rank") < F.col("inside")))
        .select("p", (F.col("position") - F.floor("position")).alias("fraction"), "rank", "least", "most", "inside")
    )
    return [row.asDict() for row in wanted.collect()]  # at most two for each probability


def _interval_part(v: Column, intervals: Sequence[tuple[float, float]]) -> Column:
    """(interval, part) of a value: which of a few intervals it lies in, and where in it."""
    found = F.lit(None).cast("struct<interval:int,part:bigint>")
    for k, (low, high) in enumerate(intervals):
        part = F.floor((v - low) / (high - low) * _PARTS) if low < high else F.lit(0).cast("long")
        inside = (v >= low) & (v <= high)
        found = F.when(inside, F.struct(F.lit(k).alias("interval"), part.alias("part"))).otherwise(found)
    return found


def _narrowed(df: DataFrame, column: str, wanted: list[dict]) -> list[dict]:
    """The ranks with intervals that hold few rows or a single value, one scan for each round of splitting."""
    v = _present(column)
    while large := [w for w in wanted if w["inside"] > _RANKED_AT_ONCE and w["least"] < w["most"]]:
        intervals = sorted({(w["least"], w["most"]) for w in large})
        parts = (
            df.select(v.alias("v")).withColumn("at", _interval_part(F.col("v"), intervals)).filter(F.col("at").isNotNull())
            .groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most")))
        found = sorted(parts.collect(), key=lambda r: r["at"])  # at most _PARTS + 1 rows for each interval
        for w in large:
            mine = intervals.index((w["least"], w["most"]))
            for r in found:
                if r["at"]["interval"] != mine:
                    continue
                if w["rank"] < r["n"]:
                    w.update(least=r["least"], most=r["most"], inside=r["n"])
                    break
                w["rank"] -= r["n"]
    return wanted


def _ranked_values(
    df: DataFrame, column: str, totals: DataFrame, probabilities: Sequence[float]
) -> DataFrame:
    """Interpolated quantiles as rows (p, value), from the values of the intervals that hold them.

    An interval with many rows is split between its least and its largest value
    until it holds few rows or one value, so no task ranks more than that.
    """
    spark = df.sparkSession
    wanted = _narrowed(df, column, _wanted_ranks(totals, probabilities))
    intervals = sorted({(w["least"], w["most"]) for w in wanted})
    asked = spark.createDataFrame(
        [(intervals.index((w["least"], w["most"])), w["p"], w["fraction"], w["rank"]) for w in wanted],
        "interval int, p double, fraction double, rank long")
    # Only the values of these intervals are counted one by one.
    counts = (
        df.select(_present(column).alias("v")).withColumn("interval", _interval_part(F.col("v"), intervals)["interval"])
        .filter(F.col("interval").isNotNull()).groupBy("interval", "v").agg(F.count(F.lit(1)).alias("n")))
    ordered = Window.partitionBy("interval").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("last", F.sum("n").over(ordered)).withColumn("first", F.col("last") - F.col("n"))
    found = ranked.join(asked, "interval").filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    low, high = F.min("v"), F.max("v")
    between = F.when(low == high, low).otherwise(low + (high - low) * F.max("fraction"))
    return found.groupBy("p").agg(between.alias("value"))


def quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles of a whole column, as rows (p, value).

    The built-in ``percentile`` merges the counts of all distinct values in one
    task. Here one scan counts the values per magnitude bucket, which tells the
    buckets that hold a wanted rank, and a last scan ranks the values of only
    these; a bucket of many rows costs a scan for each time it is split. None
    shuffles the column. Infinities are the least and the largest values.
    """
    return _ranked_values(df, column, _bucket_totals(df, column), probabilities)


def six_numbers(df: DataFrame, column: str) -> DataFrame:
    """Minimum, quartiles, mean, maximum and number of missing values, as one row."""
    totals = _bucket_totals(df, column)
    present = F.col("bucket").isNotNull()
    quartiles = _ranked_values(df, column, totals, (0.25, 0.5, 0.75)).agg(
        *[
            F.max(F.when(F.col("p") == p, F.col("value"))).alias(name)
            for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))
        ]
    )
    found = quartiles.select(F.struct("q1", "median", "q3")).scalar()
    ends = totals.agg(
        F.min("least").alias("min"),
        F.max("most").alias("max"),
        ratio(F.sum("sum"), F.sum(F.when(present, F.col("n")))).alias("mean"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("n_missing"),
    ).withColumn("_q", found)
    return ends.select("min", "_q.q1", "_q.median", "mean", "_q.q3", "max", "n_missing")
