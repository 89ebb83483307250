"""Row accounting: how many rows each step keeps, drops or matches.

The counts are ordinary aggregates, so they are exact also when tasks or
executors are lost and run again; accumulator-based metrics would then count twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from capital_access.functions.nulls import as_col


def filter_accounting(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows before and after each filter of a chain, all counted in one pass."""
    passed = [F.lit(True)]
    for _, condition in steps:
        passed.append(passed[-1] & F.coalesce(condition, F.lit(False)))
    counts = df.agg(*[F.count_if(p).alias(f"_{i}") for i, p in enumerate(passed)])
    rows = [
        F.struct(
            F.lit(i + 1).cast("long").alias("position"),
            F.lit(name).alias("step"),
            F.col(f"_{i}").alias("rows_in"),
            F.col(f"_{i + 1}").alias("rows_out"),
            (F.col(f"_{i}") - F.col(f"_{i + 1}")).alias("rows_dropped"),
        )
        for i, (name, _) in enumerate(steps)
    ]
    return counts.select(F.inline(F.array(*rows)))


def join_accounting(left: DataFrame, right: DataFrame, on: Sequence[str], step: str = "join") -> DataFrame:
    """What a left join would do: rows in, matched, unmatched, and rows out after fan-out.

    Only key counts are joined, so a hot key costs one row.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*[as_col(k) for k in on]).agg(F.count(F.lit(1)).alias(name))

    joined = counted(left, "n").join(counted(right, "m"), list(on), "left")
    partners = F.coalesce(F.col("m"), F.lit(0))
    return joined.agg(
        F.lit(step).alias("step"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in"),
        F.coalesce(F.sum(F.when(partners > 0, F.col("n"))), F.lit(0)).alias("rows_matched"),
        F.coalesce(F.sum(F.when(partners == 0, F.col("n"))), F.lit(0)).alias("rows_unmatched"),
        F.coalesce(F.sum(F.col("n") * F.greatest(partners, F.lit(1))), F.lit(0)).alias("rows_out"),
    )


def step_accounting(steps: Sequence[tuple[str, Sequence[DataFrame], DataFrame]]) -> DataFrame:
    """Rows into and out of whole-table steps, given as (name, inputs, output): distinct, union, difference, aggregate.

    Every table is counted by an aggregate of its own, reduced before its
    shuffle. Settle a table that several steps name, or it is computed for each.
    """
    def counted(df: DataFrame, position: int, side: str) -> DataFrame:
        return df.agg(F.lit(position).cast("long").alias("position"), F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"))

    counts = []
    for k, (_, inputs, output) in enumerate(steps, 1):
        counts += [counted(df, k, "in") for df in inputs] + [counted(output, k, "out")]
    name = F.element_at(F.array(*[F.lit(name) for name, _, _ in steps]), F.col("position").cast("int"))
    rows_in, rows_out = (F.sum(F.when(F.col("side") == side, F.col("n"))) for side in ("in", "out"))
    return reduce(DataFrame.unionByName, counts).groupBy("position").agg(
        rows_in.alias("rows_in"), rows_out.alias("rows_out"), (rows_in - rows_out).alias("rows_dropped")
    ).withColumn("step", name).select("position", "step", "rows_in", "rows_out", "rows_dropped")


def by_year(df: DataFrame, measure: str, year: str = "year") -> DataFrame:
    """Rows per year with a measure present, to see gaps between extracts."""
    return df.filter(as_col(measure).isNotNull()).groupBy(year).agg(F.count(F.lit(1)).alias("n"))
