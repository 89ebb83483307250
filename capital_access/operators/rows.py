"""Row binding, set difference and best rows per group."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from capital_access.functions.nulls import as_col


def bind_rows(*tables: DataFrame) -> DataFrame:
    """Stack by column name, duplicates kept, absent columns missing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def bind_common(tables: Iterable[DataFrame], columns: Sequence[str]) -> DataFrame:
    """Project every table to the same columns, then stack."""
    return reduce(DataFrame.unionByName, [t.select([as_col(c) for c in columns]) for t in tables])


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` that ``right`` lacks; missing equals missing."""
    return left.subtract(right.select(left.columns))


def top_with_ties(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Rows with the largest first measure of their group, then the largest second, and so on.

    All ties stay; a missing measure never wins. The best values are found by
    a map-side reduced aggregate and joined back on key and value, so no group
    is ever gathered in one task as a ranking window would do.
    """
    measures = [as_col(c) for c in by]
    candidates = df.filter(measures[0].isNotNull())
    best = F.max(measures[0] if len(by) == 1 else F.struct(*measures)).alias("_best")
    found = candidates.groupBy(*[as_col(k).alias(f"_key_{k}") for k in keys]).agg(best)
    value = F.col("_best")
    conditions = [as_col(k).eqNullSafe(as_col(f"_key_{k}")) for k in keys]
    conditions += [m == (value if len(by) == 1 else value[c]) for m, c in zip(measures, by)]
    same = reduce(lambda a, b: a & b, conditions)
    return candidates.join(found, same).select([as_col(c) for c in df.columns])
