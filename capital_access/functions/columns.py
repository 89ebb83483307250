"""Choosing and renaming columns by pattern.

Patterns are resolved against ``df.columns`` on the driver while the plan is
being written; no data is read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from capital_access.functions.nulls import as_col


def containing(df: DataFrame, *texts: str) -> list[str]:
    """Columns whose name contains any of the texts, in any case, in table order."""
    wanted = [t.lower() for t in texts]
    return [c for c in df.columns if any(t in c.lower() for t in wanted)]


def matching(df: DataFrame, pattern: str) -> list[str]:
    """Columns whose name matches a regular expression anywhere, in any case."""
    found = re.compile(pattern, re.IGNORECASE)
    return [c for c in df.columns if found.search(c)]


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def between_columns(df: DataFrame, first: str, last: str) -> list[str]:
    """Columns from ``first`` to ``last`` by position, both included."""
    at = df.columns.index
    return df.columns[at(first) : at(last) + 1]


def without(columns: Iterable[str], *dropped: str) -> list[str]:
    return [c for c in columns if c not in dropped]


def pick(df: DataFrame, *groups: str | Sequence[str], rest: bool = False) -> DataFrame:
    """Select column groups in the given order, each column once; ``rest`` adds the others."""
    names: list[str] = []
    for group in groups:
        names += [group] if isinstance(group, str) else list(group)
    if rest:
        names += df.columns
    return df.select([as_col(c) for c in dict.fromkeys(names)])


def select_renamed(df: DataFrame, **new_from_old: str) -> DataFrame:
    """Select ``new=old`` pairs."""
    return df.select([as_col(old).alias(new) for new, old in new_from_old.items()])


def suffixed(df: DataFrame, columns: Iterable[str], suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in columns})


def map_columns(df: DataFrame, columns: Iterable[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Apply one Column function to many columns in a single projection."""
    return df.withColumns({c: fn(as_col(c)) for c in columns})


def row_sum(columns: Sequence[str]) -> Column:
    """Sum across columns of one row, missing counted as zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(as_col(c), F.lit(0)) for c in columns])
