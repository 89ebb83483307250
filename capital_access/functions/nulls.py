"""Rules for missing values, zero denominators and missing-aware aggregates.

Every aggregate takes ``na_rm``. With it, missing inputs are skipped; without
it, one missing input makes the whole result missing.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_col(c: Column | str) -> Column:
    """A Column from a Column or from a column name, which may hold spaces or dots."""
    return F.col(f"`{c}`") if isinstance(c, str) else c


def to_number(c: Column | str) -> Column:
    """Double, or missing for text that is no number and for NaN."""
    return F.nanvl(as_col(c).try_cast("double"), F.lit(None).cast("double"))


def to_integer(c: Column | str) -> Column:
    """Integer of a number or its text, cut at the decimal point; missing for text that is no number."""
    return F.coalesce(as_col(c).try_cast("int"), as_col(c).try_cast("double").try_cast("int"))


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Double quotient; missing when the denominator is zero or missing."""
    return F.try_divide(as_col(numerator).cast("double"), as_col(denominator).cast("double"))


def fill_missing(c: Column | str, value) -> Column:
    return F.coalesce(as_col(c), F.lit(value))


def not_in(c: Column | str, values) -> Column:
    """Not in the list; a missing value is in no list, so its row is kept."""
    return ~F.coalesce(as_col(c).isin(list(values)), F.lit(False))


def is_in(c: Column | str, values) -> Column:
    """In the list; a missing value counts as not in it."""
    return F.coalesce(as_col(c).isin(list(values)), F.lit(False))


def _unless_missing(c: Column, aggregate: Column) -> Column:
    return F.when(F.count(c) == F.count(F.lit(1)), aggregate)


def sum_of(c: Column | str, na_rm: bool = True) -> Column:
    c = as_col(c)
    total = F.coalesce(F.sum(c), F.lit(0))
    return total if na_rm else _unless_missing(c, total)


def cents(c: Column | str) -> Column:
    """Dollars as a whole number of cents."""
    return F.rint(as_col(c) * 100).cast("long")


def money_sum(c: Column | str, na_rm: bool = True) -> Column:
    """Sum of dollars, added up in whole cents: exact in any order of rows, and without decimals."""
    return sum_of(cents(c), na_rm) / 100.0


def mean_of(c: Column | str, na_rm: bool = True) -> Column:
    c = as_col(c)
    return F.avg(c) if na_rm else _unless_missing(c, F.avg(c))


def max_of(c: Column | str, na_rm: bool = True) -> Column:
    c = as_col(c)
    return F.max(c) if na_rm else _unless_missing(c, F.max(c))


def weighted_mean(x: Column | str, w: Column | str, na_rm: bool = True) -> Column:
    """Mean of ``x`` weighted by ``w``, as one pair of partial sums.

    Rows of weight zero never matter. A missing weight makes the result
    missing. A missing ``x`` is skipped with ``na_rm``, else it makes the
    result missing unless its weight is zero.
    """
    x, w = as_col(x).cast("double"), as_col(w).cast("double")
    weighs = w != 0
    if na_rm:
        spoiled = F.count_if(x.isNotNull() & w.isNull())
        weight = F.sum(F.when(x.isNotNull(), w))
    else:
        spoiled = F.count_if(w.isNull() | (x.isNull() & weighs))
        weight = F.sum(w)
    return F.when(spoiled == 0, F.try_divide(F.sum(F.when(weighs, x * w)), weight))
