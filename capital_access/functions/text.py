"""Text and code helpers."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

from capital_access.functions.nulls import as_col

# Spellings that differ between the loan files and the county list,
# as (regular expression, replacement), applied in this order to upper-case
# "COUNTY STATE" names of both sides.
COUNTY_NAME_RULES = (
    (r"SAINT", "ST."),
    (r" BOROUGH ", " "),
    (r" PARISH ", " "),
    (r"^BEDFORD VA \(R\)$", "BEDFORD VA"),
    (r"^.*JOSEPH IN.*$", "ST. JOSEPH IN"),
)

# The same for lower-case place names.
PLACE_NAME_RULES = ((r"saint", "st."),)


def pad_code(c: Column | str, width: int) -> Column:
    """Zero-pad on the left; a longer code is left alone (``lpad`` alone would cut it)."""
    c = as_col(c).cast("string")
    return F.lpad(c, F.greatest(F.length(c), F.lit(width)), F.lit("0"))


def trim_ws(c: Column | str) -> Column:
    """Strip spaces, tabs and line ends on both sides (``trim`` strips spaces only)."""
    return F.regexp_replace(as_col(c), r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def first_chars(c: Column | str, n: int) -> Column:
    return F.substring(as_col(c), 1, n)


def last_chars(c: Column | str, n: int) -> Column:
    return F.right(as_col(c), F.lit(n))


def replace_all(c: Column | str, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(as_col(c), pattern, replacement)


def replace_first(c: Column | str, pattern: str, replacement: str) -> Column:
    """Replace the leftmost match only; ``pattern`` must hold no capturing group."""
    return F.regexp_replace(as_col(c), rf"(?s)^(.*?)(?:{pattern})", rf"$1{replacement}")


def apply_rules(c: Column | str, rules: Iterable[tuple[str, str]]) -> Column:
    """Fold a table of (pattern, replacement) rules over a text column."""
    return reduce(lambda text, rule: F.regexp_replace(text, *rule), rules, as_col(c))


def place_label(c: Column | str) -> Column:
    return apply_rules(F.lower(trim_ws(c)), PLACE_NAME_RULES)


def county_label(county: Column | str, state: Column | str | None = None) -> Column:
    """Comparable "COUNTY STATE" name; without ``state`` the input already holds both."""
    name = trim_ws(F.upper(as_col(county)))
    if state is not None:
        name = F.concat(name, F.lit(" "), as_col(state))
    return apply_rules(name, COUNTY_NAME_RULES)


def name_part(c: Column | str, position: int) -> Column:
    """Part of a name split at runs of other characters than letters and digits."""
    return F.get(F.split(as_col(c), r"[^\p{Alnum}]+"), F.lit(position))
