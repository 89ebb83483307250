"""Joins between facts and dimensions.

No side is hinted as broadcast: Spark broadcasts a side itself when its size is
below ``spark.sql.autoBroadcastJoinThreshold``, measured again at run time by
adaptive execution, and sorts and merges beyond that. Adaptive execution can
split a hot key on the preserved side of an outer join and on both sides of an
inner join, but not on the other side of an outer join; ``left_join_from_dim``
and ``full_join`` are written so that the side that may be hot can be split.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from capital_access.functions.nulls import as_col


def _listed(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def left_join(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Keep every row of ``left``; missing keys match nothing."""
    return left.join(right, _listed(on), "left")


def shared_names(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on every column name the two tables share."""
    shared = shared_names(left, right)
    if not shared:
        raise ValueError("the tables share no column name")
    return left_join(left, right, shared)


def join_with_suffixes(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Join that renames colliding non-key columns instead of keeping both under one name."""
    keys = _listed(on)
    clash = [c for c in shared_names(left, right) if c not in keys]
    left = left.withColumnsRenamed({c: f"{c}{suffixes[0]}" for c in clash})
    right = right.withColumnsRenamed({c: f"{c}{suffixes[1]}" for c in clash})
    return left.join(right, keys, how)


def join_renamed(
    left: DataFrame, right: DataFrame, pairs: dict[str, str], how: str = "left"
) -> DataFrame:
    """Join on differently named keys, given as ``{left name: right name}``."""
    return left.join(right.withColumnsRenamed({r: l for l, r in pairs.items()}), list(pairs), how)


def null_safe_join(
    left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "left"
) -> DataFrame:
    """Join in which a missing key matches a missing key."""
    keys = _listed(on)
    tagged = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = reduce(
        lambda a, b: a & b, [as_col(k).eqNullSafe(as_col(f"_right_{k}")) for k in keys]
    )
    joined = left.join(tagged, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    kept = [F.coalesce(as_col(k), as_col(f"_right_{k}")).alias(k) for k in keys]
    others = [as_col(c) for c in left.columns if c not in keys]
    others += [as_col(c) for c in right.columns if c not in keys]
    return joined.select(kept + others)


def unmatched(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key is missing or has no partner in ``right``."""
    return left.join(right.select(_listed(on)), _listed(on), "left_anti")


def keep_matching(left: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return left.join(keys.select(_listed(on)), _listed(on), "left_semi")


def left_join_from_dim(dim: DataFrame, facts: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """``dim`` left-joined with ``facts``, for a small ``dim`` and large, perhaps hot, facts.

    Written as the inner join plus the dimension rows without a fact. The inner
    join lets Spark broadcast the dimension (the facts are then not shuffled)
    or split hot fact keys; the rest needs the distinct fact keys only, which
    are reduced before their shuffle. Both tables are named twice: settle them
    if they are computed.
    """
    keys = _listed(on)
    matched = dim.join(facts, keys)
    lonely = unmatched(dim, facts.select(keys).distinct(), keys)
    return matched.unionByName(lonely, allowMissingColumns=True)


def full_join(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Full outer join for a ``left`` that may have hot keys and a ``right`` unique per key.

    The left join keeps the hot side splittable; rows only found on the right
    are added through the distinct left keys. Both tables are named twice:
    settle them if they are computed.
    """
    keys = _listed(on)
    matched = left_join(left, right, keys)
    lonely = unmatched(right, left.select(keys).distinct(), keys)
    return matched.unionByName(lonely, allowMissingColumns=True)


def full_join_many(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Full outer join whose keys may repeat, and be hot, on both sides.

    Matches are an inner join, of which Spark can split a hot key on either
    side, whichever is larger; no promise about either side is needed. The rows
    without a partner, missing keys among them, come from an anti-join with the
    distinct keys of the other side, which are reduced before their shuffle.
    Both tables are named three times: settle them if they are computed.
    """
    keys = _listed(on)
    alone = [unmatched(a, b.select(keys).distinct(), keys) for a, b in ((left, right), (right, left))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), alone, left.join(right, keys))


def null_safe_full_join(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """``full_join`` in which a missing key matches a missing key."""
    keys = _listed(on)
    matched = null_safe_join(left, right, keys)
    lonely = null_safe_join(right, left.select(keys).distinct(), keys, "left_anti")
    return matched.unionByName(lonely, allowMissingColumns=True)


def star_join(base: DataFrame, summaries: Iterable[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Chain of left joins of per-group summaries onto ``base``."""
    return reduce(lambda df, step: left_join(df, *step), summaries, base)


def resolve_and_join_back(facts: DataFrame, keys: Sequence[str], resolve) -> DataFrame:
    """Resolve each distinct key once, then attach the answers to every fact.

    ``resolve`` maps the table of distinct keys to a table with those keys and
    the resolved columns. The distinct is reduced before its shuffle, so a key
    that fills a third of the facts costs as much as any other.
    """
    dictionary = resolve(facts.select(*[as_col(k) for k in keys]).distinct())
    return left_join(facts, dictionary, keys)


def flag(condition: Column) -> Column:
    """A membership flag that is false, not missing, for missing values."""
    return F.coalesce(condition, F.lit(False))
