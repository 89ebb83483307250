"""Yearly panel of all programs at several overlapping geographies, and growth."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from capital_access.functions.nulls import as_col, ratio
from capital_access.functions.text import name_part
from capital_access.operators.joins import flag
from capital_access.operators.reshape import lengthen, widen
from capital_access.operators.rows import bind_rows

Levels = Mapping[str, Column]
# Programs known by tract, and the ending of their amount and count columns.
TRACT_PROGRAMS = {"FDIC": "tot", "FDICsmall": "stot", "CDFI": "tot_CDFI"}


def sums_by_level(
    df: DataFrame, levels: Levels, by: Sequence[str], measures: Mapping[str, str | Column]
) -> DataFrame:
    """Sums of several overlapping row sets in one scan.

    ``levels`` maps a level to the predicate of its rows. Rows are first summed
    per combination of levels, and only these few sums are repeated per level,
    instead of scanning or exploding the facts once per level. Gives for each
    measure ``name`` its sum, ``name_n`` the values present, and ``rows``.
    """
    member = F.array_compact(F.array(*[F.when(p, F.lit(name)) for name, p in levels.items()]))
    in_any = df.withColumn("_levels", member).filter(F.size("_levels") > 0)
    partial = in_any.groupBy("_levels", *by).agg(
        *[F.sum(as_col(c)).alias(m) for m, c in measures.items()],
        *[F.count(as_col(c)).alias(f"{m}_n") for m, c in measures.items()],
        F.count(F.lit(1)).alias("rows"),
    )
    names = [n for m in measures for n in (m, f"{m}_n")] + ["rows"]
    return (
        partial.select(F.explode("_levels").alias("geo"), *by, *names)
        .groupBy("geo", *by)
        .agg(*[F.sum(n).alias(n) for n in names])
    )


def membership(places: DataFrame, key: str, levels: Levels) -> DataFrame:
    """(key, levels): the levels each place lies in, by predicates; places in none are left out."""
    found = F.array_compact(F.array(*[F.when(p, F.lit(name)) for name, p in levels.items()]))
    return places.select(as_col(key), found.alias("levels")).filter(F.size("levels") > 0)


def membership_of_pairs(pairs: DataFrame, key: str, level: str) -> DataFrame:
    """The same from rows (place, level), for any number of levels; repeated and missing ones count once and not at all."""
    known = pairs.filter(as_col(key).isNotNull() & as_col(level).isNotNull())
    return known.groupBy(as_col(key)).agg(F.array_sort(F.collect_set(as_col(level))).alias("levels"))


def _long(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Columns such as ``total_X`` and ``mean_X`` as rows (measure, type, value)."""
    long = lengthen(df.select(*ids, *values), values)
    return long.select(
        *ids, name_part("name", 0).alias("measure"), name_part("name", 1).alias("type"), "value"
    )


def award_panel(awards: DataFrame, levels: Levels, amount: str = "Award Amount") -> DataFrame:
    """Total and mean award by year; missing amounts are skipped."""
    sums = sums_by_level(awards, levels, ["year"], {"v": amount})
    out = sums.withColumns({"total_SBIR": F.coalesce("v", F.lit(0)), "mean_SBIR": ratio("v", "v_n")})
    return _long(out, ["geo", "year"], ["total_SBIR", "mean_SBIR"])


def guaranteed_panel(loans: DataFrame, levels: Levels, amount: str = "GrossApproval") -> DataFrame:
    """Total and mean loan by program and year; one missing amount spoils both."""
    sums = sums_by_level(loans, levels, ["Program", "year"], {"v": amount})
    whole = F.col("v_n") == F.col("rows")
    out = sums.withColumns(
        {"total_SBA": F.when(whole, F.col("v")), "mean_SBA": F.when(whole, ratio("v", "v_n"))}
    )
    return _long(out, ["geo", "Program", "year"], ["total_SBA", "mean_SBA"])


def tract_panel(tracts: DataFrame, levels: Levels) -> DataFrame:
    """Total lending and amount per loan by year for the tract programs."""
    programs = TRACT_PROGRAMS
    measures = {f"{kind}_{p}": f"{kind}_{c}" for p, c in programs.items() for kind in ("amt", "n")}
    sums = sums_by_level(tracts, levels, ["year"], measures)
    added = {f"total_{p}": F.coalesce(F.col(f"amt_{p}"), F.lit(0)) for p in programs}
    added |= {f"mean_{p}": ratio(f"total_{p}", f"n_{p}") for p in programs}
    out = sums.withColumns({k: v for k, v in added.items() if k.startswith("total")})
    out = out.withColumns({k: v for k, v in added.items() if k.startswith("mean")})
    return _long(out, ["geo", "year"], list(added))


def geo_levels(city: Column, metro: str, county: str) -> dict[str, Column]:
    """Predicates of the metro, the county and the city of a target area."""
    return {
        "metro": flag(F.col("cbsa_code") == metro),
        "county": flag(F.col("stco_code") == county),
        "city": flag(city),
    }


def program_panel(
    awards: tuple[DataFrame, Levels],
    guaranteed: tuple[DataFrame, Levels],
    tracts: tuple[DataFrame, Levels],
    years: tuple[int, int],
) -> DataFrame:
    """All programs by geography and year: (geo, Program, year, measure, type, value).

    Each program comes with the predicates of its levels, as the programs know
    a city by different columns. Every program is scanned once.
    """
    def within(df: DataFrame) -> DataFrame:
        return df.filter(F.col("year").between(*years))

    stacked = bind_rows(
        guaranteed_panel(within(guaranteed[0]), guaranteed[1]),
        award_panel(within(awards[0]), awards[1]),
        tract_panel(within(tracts[0]), tracts[1]),
    )
    labelled = F.when(F.col("Program").isNull(), F.col("type")).otherwise(F.concat_ws(" ", "type", "Program"))
    return stacked.withColumn("Program", labelled)


def member_panel(
    loans: DataFrame, tracts: DataFrame, members: DataFrame, years: tuple[int, int], key: str = "stcotr_code"
) -> DataFrame:
    """All programs by geography and year from one aggregate: (geo, Program, year, measure, type, value).

    ``loans`` has a row per award or loan: key, year, type (``SBIR`` for awards,
    ``SBA``), Program (missing for awards) and amount. ``tracts`` has the
    disclosed and community lending of places by year, in any number of rows for
    each. ``members`` says in which levels a place lies. Rows of all programs
    are stacked under their type and summed by place before they are
    shuffled; only these sums meet the levels, which may be thousands, and are
    summed again per combination of levels before they are repeated per level.

    A missing award is skipped, a missing loan spoils its sum, and missing
    lending is zero, as in ``program_panel``.
    """
    lending = [
        F.struct(F.lit(name).alias("type"), F.col(f"amt_{c}").cast("double").alias("v"), F.col(f"n_{c}").cast("long").alias("n"))
        for name, c in TRACT_PROGRAMS.items()
    ]
    stacked = bind_rows(
        loans.select(as_col(key), "year", "type", "Program", F.col("amount").cast("double").alias("v")),
        tracts.select(as_col(key), "year", F.inline(F.array(*lending))),
    ).filter(F.col("year").between(*years))
    by, sums = ["type", "Program", "year"], ["v", "n", "present", "rows"]

    def again(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*map(as_col, keys)).agg(*[F.sum(c).alias(c) for c in sums])

    placed = stacked.groupBy(as_col(key), *by).agg(
        F.sum("v").alias("v"), F.sum("n").alias("n"), F.count("v").alias("present"), F.count(F.lit(1)).alias("rows"))
    combined = again(placed.join(members, key), "levels", *by)
    whole = again(combined.select(F.explode("levels").alias("geo"), *by, *sums), "geo", *by)
    kept = (F.col("type") != "SBA") | (F.col("present") == F.col("rows"))
    counted = F.when(F.col("type").isin(list(TRACT_PROGRAMS)), F.col("n")).otherwise(F.col("present"))
    total = F.when(kept, F.coalesce("v", F.lit(0.0)))
    cells = F.array(*[
        F.struct(F.lit(name).alias("measure"), value.alias("value")) for name, value in (("total", total), ("mean", ratio(total, counted)))])
    label = F.concat_ws(" ", "type", "Program")
    return whole.select("geo", label.alias("Program"), "year", "type", F.inline(cells)).select(
        "geo", "Program", "year", "measure", "type", "value")


def growth_rate(
    panel: DataFrame,
    first: int,
    last: int,
    ids: Sequence[str] = ("geo", "Program", "measure", "type"),
    years: Sequence[int] | None = None,
    periods: int | None = None,
) -> DataFrame:
    """Years side by side and the compound annual growth from ``first`` to ``last``."""
    shown = list(years) if years is not None else list(range(first, last + 1))
    wide = widen(panel, list(ids), "year", [str(y) for y in shown], "value", rest=None)
    span = (last - first) if periods is None else periods
    rate = F.pow(ratio(str(last), str(first)), F.lit(1.0 / span)) - 1
    return wide.withColumn(f"CAGR_{first % 100:02d}_{last % 100:02d}", rate)
