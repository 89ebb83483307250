"""Merges of the cleaned programs with employment, zones and crosswalks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from capital_access.config import StudyConfig
from capital_access.functions.columns import containing, pick, suffixed
from capital_access.functions.nulls import as_col, fill_missing, mean_of, not_in, sum_of, to_integer
from capital_access.functions.text import first_chars, pad_code
from capital_access.operators.aggregates import many, roll_up_code
from capital_access.operators.joins import (
    left_join,
    left_join_from_dim,
    natural_left_join,
    null_safe_full_join,
    null_safe_join,
)
from capital_access.operators.reshape import column_names, vocabulary, widen
from capital_access.session import settle

# Employment groups as sums of the source's column codes.
EMPLOYMENT_GROUPS = {
    "emp_tot": ("C000",),
    "emp_below40k": ("CE01", "CE02"),
    "emp_tradable": ("CNS01", "CNS02", "CNS05", "CNS09", "CNS10", "CNS12", "CNS13"),
    "emp_white": ("CR01",),
    "emp_black": ("CR02",),
    "emp_other": ("CR03", "CR05", "CR07"),
    "emp_asian": ("CR04",),
    "emp_latino": ("CT02",),
    "emp_female": ("CS02",),
    "emp_male": ("CS01",),
}
EMPLOYMENT_CODES = tuple(code for codes in EMPLOYMENT_GROUPS.values() for code in codes)
# State codes 60 to 95 are territories, left out of the disclosure data.
TERRITORIES = tuple(str(code) for code in range(60, 96))


def employment_by_tract(blocks: DataFrame, year_suffix: str | int) -> DataFrame:
    """Workplace employment of blocks, summed to tracts and grouped, ``_yy`` on each name."""
    coded = blocks.withColumn("w_geocode", pad_code("w_geocode", 15))
    tracts = roll_up_code(coded, "w_geocode", 11, EMPLOYMENT_CODES, "stcotr_code")
    grouped = tracts.select(
        "stcotr_code",
        *[sum((F.col(c) for c in codes[1:]), F.col(codes[0])).alias(g) for g, codes in EMPLOYMENT_GROUPS.items()],
    )
    return suffixed(grouped, EMPLOYMENT_GROUPS, f"_{year_suffix}")


def employment_years(blocks: DataFrame, years: Mapping[int, str | int], year: str = "year") -> DataFrame:
    """Yearly tract tables side by side, ``{year: suffix}``, from one scan of the blocks of all years.

    The blocks are summed by tract and year, and only these sums are dealt by
    tract: what the full join of one table a year gives, without the join.
    """
    coded = blocks.filter(F.col(year).isin(list(years))).withColumn("w_geocode", pad_code("w_geocode", 15))
    sums = coded.groupBy(first_chars("w_geocode", 11).alias("stcotr_code"), year).agg(
        *[sum_of(c, na_rm=False).alias(c) for c in EMPLOYMENT_CODES])
    groups = {g: sum((F.col(c) for c in codes[1:]), F.col(codes[0])) for g, codes in EMPLOYMENT_GROUPS.items()}
    return sums.groupBy("stcotr_code").agg(
        *[F.max(F.when(F.col(year) == y, expr)).alias(f"{g}_{suffix}") for y, suffix in years.items() for g, expr in groups.items()])


def join_employment_years(*years: DataFrame) -> DataFrame:
    """Full join of yearly tract tables; each is unique per tract, so no key is hot."""
    joined = years[0]
    for table in years[1:]:
        joined = joined.join(table, ["stcotr_code"], "full")
    return joined


def disclosure_tracts(disclosure: DataFrame) -> DataFrame:
    """Amounts and counts by full tract code, territories left out, unknown states kept."""
    coded = disclosure.filter(not_in("st_code", TERRITORIES)).withColumns(
        {
            "stcotr_code": F.concat("st_code", "co_code", F.replace("tract_code", F.lit("."), F.lit(""))),
            "year": to_integer("year"),
        }
    )
    return pick(coded, "year", "stcotr_code", containing(coded, "amt_"), containing(coded, "n_"))


def lender_tracts(lender: DataFrame, purposes: Sequence[str] | None = None, label: str = "CDFI") -> DataFrame:
    """Lending by (year, tract), one ``amt_<purpose>`` column each, with total and count of all loans.

    Loans of a purpose that is not listed are in ``amt_unlisted``. Without a list
    the purposes are read from the data, which is a job, and none is unlisted.
    """
    names = list(purposes) if purposes is not None else column_names(vocabulary(lender, "purpose"))
    return widen(
        lender.withColumn("amt_tot", fill_missing("amt_tot", 0)),
        ["year", "stcotr_code"],
        "purpose",
        names,
        "amt_tot",
        rest=None if purposes is None else "unlisted",
        prefix="amt_",
        extra=[F.sum("amt_tot").cast("double").alias(f"amt_tot_{label}"), F.count(F.lit(1)).alias(f"n_tot_{label}")],
    )


def within_study(df: DataFrame, county_metro: DataFrame, study: StudyConfig, tract: str = "stcotr_code") -> DataFrame:
    """Rows of tracts in the study's areas and, where the table has years, since its first year."""
    recent = df.filter(F.col("year") >= study.first_year) if "year" in df.columns else df
    county = first_chars(tract, 5)
    if study.code == "stco_code":
        return recent.filter(county.isin(study.compared))
    counties = county_metro.filter(study.in_area()).select(F.col("stco_code").alias("_county")).distinct()
    return recent.join(counties, county == F.col("_county"), "left_semi")


def tract_master(
    employment: DataFrame,
    disclosure: DataFrame,
    lender: DataFrame,
    zones: DataFrame,
    purposes: Sequence[str] | None = None,
    one_row_per_key: bool = False,
) -> DataFrame:
    """Every tract with employment, its lending of both programs by year, and its zone.

    ``disclosure`` holds rows as ``disclosure_tracts`` makes them, ``lender``
    one row per loan, ``zones`` one row per designated tract. A tract without
    lending keeps one row with a missing year.

    Disclosure rows may repeat a tract and year any number of times; the joins
    are then written so that Spark can split a hot tract, and read the
    disclosure keys a second time. ``one_row_per_key`` says that they do not
    repeat, so no tract can be hot and each input is read once; if they do all
    the same, the result is right, but a hot tract is one task's work.

    Without that promise the joins name their inputs twice: the tables, cut to
    tract level by then, are written to the shared folder once and read from it.
    """
    keys, by_tract = ["year", "stcotr_code"], lender_tracts(lender, purposes)
    if one_row_per_key:
        lending = null_safe_join(disclosure, by_tract, keys, "full")
        merged = left_join(employment, lending, "stcotr_code")
    else:
        lending = settle(null_safe_full_join(settle(disclosure, "disclosure"), settle(by_tract, "lender"), keys), "lending")
        merged = left_join_from_dim(settle(employment, "employment"), lending, "stcotr_code")
    return left_join(merged, zones, "stcotr_code")


def study_master(
    employment: DataFrame,
    disclosure: DataFrame,
    lender: DataFrame,
    zones: DataFrame,
    county_metro: DataFrame,
    study: StudyConfig,
    purposes: Sequence[str] | None = None,
    one_row_per_key: bool = False,
) -> DataFrame:
    """``analysis_master`` of ``tract_master``, with every input cut to the study's years and areas before anything is merged."""
    cut = [within_study(df, county_metro, study) for df in (employment, disclosure, lender, zones)]
    return analysis_master(tract_master(*cut, purposes, one_row_per_key), county_metro, study)


def exporters_by_county(export_credit: DataFrame, exporter_county: DataFrame, county_metro: DataFrame) -> DataFrame:
    """Export credit by county and year with the metro; one bad amount spoils its sum.

    Exporters without a known county form a group of their own.
    """
    county = exporter_county.select(F.col("`Unique.Identifier`").alias("unique_identifier"), "county14")
    coded = left_join(export_credit, county, "unique_identifier").withColumn(
        "stco_code", pad_code("county14", 5)
    )
    amounts = containing(export_credit, "amt_")
    sums = coded.groupBy("stco_code", "year").agg(
        *many(amounts, {"sum": lambda c: sum_of(c, na_rm=False)}, name="{column}")
    )
    return natural_left_join(sums, pick(county_metro, "stco_code", "stco_name", "co_emp", "cbsa_code", "cbsa_name"))


def awards_by_county(award_county: DataFrame, county_metro: DataFrame) -> DataFrame:
    """Awards by county and year: to women, to disadvantaged owners, and in all."""
    sums = award_county.groupBy("stco_code", "year").agg(
        sum_of(F.col("amt_tot") * F.col("gender"), na_rm=False).alias("amt_female"),
        sum_of(F.col("amt_tot") * F.col("disadv"), na_rm=False).alias("amt_minority"),
        sum_of("amt_tot", na_rm=False).alias("amt_tot"),
    )
    return natural_left_join(sums, pick(county_metro, "stco_code", "stco_name", "cbsa_code", "cbsa_name"))


def analysis_master(
    master: DataFrame,
    county_metro: DataFrame,
    study: StudyConfig,
    emp_total: str = "emp_tot_17",
    lender_amount: str = "amt_tot_CDFI",
) -> DataFrame:
    """Tract rows of the study years and areas that have employment, with county and metro."""
    kept = (
        master.filter(F.col("year") >= study.first_year)
        .filter(as_col(emp_total).isNotNull())
        .withColumn("stco_code", first_chars("stcotr_code", 5))
        .withColumn(lender_amount, fill_missing(lender_amount, 0))
    )
    metro = pick(county_metro, "stco_code", "stco_name", "cbsa_code", "cbsa_name")
    return left_join(kept, metro, "stco_code").filter(study.in_area())


def program_average(
    merged: DataFrame, study: StudyConfig, suffix: str, known_county: bool = False
) -> DataFrame:
    """Mean of each amount per study area since the first year; missing if any input is."""
    rows = merged.filter(F.col("year") >= study.first_year).filter(study.in_area())
    if known_county:
        rows = rows.filter(F.col("stco_code").isNotNull())
    amounts = containing(merged, "amt_")
    means = rows.groupBy(*study.keys).agg(
        *many(amounts, {"mean": lambda c: mean_of(c, na_rm=False)}, name="{column}")
    )
    return suffixed(means, amounts, suffix)
