"""One cleaner per program: raw extract in, standard columns out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from capital_access.functions.columns import containing, map_columns, pick, select_renamed
from capital_access.functions.dates import month_date_year, serial_year
from capital_access.functions.nulls import is_in, mean_of, sum_of, to_integer, to_number
from capital_access.functions.text import first_chars, pad_code
from capital_access.operators.rows import bind_common
from capital_access.sources.readers import fixed_width

# Record tag and field widths of the disclosure extract.
DISCLOSURE_TAG = "A1-1"
DISCLOSURE_LAYOUT = (
    ("ID", 5),
    ("year", 4),
    ("type", 2),
    ("st_code", 2),
    ("co_code", 3),
    ("cbsa_code", 5),
    ("tract_code", 7),
    ("co_pop_cat", 2),
    ("tract_income_cat", 3),
    ("level", 3),
    ("n_below100k", 10),
    ("amt_below100k", 10),
    ("n_100to250k", 10),
    ("amt_100to250k", 10),
    ("n_250kto1m", 10),
    ("amt_250kto1m", 10),
    ("n_stot", 10),
    ("amt_stot", 10),
)
SIZE_BANDS = ("below100k", "100to250k", "250kto1m")
# Level codes. Blank marks detail rows; the others are subtotals of them.
DISCLOSURE_LEVELS = {"detail": "   ", "income": "100", "county": "200", "metro": "210"}
# Columns shared by both guaranteed-loan extracts, as standard name = raw name.
GUARANTEED_COLUMNS = {
    "year": "ApprovalFiscalYear",
    "Program": "Program",
    "amt_tot": "GrossApproval",
    "st_name": "BorrState",
    "st_name2": "ProjectState",
    "ct_name": "ProjectCounty",
    "city_name": "BorrCity",
    "street_name": "BorrStreet",
    "zip_code": "BorrZip",
    "naics6_code": "NaicsCode",
}


def parse_disclosure(lines: DataFrame) -> DataFrame:
    """Disclosure records out of raw lines: tag repaired, fields cut, counts and totals added.

    The tag is followed by a blank, an ``a`` or nothing, depending on the year.
    A total is missing when any of its three bands is.
    """
    tagged = lines.filter(F.col("value").startswith(DISCLOSURE_TAG)).withColumn(
        "value", F.regexp_replace("value", rf"^{DISCLOSURE_TAG} ?a?", f"{DISCLOSURE_TAG} ")
    )
    fields = fixed_width(tagged, DISCLOSURE_LAYOUT)
    measures = [c for c, _ in DISCLOSURE_LAYOUT if c.startswith(("n_", "amt_"))]
    fields = map_columns(fields, measures, to_number)
    total = {f"{kind}_tot": sum((F.col(f"{kind}_{b}") for b in SIZE_BANDS[1:]), F.col(f"{kind}_{SIZE_BANDS[0]}"))
             for kind in ("n", "amt")}
    return fields.withColumns({**total, "stco_code": F.concat("st_code", "co_code")})


def keep_level(df: DataFrame, *levels: str) -> DataFrame:
    """Rows of the named aggregation levels of a table that mixes detail and subtotals."""
    return df.filter(F.col("level").isin([DISCLOSURE_LEVELS[name] for name in levels]))


def clean_disclosure(records: DataFrame, level: str = "detail") -> DataFrame:
    """Detail rows, amounts in dollars instead of thousands."""
    scaled = map_columns(records, containing(records, "amt_"), lambda c: c * 1000)
    kept = pick(
        scaled, "year", "level",
        containing(scaled, "code"), containing(scaled, "amt_"), containing(scaled, "n_"),
    )
    return keep_level(kept, level).withColumn("year", to_integer("year"))


def clean_community_lender(raw: DataFrame) -> DataFrame:
    """Tract and county code, closing year, owner's gender and race, amount."""
    tract = F.when(F.col("projectfipscode_2010") == "NONE", F.col("projectfipscode_2000")).otherwise(
        F.col("projectfipscode_2010")
    )
    flag = F.col("womenownedorcontrolled")
    woman = (
        F.when(is_in("gender", ["FEMALE", "BOTH"]) | (flag == "YES"), True)
        .when((F.col("gender") == "MALE") | (flag == "NO"), False)
    )
    hispanic, race = F.col("hispanicorigin"), F.col("race")
    recoded = (
        F.when((race == "WHITE") & (hispanic == "NO"), "white")
        .when((race == "BLACK") & (hispanic == "NO"), "black")
        .when((race == "ASIAN") & (hispanic == "NO"), "asian")
        .when(race.isin("ALASKAN", "PACIFIC", "HAWAIIAN") & (hispanic == "NO"), "other")
        .when(race.isin("", "OTHER") & (hispanic == "YES"), "latino")
        .otherwise("NA")
    )
    coded = raw.withColumn("stcotr_code", pad_code(tract, 11)).withColumns(
        {
            "stco_code": first_chars("stcotr_code", 5),
            "year": month_date_year("dateclosed"),
            "is_woman": woman,
            "race": recoded,
            "amt_tot": to_number("originalamount"),
        }
    )
    return pick(
        coded, "year", containing(coded, "code"), containing(coded, "id"),
        "purpose", "amt_tot", "is_woman", "race",
    )


def clean_export_credit(
    raw: DataFrame, program: str = "Working Capital", decision: str = "Approved"
) -> DataFrame:
    """Approved working-capital rows with their four amounts as numbers."""
    kept = raw.filter(F.col("program") == program).filter(F.col("decision") == decision)
    typed = kept.withColumns(
        {
            "amt_tot": to_number("approved_declined_amount"),
            "amt_small": to_number("small_business_authorized_amount"),
            "amt_woman": to_number("woman_owned_authorized_amount"),
            "amt_minority": to_number("minority_owned_authorized_amount"),
            "year": to_integer("fiscal_year"),
        }
    )
    product = "primary_export_product_naics_sic_code"
    others = [c for c in containing(typed, "primary") if c != product]
    amounts = ["amt_tot", "amt_small", "amt_woman", "amt_minority"]
    return pick(
        typed.withColumnRenamed(product, "naics4_code"),
        "year", "unique_identifier", "naics4_code", others, amounts,
    )


def clean_guaranteed(*extracts: DataFrame) -> DataFrame:
    """The loan extracts on their common columns, stacked and renamed."""
    common = bind_common(extracts, list(GUARANTEED_COLUMNS.values()))
    return select_renamed(common, **GUARANTEED_COLUMNS).withColumn("year", to_integer("year"))


def clean_awards(raw: DataFrame) -> DataFrame:
    """Research awards with the year from a day serial or from text."""
    return raw.withColumn("year", serial_year("Award Year"))


def clean_award_county(raw: DataFrame) -> DataFrame:
    return raw.withColumnsRenamed({"stco_fips": "stco_code", "amt": "amt_tot"})


def yearly_totals(
    df: DataFrame, measure: str = "amt_tot", by: Sequence[str] = ("year",), na_rm: bool = True
) -> DataFrame:
    """Sum and mean per year and further keys, newest year first, missing year last."""
    return (
        df.groupBy(*by)
        .agg(sum_of(measure, na_rm).alias("amt"), mean_of(measure, na_rm).alias("mean"))
        .orderBy(F.col("year").desc_nulls_last())
    )
