"""Place and county names to county and metro codes."""

from __future__ import annotations

from hashlib import sha256
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from capital_access.functions.nulls import as_col, fill_missing
from capital_access.functions.text import county_label, place_label, trim_ws
from capital_access.operators.joins import left_join, resolve_and_join_back, unmatched
from capital_access.operators.rows import set_difference, top_with_ties
from capital_access.session import settle

PLACE_KEYS = ["city_name", "region_name"]


class PlaceMatch(NamedTuple):
    """Places with their county, and places for which none was found."""

    matched: DataFrame
    unmatched: DataFrame


def place_keys(df: DataFrame) -> DataFrame:
    """Distinct places with the label and state name used for matching."""
    return df.select(
        *PLACE_KEYS,
        place_label("city_name").alias("pl_label"),
        trim_ws("region_name").alias("st_name"),
    ).distinct()


def match_places(places: DataFrame, place_county: DataFrame, on_ties: str = "all") -> PlaceMatch:
    """Give each place the county that holds most of it.

    Counties compete by ``afact1`` and then ``afact2``, a missing factor
    counting as 1. Exact ties keep every county with ``on_ties="all"``, which
    repeats the place; ``"min_code"`` keeps the lowest county code.
    """
    if on_ties not in ("all", "min_code"):
        raise ValueError("on_ties is 'all' or 'min_code'")
    factors = place_county.select("pl_label", "st_name", "stco_code", "afact1", "afact2")
    candidates = (
        places.join(factors, ["pl_label", "st_name"])
        .filter(F.col("stco_code").isNotNull())
        .withColumns({c: fill_missing(c, 1.0) for c in ("afact1", "afact2")})
    )
    best = top_with_ties(candidates, ["pl_label", "st_name"], ["afact1", "afact2"])
    columns = [*PLACE_KEYS, "pl_label", "st_name"]
    if on_ties == "min_code":
        matched = best.groupBy(*columns).agg(F.min("stco_code").alias("stco_code"))
    else:
        matched = best.select(*columns, "stco_code")
    return PlaceMatch(matched, set_difference(places, matched.drop("stco_code")))


def attach_metro(matched: DataFrame, county_metro: DataFrame) -> DataFrame:
    """Metro of each matched place; places in no metro stay, with a missing metro."""
    metro = county_metro.select("stco_code", "cbsa_code", "cbsa_name", "cbsa_pop")
    return (
        left_join(matched, metro, "stco_code")
        .select(*PLACE_KEYS, "stco_code", "cbsa_code", "cbsa_name", "cbsa_pop")
        .distinct()
    )


def locate_by_place(
    facts: DataFrame, place_county: DataFrame, county_metro: DataFrame, on_ties: str = "all"
) -> DataFrame:
    """Add county and metro to facts that hold ``city_name`` and ``region_name``.

    Each distinct place is resolved once; places are only joined back by the
    two names as they are written in the facts.
    """

    def resolve(names: DataFrame) -> DataFrame:
        return attach_metro(match_places(place_keys(names), place_county, on_ties).matched, county_metro)

    return resolve_and_join_back(facts, PLACE_KEYS, resolve)


def content_version(*tables: DataFrame) -> str:
    """A name for what tables hold: the same whatever the order of rows, another if any value, row or column changes."""
    parts = []
    for df in tables:
        columns = [as_col(c) for c in df.columns]
        row = F.xxhash64(*columns, *[c.isNull() for c in columns])  # the hash alone passes over missing values
        parts += [",".join(df.columns), *df.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(20,0)")), F.sum(F.xxhash64(row).cast("decimal(20,0)"))).first()]
    return sha256("|".join(map(str, parts)).encode()).hexdigest()[:16]


def stored_places(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The places of a dictionary, each answer once; none where nothing has been stored."""
    try:
        return spark.read.schema(schema).parquet(folder).distinct()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def locate_with_dictionary(
    facts: DataFrame, place_county: DataFrame, county_metro: DataFrame, root: str, on_ties: str = "all"
) -> DataFrame:
    """:func:`locate_by_place` with a dictionary of resolved places, kept below ``root`` from run to run.

    Only places that the dictionary lacks are resolved, and appended; those that
    match no county are kept too, so they are not tried again. A dictionary
    belongs to what the crosswalks hold and to the rule for ties: with another
    crosswalk all places are resolved anew, in a folder of its own, and the
    former folders stay until their owner removes them. ``root`` must be on
    shared storage.

    An append becomes visible when its job ends, so a failed run leaves the
    dictionary as it was. Runs side by side may both append a place; their
    answers are equal and are read once. Facts with a missing name match nothing
    and are not stored. The facts are named twice: settle them if they are
    computed. Runs a job for the crosswalks' version, one for the new places,
    and one for the append if there are any.
    """
    spark = facts.sparkSession
    factors = place_county.select("pl_label", "st_name", "stco_code", "afact1", "afact2")
    metro = county_metro.select("stco_code", "cbsa_code", "cbsa_name", "cbsa_pop")
    folder = f"{root.rstrip('/')}/{on_ties}-{content_version(factors, metro)}"

    def resolved(names: DataFrame) -> DataFrame:
        found = attach_metro(match_places(place_keys(names), factors, on_ties).matched, metro)
        return left_join(names, found, PLACE_KEYS)

    names = facts.select(*PLACE_KEYS).where(" AND ".join(f"{k} IS NOT NULL" for k in PLACE_KEYS)).distinct()
    schema = resolved(names).schema
    new = settle(unmatched(names, stored_places(spark, folder, schema), PLACE_KEYS), "new_places")
    if not new.isEmpty():
        resolved(new).write.mode("append").parquet(folder)
    return left_join(facts, stored_places(spark, folder, schema), PLACE_KEYS)


def county_names(counties: DataFrame) -> DataFrame:
    """County codes by comparable name, from ``stco_code`` and ``stco_name`` ("COUNTY STATE")."""
    return (
        counties.select("stco_code", "stco_name").distinct()
        .withColumn("county_label", county_label("stco_name"))
    )


def locate_by_county_name(
    facts: DataFrame, counties: DataFrame, county: str, state: str, on_ties: str = "all"
) -> DataFrame:
    """Add ``stco_code`` and ``stco_name`` to facts by county name and state abbreviation.

    Both sides go through the same spelling rules. Two counties with one
    comparable name repeat the fact with ``on_ties="all"``.
    """
    names = county_names(counties)
    if on_ties == "min_code":
        names = names.groupBy("county_label").agg(
            F.min("stco_code").alias("stco_code"), F.min_by("stco_name", "stco_code").alias("stco_name")
        )

    def resolve(keys: DataFrame) -> DataFrame:
        labelled = keys.withColumn("county_label", county_label(county, state))
        return left_join(labelled, names, "county_label").drop("county_label")

    return resolve_and_join_back(facts, [county, state], resolve)
