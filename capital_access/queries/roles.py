"""The given tables in the roles of the program extracts.

customer is the tract, nation the county, region the metro; orders are loan
records, lineitem gives size bands and employment, events a second lender.
County codes are 3001 * nation key, so states run from 00 to 72 and the last
five nations are territories. Each function has its SQL twin as a CTE below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from capital_access.config import StudyConfig
from capital_access.functions.nulls import money_sum
from capital_access.operators.joins import left_join

STUDY = StudyConfig(
    area="stco",
    peers=tuple(f"{3001 * k:05d}" for k in (1, 2, 3, 5, 8, 11, 13, 17, 19)),
    targets=(f"{3001 * 7:05d}",),
    first_year=1997,
    n_years=5,
    panel_years=(1996, 2000),
)
COMPARED_SQL = "(" + ", ".join(f"'{c}'" for c in STUDY.compared) + ")"
PURPOSES = ("click", "error", "purchase", "signup", "view")


# Declared, so that no job is run just to read the footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def pad_expr(expr: str, width: int) -> str:
    """SQL text of ``pad_code``."""
    text = f"CAST({expr} AS STRING)"
    return f"(CASE WHEN length({text}) < {width} THEN lpad({text}, {width}, '0') ELSE {text} END)"


def county_metro(spark, sf) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).selectExpr(
        f"{pad_expr('n_nationkey * 3001', 5)} AS stco_code",
        "n_name AS stco_name",
        f"{pad_expr('r_regionkey', 5)} AS cbsa_code",
        "r_name AS cbsa_name",
        "n_nationkey * 1000 AS co_emp",
        "r_regionkey * 100000 AS cbsa_pop",
    )


TRACT_EXPR = f"{pad_expr('c_nationkey * 3001', 5)} || {pad_expr('c_custkey % 1000000', 6)}"


def tracts(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "c_custkey",
        f"{TRACT_EXPR} AS stcotr_code",
        f"{pad_expr('c_nationkey * 3001', 5)} AS stco_code",
        "c_acctbal",
        "c_mktsegment",
    )


def in_years(column: str, first: int | None, last: int | None = None) -> str:
    """Condition on a timestamp as bounds of the column itself, which reach the scan, as ``year(column)`` does not."""
    bounds = [f"{column} >= TIMESTAMP_NTZ '{first}-01-01'"] if first is not None else []
    bounds += [f"{column} < TIMESTAMP_NTZ '{last + 1}-01-01'"] if last is not None else []
    return " AND ".join(bounds) or "true"


def loans(spark, sf, first: int | None = None, last: int | None = None) -> DataFrame:
    orders = table(spark, sf, "orders").filter(in_years("o_orderdate", first, last)).selectExpr(
        "o_custkey AS c_custkey",
        "o_orderkey AS loan_id",
        "year(o_orderdate) AS year",
        "o_orderpriority AS purpose",
        "o_orderstatus AS decision",
        "o_totalprice AS amt_tot",
    )
    return orders.join(tracts(spark, sf), "c_custkey")


def zones(spark, sf) -> DataFrame:
    flagged = tracts(spark, sf).filter("c_acctbal < 0").selectExpr("stcotr_code", "'zone' AS stco_type")
    return flagged.distinct()


# Employment codes of a lineitem row, by the condition under which its quantity counts.
JOBS = {
    "C000": "true",
    "CE01": "l_returnflag = 'A'", "CE02": "l_returnflag = 'N'",
    "CNS01": "l_linenumber = 1", "CNS02": "l_linenumber = 2", "CNS05": "l_linenumber = 3", "CNS09": "l_linenumber = 4",
    "CNS10": "l_linenumber = 5", "CNS12": "l_linenumber = 6", "CNS13": "l_linenumber = 7",
    "CR01": "l_returnflag = 'A'", "CR02": "l_returnflag = 'N'", "CR04": "l_returnflag = 'R' AND l_linestatus = 'F'",
    "CR03": "l_returnflag = 'R' AND l_linestatus = 'O' AND l_linenumber <= 2",
    "CR05": "l_returnflag = 'R' AND l_linestatus = 'O' AND l_linenumber IN (3, 4)",
    "CR07": "l_returnflag = 'R' AND l_linestatus = 'O' AND l_linenumber > 4",
    "CT02": "l_discount >= 0.05D",
    "CS01": "l_linestatus = 'O'", "CS02": "l_linestatus = 'F'",
}


def blocks(spark, sf, *ship_years: int) -> DataFrame:
    """Employment per block and year; codes have lost their leading zeros."""
    line = table(spark, sf, "lineitem").filter(" OR ".join(f"({in_years('l_shipdate', y, y)})" for y in ship_years))
    orders = table(spark, sf, "orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey AS c_custkey")
    places = tracts(spark, sf).select("c_custkey", "stcotr_code")
    return line.join(orders, "l_orderkey").join(places, "c_custkey").selectExpr(
        f"CAST(CAST(stcotr_code || {pad_expr('l_linenumber', 4)} AS BIGINT) AS STRING) AS w_geocode",
        "year(l_shipdate) AS year",
        *[f"CASE WHEN {c} THEN CAST(l_quantity AS BIGINT) ELSE 0L END AS {name}" for name, c in JOBS.items()],
    )


def disclosure(spark, sf, first: int | None = None, last: int | None = None) -> DataFrame:
    """Counts and amounts by tract, year and size band, as the disclosure extract has them."""
    line = table(spark, sf, "lineitem").selectExpr("l_orderkey AS loan_id", "l_extendedprice AS price")
    keyed = line.join(loans(spark, sf, first, last).select("loan_id", "stcotr_code", "year"), "loan_id")
    bands = {
        "below100k": "price < 25000",
        "100to250k": "price >= 25000 AND price < 50000",
        "250kto1m": "price >= 50000",
        "stot": "price < 10000",
    }
    sums = keyed.groupBy("stcotr_code", "year").agg(
        *[F.expr(f"count_if({c})").alias(f"n_{b}") for b, c in bands.items()],
        *[money_sum(F.expr(f"CASE WHEN {c} THEN price END")).alias(f"amt_{b}") for b, c in bands.items()],
    )
    return sums.selectExpr(
        "year",
        "substring(stcotr_code, 1, 2) AS st_code",
        "substring(stcotr_code, 3, 3) AS co_code",
        "substring(stcotr_code, 6, 4) || '.' || substring(stcotr_code, 10, 2) AS tract_code",
        *[f"{kind}_{b}" for kind in ("n", "amt") for b in bands],
        *[f"{kind}_below100k + {kind}_100to250k + {kind}_250kto1m AS {kind}_tot" for kind in ("n", "amt")],
    )


def lender(spark, sf) -> DataFrame:
    """Loans of a community lender: one per event, in the tract of its user."""
    events = table(spark, sf, "events").selectExpr(
        "user_id AS c_custkey",
        "CAST(event_id % 7 + 1995 AS INT) AS year",
        "event_type AS purpose",
        "value AS amt_tot",
    )
    return events.join(tracts(spark, sf).select("c_custkey", "stcotr_code"), "c_custkey").drop("c_custkey")


def exports(spark, sf) -> DataFrame:
    """Export credit, all text as the extract has it."""
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("unique_identifier"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Working Capital")
        .otherwise("Insurance").alias("program"),
        F.when(F.col("o_orderstatus") == "F", "Approved").otherwise("Declined").alias("decision"),
        F.year("o_orderdate").cast("string").alias("fiscal_year"),
        price.cast("string").alias("approved_declined_amount"),
        F.when(price < 200000, price).otherwise(0.0).cast("string").alias("small_business_authorized_amount"),
        F.when(F.col("o_orderkey") % 2 == 0, price).otherwise(0.0).cast("string").alias("woman_owned_authorized_amount"),
        F.when(F.col("o_orderkey") % 3 == 0, price.cast("string")).when(F.col("o_orderkey") % 1000 == 1, "n/a")
        .otherwise("0").alias("minority_owned_authorized_amount"),
        F.substring("o_orderpriority", 1, 1).alias("primary_export_product_naics_sic_code"),
    )


def exporter_county(spark, sf) -> DataFrame:
    """County of each exporter, unpadded; one segment has none."""
    known = F.col("c_mktsegment") != "HOUSEHOLD"
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("Unique.Identifier"),
        F.when(known, (F.col("c_nationkey") * 3001).cast("string")).alias("county14"),
    )


def award_county(spark, sf) -> DataFrame:
    """Awards with 0/1 owner flags; the first flag is unknown for a few awards."""
    return loans(spark, sf).select(
        "stco_code",
        "year",
        "amt_tot",
        F.when(F.col("loan_id") % 500 == 3, None).when(F.col("decision") == "F", 1).otherwise(0).alias("gender"),
        F.when(F.col("purpose") == "1-URGENT", 1).otherwise(0).alias("disadv"),
    )


def owners(spark, sf) -> DataFrame:
    """Firms by county, owner label and traded or local industry."""
    from capital_access.plans.gaps import ALL_FIRMS_LABEL, DROPPED_LABEL

    labels = spark.createDataFrame(
        [
            ("AUTOMOBILE", [ALL_FIRMS_LABEL, "Female-owned", "White", "Nonminority"]),
            ("BUILDING", [ALL_FIRMS_LABEL, "Male-owned", "White", "Nonminority"]),
            ("FURNITURE", [ALL_FIRMS_LABEL, "Female-owned", "Black or African American", "Minority"]),
            ("HOUSEHOLD", [ALL_FIRMS_LABEL, "Male-owned", "Hispanic", "Minority"]),
            ("MACHINERY", [ALL_FIRMS_LABEL, "Male-owned", "Black or African American", "Minority", DROPPED_LABEL]),
        ],
        "c_mktsegment string, label array<string>",
    )
    traded = F.when(F.col("c_acctbal") >= 2500, "traded").otherwise("local")
    firms = (
        tracts(spark, sf)
        .groupBy("stco_code", "c_mktsegment", traded.alias("is.traded"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # The segment counts are reduced before the labels repeat them.
    counted = (
        firms.join(labels, "c_mktsegment")
        .withColumn("label", F.explode("label"))
        .groupBy("stco_code", "label", "`is.traded`")
        .agg(F.sum("n").cast("double").alias("firmdemp"))
    )
    return left_join(counted, county_metro(spark, sf).select("stco_code", F.col("stco_name").alias("GEO_TTL")), "stco_code").withColumn(
        "firmall", F.col("firmdemp") * 2
    )


def demographics(spark, sf) -> DataFrame:
    return tracts(spark, sf).groupBy("stco_code").agg(
        (F.count_if(F.col("c_custkey") % 2 == 0) / F.count(F.lit(1))).alias("female"),
        (F.count_if(F.col("c_custkey") % 3 == 0) / F.count(F.lit(1))).alias("Black or Hispanic"),
    )


def attainment(spark, sf) -> DataFrame:
    """Education counts by county; the code is an unpadded number."""
    counts = {"033": 2, "036": 3, "042": 4, "054": 5, "032": 6, "035": 7, "041": 8, "053": 9}
    return table(spark, sf, "customer").groupBy((F.col("c_nationkey") * 3001).alias("stco_code")).agg(
        *[F.count_if(F.col("c_custkey") % m == 1).alias(f"S1501_C01_{c}E") for c, m in counts.items()]
    )


# ---- the same in SQL ---------------------------------------------------------


def pad_sql(expr: str, width: int) -> str:
    text = f"CAST({expr} AS VARCHAR)"
    return f"(CASE WHEN length({text}) < {width} THEN lpad({text}, {width}, '0') ELSE {text} END)"


def money_sql(expr: str) -> str:
    return f"CAST({expr} AS DECIMAL(18,2))"


def _nudge(digits: int) -> str:
    """Added before rounding, so that a tie is broken alike whatever the order of a sum."""
    return f"1e-{digits + 5}"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Fractional columns rounded: their sums may be taken in any order."""
    fractions = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(F.col(f"`{c}`") + float(_nudge(digits)), digits) for c in fractions})


def round_sql(expr: str, digits: int = 4) -> str:
    return f"round({expr} + {_nudge(digits)}::DOUBLE, {digits})"


CTE = {
    "county_metro": f"""county_metro AS (
        SELECT {pad_sql('n_nationkey * 3001', 5)} AS stco_code, n_name AS stco_name,
               {pad_sql('r_regionkey', 5)} AS cbsa_code, r_name AS cbsa_name
        FROM nation JOIN region ON n_regionkey = r_regionkey)""",
    "tracts": f"""tracts AS (
        SELECT c_custkey, {pad_sql('c_nationkey * 3001', 5)} || {pad_sql('c_custkey % 1000000', 6)} AS stcotr_code,
               {pad_sql('c_nationkey * 3001', 5)} AS stco_code, c_acctbal, c_mktsegment
        FROM customer)""",
    "loans": f"""loans AS (
        SELECT c_custkey, o_orderkey AS loan_id, CAST(year(o_orderdate) AS INTEGER) AS year,
               o_orderpriority AS purpose, o_orderstatus AS decision,
               {money_sql('o_totalprice')} AS amt_tot, stcotr_code, stco_code
        FROM orders JOIN tracts ON o_custkey = c_custkey)""",
    "zones": """zones AS (
        SELECT DISTINCT stcotr_code, 'zone' AS stco_type FROM tracts WHERE c_acctbal < 0)""",
    "jobs": """jobs AS (
        SELECT stcotr_code, year(l_shipdate) AS ship_year, CAST(l_quantity AS BIGINT) AS q, l_linenumber AS n,
               l_returnflag AS f, l_linestatus AS s, l_discount AS d
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN tracts ON o_custkey = c_custkey)""",
    "disclosure": f"""priced AS (
        SELECT stcotr_code, year, {money_sql('l_extendedprice')} AS price
        FROM lineitem JOIN loans ON l_orderkey = loan_id),
    disclosure AS (
        SELECT stcotr_code, year,
               count(*) FILTER (WHERE price < 25000) AS n_below100k,
               count(*) FILTER (WHERE price >= 25000 AND price < 50000) AS n_100to250k,
               count(*) FILTER (WHERE price >= 50000) AS n_250kto1m,
               count(*) FILTER (WHERE price < 10000) AS n_stot,
               count(*) AS n_tot,
               coalesce(sum(price) FILTER (WHERE price < 25000), 0) AS amt_below100k,
               coalesce(sum(price) FILTER (WHERE price >= 25000 AND price < 50000), 0) AS amt_100to250k,
               coalesce(sum(price) FILTER (WHERE price >= 50000), 0) AS amt_250kto1m,
               coalesce(sum(price) FILTER (WHERE price < 10000), 0) AS amt_stot,
               sum(price) AS amt_tot
        FROM priced GROUP BY ALL)""",
    "lender": f"""lender AS (
        SELECT stcotr_code, CAST(event_id % 7 + 1995 AS INTEGER) AS year, event_type AS purpose,
               {money_sql('value')} AS amt_tot
        FROM events JOIN tracts ON user_id = c_custkey)""",
}


def with_sql(*names: str) -> str:
    """A WITH clause of role tables, in the order given; a query or more CTEs follow it."""
    return "WITH " + ",\n    ".join(CTE[n] for n in names)


def emp_sql(ship_year: int, suffix: str) -> str:
    """CTE ``emp<suffix>``: employment groups by tract of one year."""
    groups = {
        "tot": "true",
        "below40k": "f IN ('A', 'N')",
        "tradable": "n BETWEEN 1 AND 7",
        "white": "f = 'A'",
        "black": "f = 'N'",
        "other": "f = 'R' AND s = 'O'",
        "asian": "f = 'R' AND s = 'F'",
        "latino": "d >= 0.05",
        "female": "s = 'F'",
        "male": "s = 'O'",
    }
    sums = ", ".join(
        f"CAST(sum(CASE WHEN {c} THEN q ELSE 0 END) AS BIGINT) AS emp_{g}_{suffix}" for g, c in groups.items()
    )
    return f"emp{suffix} AS (SELECT stcotr_code, {sums} FROM jobs WHERE ship_year = {ship_year} GROUP BY 1)"
