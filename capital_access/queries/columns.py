"""Projection, filter and scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from capital_access.functions.columns import (
    between_columns,
    containing,
    map_columns,
    matching,
    numeric,
    pick,
    select_renamed,
    suffixed,
    without,
)
from capital_access.functions.dates import month_date_year, serial_year
from capital_access.functions.nulls import fill_missing, is_in, money_sum, not_in, ratio, to_integer
from capital_access.functions.text import (
    COUNTY_NAME_RULES,
    apply_rules,
    first_chars,
    last_chars,
    name_part,
    pad_code,
    place_label,
    replace_all,
    replace_first,
)
from capital_access.operators.joins import left_join
from capital_access.plans.programs import DISCLOSURE_LEVELS, clean_export_credit, keep_level
from capital_access.queries.registry import query
from capital_access.queries.roles import (
    COMPARED_SQL,
    STUDY,
    exports,
    loans,
    money_sql,
    pad_sql,
    table,
    with_sql,
)


@query(
    "select_rename",
    "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer",
)
def q_select_rename(spark, sf):
    return select_renamed(table(spark, sf, "customer"), id="c_custkey", name="c_name", segment="c_mktsegment")


@query(
    "select_by_pattern",
    """
    SELECT p_name, p_brand, p_type, p_retailprice FROM part
    """,
)
def q_select_by_pattern(spark, sf):
    """A range, a text in any case, and a regular expression, less one column."""
    part = table(spark, sf, "part")
    return pick(
        part,
        between_columns(part, "p_name", "p_brand"),
        without(matching(part, r"^p_(type|size)$"), "p_size"),
        containing(part, "PRICE"),
    )


@query(
    "map_columns_scale",
    """
    SELECT o_orderkey, o_totalprice * 1000 AS o_totalprice FROM orders
    """,
)
def q_map_columns_scale(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return map_columns(orders, containing(orders, "price"), lambda c: c * 1000)


@query(
    "derive_sequential",
    """
    WITH a AS (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem),
    b AS (SELECT *, net * (1 + l_tax) AS charge FROM a)
    SELECT l_orderkey, l_partkey, net, charge, charge / nullif(l_quantity, 0) AS unit FROM b
    """,
)
def q_derive_sequential(spark, sf):
    """Columns that use columns derived just before."""
    return (
        table(spark, sf, "lineitem")
        .withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
        .withColumn("charge", F.col("net") * (1 + F.col("l_tax")))
        .withColumn("unit", ratio("charge", "l_quantity"))
        .select("l_orderkey", "l_partkey", "net", "charge", "unit")
    )


@query(
    "suffix_columns",
    """
    SELECT s_suppkey AS s_suppkey_SUP, s_name, s_nationkey AS s_nationkey_SUP, s_acctbal AS s_acctbal_SUP
    FROM supplier
    """,
)
def q_suffix_columns(spark, sf):
    supplier = table(spark, sf, "supplier")
    return suffixed(supplier, numeric(supplier), "_SUP")


@query(
    "reorder_columns",
    """
    SELECT p_partkey, p_brand, p_retailprice, p_name, p_type, p_size FROM part
    """,
)
def q_reorder_columns(spark, sf):
    part = table(spark, sf, "part")
    return pick(part, "p_partkey", containing(part, "brand"), containing(part, "price"), rest=True)


@query(
    "bind_group_summaries",
    """
    SELECT c_nationkey, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance,
           count(*) FILTER (WHERE c_acctbal < 0) AS n_negative, max(c_acctbal) AS best
    FROM customer GROUP BY 1
    """,
)
def q_bind_group_summaries(spark, sf):
    """Two summaries of the same groups side by side, joined on their key."""
    customer = table(spark, sf, "customer")
    sizes = customer.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), money_sum("c_acctbal").alias("balance")
    )
    extremes = customer.groupBy("c_nationkey").agg(
        F.count_if(F.col("c_acctbal") < 0).alias("n_negative"), F.max("c_acctbal").alias("best")
    )
    return left_join(sizes, extremes, "c_nationkey")


@query(
    "compose_key",
    f"""
    SELECT c_custkey, {pad_sql('c_nationkey', 2)} || {pad_sql('c_custkey', 9)} AS code,
           c_mktsegment || ' ' || CAST(c_nationkey AS VARCHAR) AS label,
           nullif(c_mktsegment, 'BUILDING') || '-' || CAST(c_nationkey AS VARCHAR) AS unknown_part
    FROM customer
    """,
)
def q_compose_key(spark, sf):
    """Keys put together from parts; a missing part makes the key missing."""
    nation = F.col("c_nationkey").cast("string")
    known = F.nullif("c_mktsegment", F.lit("BUILDING"))
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.concat(pad_code("c_nationkey", 2), pad_code("c_custkey", 9)).alias("code"),
        F.concat_ws(" ", "c_mktsegment", nation).alias("label"),
        F.concat(known, F.lit("-"), nation).alias("unknown_part"),
    )


@query(
    "separate_name_parts",
    """
    WITH parts AS (SELECT p_partkey, regexp_split_to_array(p_type || '_' || p_name || '.x', '[^A-Za-z0-9]+') AS a FROM part)
    SELECT p_partkey, a[1] AS measure, a[2] AS type, a[9] AS absent FROM parts
    """,
)
def q_separate_name_parts(spark, sf):
    """Parts between other characters than letters and digits; more parts are dropped."""
    name = F.concat("p_type", F.lit("_"), "p_name", F.lit(".x"))
    return table(spark, sf, "part").select(
        "p_partkey",
        name_part(name, 0).alias("measure"),
        name_part(name, 1).alias("type"),
        name_part(name, 8).alias("absent"),
    )


@query(
    "safe_cast",
    """
    SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rank,
           TRY_CAST(substr(o_orderpriority, 3) AS DOUBLE) AS no_number,
           TRY_CAST('  ' || CAST(o_custkey AS VARCHAR) AS DOUBLE) AS padded
    FROM orders
    """,
)
def q_safe_cast(spark, sf):
    """Text that is no number becomes missing instead of failing the job."""
    priority = F.col("o_orderpriority")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        to_integer(first_chars(priority, 1)).alias("rank"),
        F.substring(priority, 3, 100).try_cast("double").alias("no_number"),
        F.concat(F.lit("  "), F.col("o_custkey").cast("string")).try_cast("double").alias("padded"),
    )


# ---- filters -----------------------------------------------------------------


@query(
    "filter_stacked",
    f"""
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_custkey AS VARCHAR) AS unique_identifier,
           substr(o_orderpriority, 1, 1) AS naics4_code, o_totalprice AS amt_tot,
           CASE WHEN {money_sql('o_totalprice')} < 200000 THEN o_totalprice ELSE 0 END AS amt_small,
           CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 0 END AS amt_woman,
           CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice WHEN o_orderkey % 1000 = 1 THEN NULL ELSE 0 END AS amt_minority
    FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F'
    """,
)
def q_filter_stacked(spark, sf):
    """Approved rows of one program out of the text extract, amounts as numbers."""
    return clean_export_credit(exports(spark, sf))


@query(
    "filter_not_in_null_kept",
    """
    SELECT nullif(c_mktsegment, 'BUILDING') AS segment, count(*) AS n FROM customer
    WHERE c_mktsegment NOT IN ('MACHINERY', 'HOUSEHOLD') GROUP BY 1
    """,
)
def q_filter_not_in_null_kept(spark, sf):
    """Rows with a missing value are in no list and stay."""
    segment = F.nullif("c_mktsegment", F.lit("BUILDING"))
    kept = table(spark, sf, "customer").select(segment.alias("segment")).filter(
        not_in("segment", ["MACHINERY", "HOUSEHOLD"])
    )
    return kept.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query(
    "filter_between_years",
    f"""
    SELECT o_orderpriority, count(*) AS n, CAST(sum({money_sql('o_totalprice')}) AS DOUBLE) AS amt
    FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY 1
    """,
)
def q_filter_between_years(spark, sf):
    orders = table(spark, sf, "orders")
    # A range of dates, unlike a range of years, is checked against Parquet statistics.
    inside = (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (
        F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")
    )
    return orders.filter(inside).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), money_sum("o_totalprice").alias("amt")
    )


@query(
    "filter_parameterised",
    with_sql("tracts", "loans")
    + f"""
    SELECT stco_code, count(*) AS n, CAST(sum(amt_tot) AS DOUBLE) AS amt FROM loans
    WHERE stco_code IN {COMPARED_SQL} AND purpose = '1-URGENT' AND year >= {STUDY.first_year} GROUP BY 1
    """,
)
def q_filter_parameterised(spark, sf):
    """Predicates that come from the study settings and from the caller."""
    urgent = F.col("purpose") == "1-URGENT"
    kept = loans(spark, sf).filter(STUDY.in_area()).filter(urgent).filter(F.col("year") >= STUDY.first_year)
    return kept.groupBy(STUDY.code).agg(
        F.count(F.lit(1)).alias("n"), money_sum("amt_tot").alias("amt")
    )


@query(
    "filter_detail_level",
    with_sql("tracts", "loans")
    + """
    SELECT stco_code, year, CAST(sum(amt_tot) AS DOUBLE) AS amt, count(*) AS n FROM loans GROUP BY ALL
    """,
)
def q_filter_detail_level(spark, sf):
    """County totals from a table that holds the detail and county and metro subtotals."""
    facts = loans(spark, sf).select("stco_code", "year", "amt_tot")
    detail = facts.withColumn("level", F.lit(DISCLOSURE_LEVELS["detail"]))
    county = facts.groupBy("stco_code", "year").agg(money_sum("amt_tot").alias("amt_tot"))
    metro = facts.groupBy("year").agg(money_sum("amt_tot").alias("amt_tot"))
    mixed = detail.unionByName(county.withColumn("level", F.lit(DISCLOSURE_LEVELS["county"]))).unionByName(
        metro.withColumns({"level": F.lit(DISCLOSURE_LEVELS["metro"]), "stco_code": F.lit(None).cast("string")})
    )
    return keep_level(mixed, "detail").groupBy("stco_code", "year").agg(
        money_sum("amt_tot").alias("amt"), F.count(F.lit(1)).alias("n")
    )


# ---- scalars -----------------------------------------------------------------


@query(
    "str_substring",
    """
    SELECT c_custkey, substr(c_name, 1, 4) AS head, right(c_name, 4) AS tail, substr(c_name, 10, 3) AS middle
    FROM customer
    """,
)
def q_str_substring(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        first_chars("c_name", 4).alias("head"),
        last_chars("c_name", 4).alias("tail"),
        F.substring("c_name", 10, 3).alias("middle"),
    )


@query(
    "str_pad_code",
    f"""
    SELECT o_orderkey, {pad_sql('o_orderkey', 3)} AS code3, {pad_sql('o_orderkey', 11)} AS code11 FROM orders
    """,
)
def q_str_pad_code(spark, sf):
    """Codes longer than the width are left alone."""
    return table(spark, sf, "orders").select(
        "o_orderkey", pad_code("o_orderkey", 3).alias("code3"), pad_code("o_orderkey", 11).alias("code11")
    )


@query(
    "str_replace_first_all",
    """
    SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '#') AS first_only,
           regexp_replace(p_name, '[aeiou]', '#', 'g') AS every_one
    FROM part
    """,
)
def q_str_replace_first_all(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        replace_first("p_name", "[aeiou]", "#").alias("first_only"),
        replace_all("p_name", "[aeiou]", "#").alias("every_one"),
    )


@query(
    "str_regex_classify",
    """
    SELECT CASE WHEN regexp_matches(p_name, '^(red|blue)') THEN 'coloured'
                WHEN regexp_matches(p_name, 'g[a-z]+$') THEN 'gadget' ELSE 'others' END AS kind,
           count(*) AS n, count(*) FILTER (WHERE regexp_matches(p_type, '[[:upper:]]')) AS n_upper
    FROM part GROUP BY 1
    """,
)
def q_str_regex_classify(spark, sf):
    name = F.col("p_name")
    kind = F.when(name.rlike("^(red|blue)"), "coloured").when(name.rlike("g[a-z]+$"), "gadget").otherwise("others")
    return table(spark, sf, "part").groupBy(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_type").rlike(r"\p{Upper}")).alias("n_upper")
    )


@query(
    "str_normalise_name",
    """
    SELECT p_partkey, regexp_replace(lower(trim(p_name)), 'saint', 'st.', 'g') AS place,
           regexp_replace(upper(p_name), '(SMALL|LARGE)', 'ST.', 'g') AS county
    FROM part
    """,
)
def q_str_normalise_name(spark, sf):
    """Messy spellings of a name, reduced by trimming, case folding and the rules tables."""
    messy = F.concat(F.lit(" \t"), F.initcap("p_name"), F.lit("\r\n"))
    parish = F.upper(F.regexp_replace("p_name", "^(small|large) ", "saint parish "))
    return table(spark, sf, "part").select(
        "p_partkey",
        place_label(messy).alias("place"),
        apply_rules(parish, COUNTY_NAME_RULES).alias("county"),
    )


@query(
    "recode_case_when",
    """
    WITH c AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg, c_acctbal FROM customer)
    SELECT c_custkey,
           CASE WHEN seg IN ('FURNITURE', 'HOUSEHOLD') OR c_acctbal > 9000 THEN true
                WHEN seg = 'MACHINERY' OR c_acctbal < 0 THEN false ELSE NULL END AS flag,
           CASE WHEN seg = 'MACHINERY' AND c_acctbal < 5000 THEN 'small'
                WHEN seg = 'MACHINERY' THEN 'large' ELSE 'NA' END AS size
    FROM c
    """,
)
def q_recode_case_when(spark, sf):
    """Three-valued flags and recodes with a default; an unknown condition falls through."""
    segment, balance = F.col("seg"), F.col("c_acctbal")
    df = table(spark, sf, "customer").withColumn("seg", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return df.select(
        "c_custkey",
        F.when(is_in("seg", ["FURNITURE", "HOUSEHOLD"]) | (balance > 9000), True)
        .when((segment == "MACHINERY") | (balance < 0), False).alias("flag"),
        F.when((segment == "MACHINERY") & (balance < 5000), "small")
        .when(segment == "MACHINERY", "large").otherwise("NA").alias("size"),
    )


@query(
    "fill_missing",
    """
    SELECT c_custkey, coalesce(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, 0) AS balance,
           coalesce(nullif(c_mktsegment, 'BUILDING'), 'unknown') AS segment
    FROM customer
    """,
)
def q_fill_missing(spark, sf):
    positive = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    return table(spark, sf, "customer").select(
        "c_custkey",
        fill_missing(positive, 0.0).alias("balance"),
        fill_missing(F.nullif("c_mktsegment", F.lit("BUILDING")), "unknown").alias("segment"),
    )


@query(
    "date_parse_year",
    """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, count(*) AS n_short,
           CAST(min(year(o_orderdate) % 100) AS INTEGER) AS yy
    FROM orders GROUP BY 1
    """,
)
def q_date_parse_year(spark, sf):
    """Year out of text dates with full and with abbreviated, upper-case months."""
    day = F.col("o_orderdate")
    texts = table(spark, sf, "orders").select(
        F.date_format(day, "d-MMMM-yy").alias("long_form"),
        F.upper(F.date_format(day, "dd-MMM-yy")).alias("short_form"),
        (F.year(day) % 100).alias("yy"),
    )
    years = texts.select(month_date_year("long_form").alias("year"), month_date_year("short_form").alias("other"), "yy")
    return years.groupBy("year").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("other") == F.col("year")).alias("n_short"),
        F.min("yy").alias("yy"),
    )


@query(
    "date_serial_year",
    """
    WITH t AS (SELECT o_orderkey % 5 = 0 AS is_text, CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT CAST(year(CASE WHEN is_text THEN d ELSE d + 2 END) AS INTEGER) AS year, count(*) AS n
    FROM t GROUP BY 1
    """,
)
def q_date_serial_year(spark, sf):
    """Year out of day serials (two days late by their origin) mixed with text."""
    day = F.col("o_orderdate").cast("date")
    serial = F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string")
    text = F.concat(F.lit("January "), F.year(day).cast("string"))
    raw = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 5 == 0, text).otherwise(serial).alias("when")
    )
    return raw.groupBy(serial_year("when").alias("year")).agg(F.count(F.lit(1)).alias("n"))
