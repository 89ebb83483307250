"""Join, set and row-binding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from capital_access.config import select_codes
from capital_access.functions.nulls import money_sum
from capital_access.functions.text import pad_code
from capital_access.operators.joins import (
    full_join,
    full_join_many,
    join_with_suffixes,
    keep_matching,
    left_join,
    natural_left_join,
    null_safe_full_join,
    star_join,
    unmatched,
)
from capital_access.operators.matching import (
    locate_by_county_name,
    locate_by_place,
    locate_with_dictionary,
    match_places,
    place_keys,
)
from capital_access.operators.quality import filter_accounting, join_accounting
from capital_access.operators.rows import bind_common, bind_rows, set_difference, top_with_ties
from capital_access.operators.spatial import ids_overlapping, overlap_join, rectangle
from capital_access.plans.programs import clean_guaranteed
from capital_access.queries.registry import query
from capital_access.queries.roles import county_metro, loans, money_sql, pad_sql, table, tracts, with_sql, zones
from capital_access.session import scratch_path, settle


@query(
    "left_join_dim",
    """
    SELECT o_orderkey, c_mktsegment, c_acctbal FROM orders
    LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey
    """,
)
def q_left_join_dim(spark, sf):
    """Facts with the attributes of a dimension that lacks some of their keys."""
    dim = table(spark, sf, "customer").filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal"
    )
    facts = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return left_join(facts, dim, "o_custkey").drop("o_custkey")


@query(
    "left_join_multi_key",
    """
    WITH shipped AS (SELECT l_suppkey, year(l_shipdate) AS y, sum(l_quantity) AS qty
                     FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
    SELECT l_suppkey, CAST(y AS INTEGER) AS year, count(*) AS n, max(qty) AS qty_returned
    FROM (SELECT l_suppkey, year(l_shipdate) AS y FROM lineitem) LEFT JOIN shipped USING (l_suppkey, y)
    GROUP BY ALL
    """,
)
def q_left_join_multi_key(spark, sf):
    line = table(spark, sf, "lineitem").select(
        "l_suppkey", F.year("l_shipdate").alias("year"), "l_quantity", "l_returnflag"
    )
    returned = line.filter("l_returnflag = 'R'").groupBy("l_suppkey", "year").agg(
        F.sum("l_quantity").alias("qty_returned")
    )
    counts = line.groupBy("l_suppkey", "year").agg(F.count(F.lit(1)).alias("n"))
    return left_join(counts, returned, ["l_suppkey", "year"])


@query(
    "full_outer_two_key",
    f"""
    WITH a AS (SELECT o_custkey AS cust, year(o_orderdate) AS y, CAST(sum({money_sql('o_totalprice')}) AS DOUBLE) AS ordered
               FROM orders GROUP BY ALL),
    b AS (SELECT o_custkey AS cust, year(l_shipdate) AS y, count(*) AS shipped
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT cust, CAST(y AS INTEGER) AS year, ordered, shipped FROM a FULL JOIN b USING (cust, y)
    """,
)
def q_full_outer_two_key(spark, sf):
    """Two programs by customer and year, each reduced before the join."""
    orders = table(spark, sf, "orders")
    ordered = orders.groupBy(F.col("o_custkey").alias("cust"), F.year("o_orderdate").alias("year")).agg(
        money_sum("o_totalprice").alias("ordered")
    )
    line = table(spark, sf, "lineitem").select("l_orderkey", F.year("l_shipdate").alias("year"))
    keyed = line.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cust")), "l_orderkey")
    shipped = keyed.groupBy("cust", "year").agg(F.count(F.lit(1)).alias("shipped"))
    # Both sides hold one row per key, so a plain full join cannot meet a hot key.
    return ordered.join(shipped, ["cust", "year"], "full")


@query(
    "natural_left_join",
    with_sql("county_metro", "tracts", "loans")
    + """
    SELECT stco_code, year, amt, stco_name, cbsa_name
    FROM (SELECT stco_code, year, CAST(sum(amt_tot) AS DOUBLE) AS amt FROM loans GROUP BY ALL)
    LEFT JOIN (SELECT stco_code, stco_name, cbsa_name FROM county_metro WHERE cbsa_code <> '00002') USING (stco_code)
    """,
)
def q_natural_left_join(spark, sf):
    """No keys are given: the shared column decides."""
    sums = loans(spark, sf).groupBy("stco_code", "year").agg(money_sum("amt_tot").alias("amt"))
    names = county_metro(spark, sf).filter("cbsa_code <> '00002'").select("stco_code", "stco_name", "cbsa_name")
    return natural_left_join(sums, names)


@query(
    "join_with_suffixes",
    """
    SELECT c.c_nationkey AS nationkey, c.n AS n_x, c.balance AS balance_x, s.n AS n_y, s.balance AS balance_y
    FROM (SELECT c_nationkey, count(*) AS n, max(c_acctbal) AS balance FROM customer GROUP BY 1) c
    LEFT JOIN (SELECT s_nationkey, count(*) AS n, max(s_acctbal) AS balance FROM supplier
               WHERE s_acctbal > 5000 GROUP BY 1) s ON c_nationkey = s_nationkey
    """,
)
def q_join_with_suffixes(spark, sf):
    """Both sides have columns n and balance; both are kept under different names."""
    def summary(df, prefix):
        return df.groupBy(F.col(f"{prefix}_nationkey").alias("nationkey")).agg(
            F.count(F.lit(1)).alias("n"), F.max(f"{prefix}_acctbal").alias("balance")
        )

    suppliers = table(spark, sf, "supplier").filter("s_acctbal > 5000")
    return join_with_suffixes(summary(table(spark, sf, "customer"), "c"), summary(suppliers, "s"), "nationkey")


@query(
    "null_safe_full_join",
    """
    WITH a AS (SELECT nullif(c_mktsegment, 'BUILDING') AS seg, c_nationkey AS nation, count(*) AS n
               FROM customer WHERE c_nationkey < 20 GROUP BY ALL),
    b AS (SELECT nullif(c_mktsegment, 'BUILDING') AS seg, c_nationkey AS nation, max(c_acctbal) AS best
          FROM customer WHERE c_nationkey > 3 AND c_mktsegment <> 'MACHINERY' GROUP BY ALL)
    SELECT coalesce(a.seg, b.seg) AS seg, coalesce(a.nation, b.nation) AS nation, n, best
    FROM a FULL JOIN b ON a.seg IS NOT DISTINCT FROM b.seg AND a.nation = b.nation
    """,
)
def q_null_safe_full_join(spark, sf):
    """Groups with an unknown segment meet each other."""
    customer = table(spark, sf, "customer").select(
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"), F.col("c_nationkey").alias("nation"), "c_acctbal"
    )
    a = customer.filter("nation < 20").groupBy("seg", "nation").agg(F.count(F.lit(1)).alias("n"))
    b = customer.filter("nation > 3 AND (seg IS NULL OR seg <> 'MACHINERY')").groupBy("seg", "nation").agg(
        F.max("c_acctbal").alias("best")
    )
    return null_safe_full_join(a, b, ["seg", "nation"])


@query(
    "full_join_hot_side",
    with_sql("tracts", "zones")
    + f"""
    , lines AS (SELECT stcotr_code, CAST({money_sql('o_totalprice')} AS DOUBLE) AS amt
               FROM orders JOIN tracts ON o_custkey = c_custkey)
    SELECT stcotr_code, amt, stco_type FROM lines FULL JOIN zones USING (stcotr_code)
    """,
)
def q_full_join_hot_side(spark, sf):
    """Full join of all loans, many per tract, with one row per zone."""
    facts = loans(spark, sf).select("stcotr_code", F.col("amt_tot").alias("amt"))
    return full_join(facts, zones(spark, sf), "stcotr_code")


@query(
    "full_join_hot_both",
    with_sql("tracts")
    + f"""
    , lines AS (SELECT stcotr_code, o_orderpriority, CAST({money_sql('o_totalprice')} AS DOUBLE) AS amt
               FROM orders JOIN tracts ON o_custkey = c_custkey),
    a AS (SELECT stcotr_code, amt AS amt_urgent FROM lines WHERE o_orderpriority = '1-URGENT'),
    b AS (SELECT stcotr_code, amt AS amt_low FROM lines WHERE o_orderpriority = '5-LOW')
    SELECT stcotr_code, amt_urgent, amt_low FROM a FULL JOIN b USING (stcotr_code)
    """,
)
def q_full_join_hot_both(spark, sf):
    """Full join of the loans of two purposes by tract, many of either per tract."""
    settled = settle(loans(spark, sf).select("stcotr_code", "purpose", F.col("amt_tot").alias("amt")), "loans")
    urgent = settled.where("purpose = '1-URGENT'").select("stcotr_code", F.col("amt").alias("amt_urgent"))
    low = settled.where("purpose = '5-LOW'").select("stcotr_code", F.col("amt").alias("amt_low"))
    return full_join_many(urgent, low, "stcotr_code")


@query(
    "star_join_summaries",
    with_sql("county_metro", "tracts", "loans")
    + """
    SELECT stco_code, stco_name, n_loans, amt, n_tracts, n_zones, n_urgent
    FROM county_metro
    LEFT JOIN (SELECT stco_code, count(*) AS n_loans, CAST(sum(amt_tot) AS DOUBLE) AS amt FROM loans GROUP BY 1) a USING (stco_code)
    LEFT JOIN (SELECT stco_code, count(*) AS n_tracts FROM tracts GROUP BY 1) b USING (stco_code)
    LEFT JOIN (SELECT stco_code, count(*) AS n_zones FROM tracts WHERE c_acctbal < -900 GROUP BY 1) c USING (stco_code)
    LEFT JOIN (SELECT stco_code, count(*) AS n_urgent FROM loans WHERE purpose = '1-URGENT' GROUP BY 1) d USING (stco_code)
    """,
)
def q_star_join_summaries(spark, sf):
    """One row per county with four summaries beside it; two of them share one aggregate."""
    facts, places = loans(spark, sf), tracts(spark, sf)
    per_county = facts.groupBy("stco_code").agg(
        F.count(F.lit(1)).alias("n_loans"), money_sum("amt_tot").alias("amt")
    )
    urgent = facts.filter("purpose = '1-URGENT'").groupBy("stco_code").agg(F.count(F.lit(1)).alias("n_urgent"))
    n_tracts = places.groupBy("stco_code").agg(F.count(F.lit(1)).alias("n_tracts"))
    n_zones = places.filter("c_acctbal < -900").groupBy("stco_code").agg(F.count(F.lit(1)).alias("n_zones"))
    base = county_metro(spark, sf).select("stco_code", "stco_name")
    return star_join(base, [(s, ["stco_code"]) for s in (per_county, n_tracts, n_zones, urgent)])


def _places(spark, sf):
    """Facts with messily written place names: one per part."""
    return table(spark, sf, "part").select(
        "p_partkey",
        F.concat(F.initcap("p_name"), F.lit(" ")).alias("city_name"),
        F.concat(F.lit(" "), F.col("p_brand")).alias("region_name"),
    )


def _place_county(spark, sf):
    """Share of each place's quantity by county of the supplier; the second factor is by orders."""
    line = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    sums = (
        line.join(part, "l_partkey").join(supplier, "l_suppkey")
        .groupBy(F.lower("p_name").alias("pl_label"), F.col("p_brand").alias("st_name"), "s_nationkey")
        .agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n"))
    )
    factors = sums.select(
        "pl_label", "st_name", pad_code(F.col("s_nationkey") * 3001, 5).alias("stco_code"),
        # a few factors are unknown and count as 1
        F.when(F.col("s_nationkey") == 24, None).otherwise(F.floor(F.col("qty") / 20).cast("double")).alias("afact1"),
        F.col("n").cast("double").alias("afact2"),
    ).filter("st_name <> 'Brand#7'")
    # The crosswalk is read by the match and by the list of unmatched places.
    return settle(factors, "place_county")


PLACES_SQL = f"""
WITH sums AS (
    SELECT lower(p_name) AS pl_label, p_brand AS st_name, {pad_sql('s_nationkey * 3001', 5)} AS stco_code, s_nationkey,
           sum(l_quantity) AS qty, count(*) AS n
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    WHERE p_brand <> 'Brand#7' GROUP BY ALL),
factors AS (
    SELECT pl_label, st_name, stco_code,
           coalesce(CASE WHEN s_nationkey <> 24 THEN floor(qty / 20) END, 1) AS afact1, CAST(n AS DOUBLE) AS afact2
    FROM sums),
first AS (SELECT *, rank() OVER (PARTITION BY pl_label, st_name ORDER BY afact1 DESC) AS r1 FROM factors),
second AS (SELECT *, rank() OVER (PARTITION BY pl_label, st_name ORDER BY afact2 DESC) AS r2 FROM first WHERE r1 = 1),
best AS (SELECT pl_label, st_name, stco_code FROM second WHERE r2 = 1)
"""


@query(
    "place_match_best_factor",
    PLACES_SQL
    + """
    , places AS (SELECT DISTINCT p_name, p_brand FROM part)
    SELECT p_name AS pl_label, p_brand AS st_name, stco_code, stco_code IS NOT NULL AS matched
    FROM places LEFT JOIN best ON pl_label = p_name AND st_name = p_brand
    """,
)
def q_place_match_best_factor(spark, sf):
    """Distinct places with the county that holds most of them, and the places without one."""
    found = match_places(place_keys(_places(spark, sf)), _place_county(spark, sf))
    matched = found.matched.select("pl_label", "st_name", "stco_code", F.lit(True).alias("matched"))
    missing = found.unmatched.select(
        "pl_label", "st_name", F.lit(None).cast("string").alias("stco_code"), F.lit(False).alias("matched")
    )
    return matched.unionByName(missing)


@query(
    "resolve_and_join_back",
    PLACES_SQL
    + """
    SELECT p_partkey, stco_code, lpad(CAST(n_regionkey AS VARCHAR), 5, '0') AS cbsa_code
    FROM part LEFT JOIN best ON pl_label = p_name AND st_name = p_brand
    LEFT JOIN nation ON CAST(stco_code AS INTEGER) = n_nationkey * 3001
    """,
)
def q_resolve_and_join_back(spark, sf):
    """Every fact with county and metro; each distinct place was resolved once."""
    located = locate_by_place(_places(spark, sf), _place_county(spark, sf), county_metro(spark, sf))
    return located.select("p_partkey", "stco_code", "cbsa_code")


@query(
    "place_dictionary",
    PLACES_SQL
    + """
    SELECT p_partkey, stco_code, lpad(CAST(n_regionkey AS VARCHAR), 5, '0') AS cbsa_code
    FROM part LEFT JOIN best ON pl_label = p_name AND st_name = p_brand
    LEFT JOIN nation ON CAST(stco_code AS INTEGER) = n_nationkey * 3001
    """,
)
def q_place_dictionary(spark, sf):
    """Every fact with county and metro, from a dictionary that an earlier delivery of facts has filled in part."""
    facts, crosswalks = _places(spark, sf), (_place_county(spark, sf), county_metro(spark, sf))
    root = scratch_path(spark, "places")
    locate_with_dictionary(facts.where("p_partkey % 2 = 0"), *crosswalks, root)
    return locate_with_dictionary(facts, *crosswalks, root).select("p_partkey", "stco_code", "cbsa_code")


@query(
    "county_name_match",
    f"""
    SELECT o_orderpriority, n_name AS county, count(*) AS n, {money_sql('max(o_totalprice)')}::DOUBLE AS largest
    FROM orders JOIN customer ON o_custkey = c_custkey
    LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 9) ON c_nationkey = n_nationkey
    GROUP BY ALL
    """,
)
def q_county_name_match(spark, sf):
    """Loans located by a county name spelt differently from the county list."""
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    facts = orders.join(customer, "o_custkey").join(nation, "c_nationkey")
    spelt = facts.withColumns(
        {
            "ProjectCounty": F.concat(F.lit("saint "), F.lower("n_name"), F.lit("\t")),
            "ProjectState": F.concat(F.lit("S"), F.substring("n_name", 8, 2)),
        }
    ).drop("n_name")
    counties = table(spark, sf, "nation").filter("n_nationkey <> 9").select(
        F.col("n_name").alias("stco_code"),
        F.concat(F.lit("St. "), F.initcap("n_name"), F.lit(" Parish S"), F.substring("n_name", 8, 2)).alias("stco_name"),
    )
    located = locate_by_county_name(spelt, counties, "ProjectCounty", "ProjectState")
    return located.groupBy("o_orderpriority", F.col("stco_code").alias("county")).agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("largest")
    )


@query(
    "unmatched_report",
    """
    SELECT o_orderkey, o_custkey FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
    """,
)
def q_unmatched_report(spark, sf):
    """Orders without a line."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return unmatched(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), lines, "o_orderkey")


@query(
    "semi_join_derived",
    with_sql("county_metro", "tracts", "loans")
    + """
    SELECT stco_code, count(*) AS n, CAST(sum(amt_tot) AS DOUBLE) AS amt FROM loans
    WHERE stco_code IN (SELECT stco_code FROM county_metro WHERE cbsa_code IN ('00001', '00003')
                        AND stco_code NOT IN ('03001', '24008'))
    GROUP BY 1
    """,
)
def q_semi_join_derived(spark, sf):
    """Loans in the counties of two metros, less two counties."""
    codes = select_codes(
        county_metro(spark, sf), "stco_code", F.col("cbsa_code").isin("00001", "00003"), ["03001", "24008"]
    )
    return keep_matching(loans(spark, sf), codes, "stco_code").groupBy("stco_code").agg(
        F.count(F.lit(1)).alias("n"), money_sum("amt_tot").alias("amt")
    )


@query(
    "anti_join_derived",
    with_sql("tracts", "loans", "zones")
    + """
    SELECT stco_code, count(*) AS n FROM loans
    WHERE stcotr_code NOT IN (SELECT stcotr_code FROM zones) GROUP BY 1
    """,
)
def q_anti_join_derived(spark, sf):
    """Loans outside the zones."""
    return unmatched(loans(spark, sf), zones(spark, sf), "stcotr_code").groupBy("stco_code").agg(
        F.count(F.lit(1)).alias("n")
    )


def _boxes(spark, sf):
    """A rectangle per customer and per supplier, on a strip of squares of 100 x 100 that grows with the keys."""
    key = F.col("c_custkey")
    x, y = (key * 37) % 1000 / 10 + F.floor(key / 1000) * 100, (key * 53) % 970 / 10
    shapes = table(spark, sf, "customer").select(
        "c_custkey", rectangle(x, y, x + key % 7 / 4, y + key % 5 / 4).alias("ring")
    )
    key = F.col("s_suppkey")
    x, y = (key * 71) % 1000 / 10 + F.floor(key * 15 / 1000) * 100, (key * 29) % 970 / 10
    areas = table(spark, sf, "supplier").select(
        "s_suppkey", rectangle(x, y, x + 1 + key % 3, y + 1 + key % 2).alias("ring")
    )
    return shapes, areas


BOXES_SQL = """
WITH a AS (SELECT c_custkey, (c_custkey * 37) % 1000 / 10.0::DOUBLE + c_custkey // 1000 * 100 AS x, (c_custkey * 53) % 970 / 10.0::DOUBLE AS y,
                  c_custkey % 7 / 4.0::DOUBLE AS w, c_custkey % 5 / 4.0::DOUBLE AS h FROM customer),
b AS (SELECT s_suppkey, (s_suppkey * 71) % 1000 / 10.0::DOUBLE + s_suppkey * 15 // 1000 * 100 AS u, (s_suppkey * 29) % 970 / 10.0::DOUBLE AS v,
             1.0::DOUBLE + s_suppkey % 3 AS p, 1.0::DOUBLE + s_suppkey % 2 AS q FROM supplier)
"""
MEET_SQL = "x <= u + p AND u <= x + w AND y <= v + q AND v <= y + h"


@query("overlap_join_grid", BOXES_SQL + f"SELECT c_custkey, s_suppkey FROM a JOIN b ON {MEET_SQL}")
def q_overlap_join_grid(spark, sf):
    """Pairs of shapes that meet."""
    shapes, areas = _boxes(spark, sf)
    return overlap_join(shapes, areas, "c_custkey", "s_suppkey", cell=2.0)


@query(
    "overlap_semi_join",
    BOXES_SQL + f"SELECT c_custkey FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {MEET_SQL})",
)
def q_overlap_semi_join(spark, sf):
    """Shapes that meet any area, as used for the tracts of a city."""
    shapes, areas = _boxes(spark, sf)
    return ids_overlapping(shapes, areas, "c_custkey", "s_suppkey", cell=2.0)


# ---- sets --------------------------------------------------------------------


@query(
    "union_by_name_missing",
    """
    SELECT key, balance, segment FROM (
        SELECT c_nationkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer
        UNION ALL SELECT s_nationkey, s_acctbal, NULL FROM supplier)
    """,
)
def q_union_by_name_missing(spark, sf):
    customer = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("key"), F.col("c_acctbal").alias("balance")
    )
    supplier = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return bind_rows(customer, supplier)


def _guaranteed(spark, sf):
    """The two loan extracts, each with columns the other lacks."""
    base = loans(spark, sf).select(
        F.col("year").cast("string").alias("ApprovalFiscalYear"),
        F.when(F.col("purpose") < "3", "7A").otherwise("504").alias("Program"),
        F.col("amt_tot").alias("GrossApproval"),
        F.substring("stco_code", 1, 2).alias("BorrState"),
        F.substring("stco_code", 1, 2).alias("ProjectState"),
        F.col("stco_code").alias("ProjectCounty"),
        F.col("stcotr_code").alias("BorrCity"),
        F.col("decision").alias("BorrStreet"),
        F.lit("00000").alias("BorrZip"),
        F.substring("purpose", 1, 1).alias("NaicsCode"),
        "loan_id",
    )
    seven = base.filter("Program = '7A'").withColumnRenamed("loan_id", "only_in_7a")
    five = base.filter("Program = '504'").withColumnRenamed("loan_id", "only_in_504")
    return seven, five


@query(
    "union_common_projection",
    with_sql("tracts", "loans")
    + """
    SELECT year, CASE WHEN purpose < '3' THEN '7A' ELSE '504' END AS Program, CAST(amt_tot AS DOUBLE) AS amt_tot,
           substr(stco_code, 1, 2) AS st_name, substr(stco_code, 1, 2) AS st_name2, stco_code AS ct_name,
           stcotr_code AS city_name, decision AS street_name, '00000' AS zip_code, substr(purpose, 1, 1) AS naics6_code
    FROM loans
    """,
)
def q_union_common_projection(spark, sf):
    """Two loan extracts on their common columns under standard names."""
    return clean_guaranteed(*_guaranteed(spark, sf))


@query(
    "bind_common_rows",
    """
    SELECT nation, balance FROM (SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer
    UNION ALL SELECT s_nationkey, s_acctbal FROM supplier)
    """,
)
def q_bind_common_rows(spark, sf):
    customer = table(spark, sf, "customer").withColumnsRenamed({"c_nationkey": "nation", "c_acctbal": "balance"})
    supplier = table(spark, sf, "supplier").withColumnsRenamed({"s_nationkey": "nation", "s_acctbal": "balance"})
    return bind_common([customer, supplier], ["nation", "balance"])


@query(
    "set_difference",
    """
    SELECT c_nationkey AS nation, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer
    EXCEPT
    SELECT c_nationkey, nullif(c_mktsegment, 'BUILDING') FROM customer WHERE c_acctbal > 9500
    """,
)
def q_set_difference(spark, sf):
    customer = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("nation"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), "c_acctbal"
    )
    return set_difference(customer.drop("c_acctbal"), customer.filter("c_acctbal > 9500").drop("c_acctbal"))


@query(
    "topn_with_ties_per_group",
    """
    WITH a AS (SELECT *, rank() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC) AS r FROM lineitem),
    b AS (SELECT *, rank() OVER (PARTITION BY l_partkey ORDER BY l_linenumber DESC) AS s FROM a WHERE r = 1)
    SELECT l_partkey, l_quantity, l_linenumber, l_orderkey FROM b WHERE s = 1
    """,
)
def q_topn_with_ties_per_group(spark, sf):
    """Largest quantity per part, then largest line number; ties all stay."""
    line = table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_linenumber", "l_orderkey")
    return top_with_ties(line, ["l_partkey"], ["l_quantity", "l_linenumber"])


@query(
    "sort_desc_year",
    f"""
    SELECT CAST(nullif(year(o_orderdate), 1998) AS INTEGER) AS year, count(*) AS n,
           CAST(sum({money_sql('o_totalprice')}) AS DOUBLE) AS amt
    FROM orders GROUP BY 1 ORDER BY 1 DESC NULLS LAST
    """,
)
def q_sort_desc_year(spark, sf):
    """Newest year first, unknown year last."""
    orders = table(spark, sf, "orders")
    return orders.groupBy(F.nullif(F.year("o_orderdate"), F.lit(1998)).alias("year")).agg(
        F.count(F.lit(1)).alias("n"), money_sum("o_totalprice").alias("amt")
    ).orderBy(F.col("year").desc_nulls_last())


# ---- row accounting ----------------------------------------------------------


@query(
    "step_row_accounting",
    with_sql("tracts", "loans")
    + """
    , f AS (SELECT year >= 1997 AS a, decision = 'F' AS b, amt_tot > 100000 AS c FROM loans),
    n AS (SELECT count(*) AS n0, count(*) FILTER (WHERE a) AS n1, count(*) FILTER (WHERE a AND b) AS n2,
                 count(*) FILTER (WHERE a AND b AND c) AS n3 FROM f)
    SELECT 1::BIGINT AS position, 'recent' AS step, n0 AS rows_in, n1 AS rows_out, n0 - n1 AS rows_dropped FROM n
    UNION ALL SELECT 2, 'approved', n1, n2, n1 - n2 FROM n
    UNION ALL SELECT 3, 'large', n2, n3, n2 - n3 FROM n
    """,
)
def q_step_row_accounting(spark, sf):
    """Rows kept and dropped by each filter of a chain."""
    return filter_accounting(
        loans(spark, sf),
        [
            ("recent", F.col("year") >= 1997),
            ("approved", F.col("decision") == "F"),
            ("large", F.col("amt_tot") > 100000),
        ],
    )


@query(
    "join_row_accounting",
    """
    WITH l AS (SELECT l_orderkey, count(*) AS m FROM lineitem GROUP BY 1)
    SELECT 'orders to lines' AS step, count(*) AS rows_in, count(m) AS rows_matched,
           count(*) - count(m) AS rows_unmatched, CAST(sum(coalesce(m, 1)) AS BIGINT) AS rows_out
    FROM orders LEFT JOIN l ON o_orderkey = l_orderkey
    """,
)
def q_join_row_accounting(spark, sf):
    """Matched and unmatched orders and the fan-out of a left join."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return join_accounting(table(spark, sf, "orders"), lines, ["o_orderkey"], "orders to lines")
