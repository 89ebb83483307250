"""Aggregate and reshape queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from capital_access.functions.columns import containing, row_sum
from capital_access.functions.nulls import (
    cents,
    as_col,
    max_of,
    mean_of,
    money_sum,
    ratio,
    weighted_mean,
)
from capital_access.functions.text import pad_code
from capital_access.operators.aggregates import (
    compare_to_peers,
    many,
    quantiles,
    roll_up_code,
    six_numbers,
    weighted_means,
)
from capital_access.operators.quality import by_year
from capital_access.operators.reshape import lengthen, widen, widen_open
from capital_access.queries.registry import query
from capital_access.queries.roles import lender, loans, money_sql, pad_sql, table, tracts, with_sql
from capital_access.session import settle

# An amount that is unknown for one county and purpose, to tell the missing-value modes apart.
UNKNOWN_SQL = "CASE WHEN stco_code = '09003' AND purpose = '5-LOW' THEN NULL ELSE amt_tot END"


def _rounded(c, digits):
    """A fraction rounded as ``round_sql`` does."""
    return F.round(as_col(c) + 10.0 ** -(digits + 5), digits)


def _loans_with_gaps(spark, sf):
    unknown = (F.col("stco_code") == "09003") & (F.col("purpose") == "5-LOW")
    return loans(spark, sf).withColumn("amt", F.when(~unknown, F.col("amt_tot")))


@query(
    "agg_sum_na_modes",
    with_sql("tracts", "loans")
    + f"""
    SELECT stco_code, purpose, CAST(coalesce(sum(a), 0) AS DOUBLE) AS skipping,
           CASE WHEN count(a) = count(*) THEN CAST(sum(a) AS DOUBLE) END AS strict
    FROM (SELECT *, {UNKNOWN_SQL} AS a FROM loans) GROUP BY ALL
    """,
)
def q_agg_sum_na_modes(spark, sf):
    return _loans_with_gaps(spark, sf).groupBy("stco_code", "purpose").agg(
        money_sum("amt").alias("skipping"),
        money_sum("amt", na_rm=False).alias("strict"),
    )


@query(
    "agg_mean_na_modes",
    with_sql("tracts", "loans")
    + f"""
    SELECT stco_code, CAST(sum(a) AS DOUBLE) / nullif(count(a), 0) AS skipping,
           CASE WHEN count(a) = count(*) THEN CAST(sum(a) AS DOUBLE) / count(a) END AS strict,
           CASE WHEN count(a) = count(*) THEN CAST(max(a) AS DOUBLE) END AS strict_max
    FROM (SELECT *, {UNKNOWN_SQL} AS a FROM loans) GROUP BY ALL
    """,
)
def q_agg_mean_na_modes(spark, sf):
    """Means by sum in cents and count, exact in any order of rows."""
    sums = _loans_with_gaps(spark, sf).groupBy("stco_code").agg(
        money_sum("amt").alias("s"),
        F.count("amt").alias("n"),
        money_sum("amt", na_rm=False).alias("strict_s"),
        max_of("amt", na_rm=False).cast("double").alias("strict_max"),
    )
    return sums.select(
        "stco_code", ratio("s", "n").alias("skipping"), ratio("strict_s", "n").alias("strict"), "strict_max"
    )


@query(
    "agg_mean_rounded",
    with_sql("tracts", "loans")
    + f"""
    SELECT stco_code, purpose, round(avg(CAST(a AS DOUBLE)) + 1e-9::DOUBLE, 4) AS skipping,
           CASE WHEN count(a) = count(*) THEN round(avg(CAST(a AS DOUBLE)) + 1e-9::DOUBLE, 4) END AS strict
    FROM (SELECT *, {UNKNOWN_SQL} AS a FROM loans) GROUP BY ALL
    """,
)
def q_agg_mean_rounded(spark, sf):
    amount = F.col("amt").cast("double")
    return _loans_with_gaps(spark, sf).groupBy("stco_code", "purpose").agg(
        _rounded(mean_of(amount), 4).alias("skipping"), _rounded(mean_of(amount, na_rm=False), 4).alias("strict")
    )


@query(
    "agg_count_by_year",
    with_sql("tracts", "loans")
    + f"""
    SELECT year, count(a) AS n FROM (SELECT *, {UNKNOWN_SQL} AS a FROM loans) WHERE a IS NOT NULL GROUP BY 1
    """,
)
def q_agg_count_by_year(spark, sf):
    return by_year(_loans_with_gaps(spark, sf), "amt")


@query(
    "agg_weighted_mean",
    """
    SELECT l_suppkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity) + 1e-9::DOUBLE, 4) AS price,
           round(sum(l_extendedprice * w) FILTER (WHERE w <> 0) / nullif(sum(w), 0) + 1e-9::DOUBLE, 4) AS taxed_price,
           round(CASE WHEN count(x) = count(*) THEN sum(x * l_quantity) / sum(l_quantity) END + 1e-9::DOUBLE, 4) AS strict_price
    FROM (SELECT *, l_tax AS w, CASE WHEN l_quantity < 50 OR l_suppkey % 2 = 0 THEN l_extendedprice END AS x FROM lineitem)
    GROUP BY 1
    """,
)
def q_agg_weighted_mean(spark, sf):
    """Weights that may be zero, and a measure that may be missing."""
    line = table(spark, sf, "lineitem").withColumn(
        "x", F.when((F.col("l_quantity") < 50) | (F.col("l_suppkey") % 2 == 0), F.col("l_extendedprice"))
    )
    return line.groupBy("l_suppkey").agg(
        _rounded(weighted_mean("l_extendedprice", "l_quantity"), 4).alias("price"),
        _rounded(weighted_mean("l_extendedprice", "l_tax"), 4).alias("taxed_price"),
        _rounded(weighted_mean("x", "l_quantity", na_rm=False), 4).alias("strict_price"),
    )


@query(
    "agg_many_cols_funcs",
    """
    SELECT l_returnflag, l_linestatus,
           CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS l_quantity_sum, max(l_quantity) AS l_quantity_max,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS l_extendedprice_sum, max(l_extendedprice) AS l_extendedprice_max,
           CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS l_discount_sum, max(l_discount) AS l_discount_max
    FROM lineitem GROUP BY ALL
    """,
)
def q_agg_many_cols_funcs(spark, sf):
    """Three columns by two functions in one pass, names generated."""
    functions = {"sum": lambda c: money_sum(c), "max": max_of}
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(*many(columns, functions))


@query(
    "agg_multi_weight_means",
    """
    SELECT l_suppkey, round(sum(p * a) / nullif(sum(a), 0) + 1e-9::DOUBLE, 4) AS price_a,
           round(sum(p * n) / nullif(sum(n), 0) + 1e-9::DOUBLE, 4) AS price_n, round(sum(p * r) / nullif(sum(r), 0) + 1e-9::DOUBLE, 4) AS price_r
    FROM (SELECT l_suppkey, l_extendedprice / nullif(l_quantity, 0) AS p,
                 CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END AS a,
                 CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END AS n,
                 CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS r FROM lineitem)
    GROUP BY 1
    """,
)
def q_agg_multi_weight_means(spark, sf):
    """One rate under three weights in one pass."""
    weights = {
        f"price_{f.lower()}": F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0)
        for f in ("A", "N", "R")
    }
    line = table(spark, sf, "lineitem")
    means = line.groupBy("l_suppkey").agg(*weighted_means(ratio("l_extendedprice", "l_quantity"), weights))
    return means.select("l_suppkey", *[_rounded(n, 4).alias(n) for n in weights])


@query(
    "agg_flag_weighted_sum",
    with_sql("tracts", "loans")
    + """
    SELECT stco_code, year, CAST(coalesce(sum(amt_tot) FILTER (WHERE decision = 'F'), 0) AS DOUBLE) AS approved,
           CAST(coalesce(sum(amt_tot) FILTER (WHERE purpose = '1-URGENT'), 0) AS DOUBLE) AS urgent
    FROM loans GROUP BY ALL
    """,
)
def q_agg_flag_weighted_sum(spark, sf):
    """Amounts summed under 0/1 flags."""
    flags = loans(spark, sf).withColumns(
        {"approved": (F.col("decision") == "F").cast("int"), "urgent": (F.col("purpose") == "1-URGENT").cast("int")}
    )
    amount = F.col("amt_tot")
    return flags.groupBy("stco_code", "year").agg(
        money_sum(amount * F.col("approved"), na_rm=False).alias("approved"),
        money_sum(amount * F.col("urgent"), na_rm=False).alias("urgent"),
    )


@query("distinct_keys", "SELECT DISTINCT p_name, p_brand FROM part")
def q_distinct_keys(spark, sf):
    return table(spark, sf, "part").select("p_name", "p_brand").distinct()


@query(
    "row_sum_pattern",
    """
    SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0) + c_nationkey AS total FROM customer
    """,
)
def q_row_sum_pattern(spark, sf):
    """Sum across the columns whose name holds a text; missing counts as zero."""
    df = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("amt_balance"),
        F.col("c_nationkey").alias("amt_nation"),
    )
    return df.select("c_custkey", row_sum(containing(df, "amt_")).alias("total"))


@query(
    "group_by_expression",
    """
    SELECT c_mktsegment, c_acctbal < 0 AS negative, count(*) AS n,
           CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance
    FROM customer GROUP BY ALL
    """,
)
def q_group_by_expression(spark, sf):
    """A condition added to the existing keys."""
    keys = ["c_mktsegment"]
    return table(spark, sf, "customer").groupBy(*keys, (F.col("c_acctbal") < 0).alias("negative")).agg(
        F.count(F.lit(1)).alias("n"), money_sum("c_acctbal").alias("balance")
    )


@query(
    "agg_ratio_of_sums",
    f"""
    SELECT l_linenumber, CAST(sum({money_sql('l_extendedprice')}) AS DOUBLE) / nullif(sum(l_quantity), 0) AS price,
           CAST(sum({money_sql('l_extendedprice')}) AS DOUBLE)
             / nullif(CAST(count(*) FILTER (WHERE l_quantity > 99) AS DOUBLE), 0) AS none
    FROM lineitem GROUP BY 1
    """,
)
def q_agg_ratio_of_sums(spark, sf):
    """A sum over a sum; missing when the denominator is zero."""
    price = money_sum("l_extendedprice")
    return table(spark, sf, "lineitem").groupBy("l_linenumber").agg(
        ratio(price, F.sum("l_quantity")).alias("price"),
        ratio(price, F.count_if(F.col("l_quantity") > 99)).alias("none"),
    )


@query(
    "describe_six_number",
    f"""
    SELECT min(v) AS min, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
           round(CAST(sum({money_sql('v')}) AS DOUBLE) / count(v) + 1e-9::DOUBLE, 4) AS mean,
           quantile_cont(v, 0.75) AS q3, max(v) AS max, count(*) - count(v) AS n_missing
    FROM (SELECT CASE WHEN l_orderkey % 10 <> 0 THEN l_extendedprice END AS v FROM lineitem)
    """,
)
def q_describe_six_number(spark, sf):
    """Exact quartiles without gathering the column in one task."""
    line = table(spark, sf, "lineitem").select(
        F.when(F.col("l_orderkey") % 10 != 0, F.col("l_extendedprice")).alias("v")
    )
    return six_numbers(line, "v").withColumn("mean", _rounded("mean", 4))


@query(
    "quantiles_balance",
    " UNION ALL ".join(
        f"SELECT CAST({p} AS DOUBLE) AS p, quantile_cont(c_acctbal, {p}) AS value FROM customer"
        for p in (0.0, 0.1, 0.5, 0.99, 1.0)
    ),
)
def q_quantiles_balance(spark, sf):
    """Exact quantiles of a column with negative values."""
    return quantiles(table(spark, sf, "customer"), "c_acctbal", [0.0, 0.1, 0.5, 0.99, 1.0])


@query(
    "rollup_code_prefix",
    with_sql("tracts")
    + f"""
    SELECT substr(stcotr_code || {pad_sql('l_linenumber', 4)}, 1, 11) AS stcotr_code,
           CAST(sum(l_quantity) AS BIGINT) AS jobs, count(*) AS lines
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN tracts ON o_custkey = c_custkey GROUP BY 1
    """,
)
def q_rollup_code_prefix(spark, sf):
    """Blocks summed to tracts by the first 11 digits of their code."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    blocks = line.join(orders, "l_orderkey").join(tracts(spark, sf), "c_custkey").select(
        F.concat("stcotr_code", pad_code("l_linenumber", 4)).alias("w_geocode"),
        F.col("l_quantity").cast("long").alias("jobs"),
        F.lit(1).cast("long").alias("lines"),
    )
    return roll_up_code(blocks, "w_geocode", 11, ["jobs", "lines"], "stcotr_code")


# ---- comparison with peers -----------------------------------------------------


WORKERS_SQL = (
    with_sql("county_metro", "tracts", "loans")
    + """
    , staff AS (SELECT stco_code, sum(l_quantity) AS workers FROM lineitem JOIN orders ON l_orderkey = o_orderkey
               JOIN tracts ON o_custkey = c_custkey GROUP BY 1),
    lent AS (SELECT stco_code, CAST(sum(amt_tot) AS DOUBLE) AS amt FROM loans GROUP BY 1),
    areas AS (SELECT stco_code, amt, workers, amt / nullif(workers, 0) AS rate FROM lent JOIN staff USING (stco_code))
    """
)


def lending_per_worker(spark, sf):
    """Amount, workers and amount per worker by county."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity")
    county = tracts(spark, sf).select("c_custkey", "stco_code")
    staff = line.join(orders, "l_orderkey").join(county, "c_custkey").groupBy("stco_code").agg(
        F.sum("l_quantity").alias("workers")
    )
    lent = loans(spark, sf).groupBy("stco_code").agg(money_sum("amt_tot").alias("amt"))
    return lent.join(staff, "stco_code").withColumn("rate", ratio("amt", "workers"))


@query(
    "peer_gap",
    WORKERS_SQL
    + """
    SELECT stco_code, amt, workers, round(rate + 1e-9::DOUBLE, 4) AS rate,
           round((max(rate) OVER () - rate) * workers + 1e-7::DOUBLE, 2) AS gap,
           round((sum(rate * workers) OVER () / sum(workers) OVER () - rate) * workers + 1e-7::DOUBLE, 2) AS gap_avg
    FROM areas
    """,
)
def q_peer_gap(spark, sf):
    """Lending per worker by county with the amounts missing to the best and to the average county."""
    gaps = compare_to_peers(settle(lending_per_worker(spark, sf)), {"gap": ("rate", "workers")})
    return gaps.select(
        "stco_code", "amt", "workers", _rounded("rate", 4).alias("rate"),
        _rounded("gap", 2).alias("gap"), _rounded("gap_avg", 2).alias("gap_avg"),
    )


@query(
    "peer_gap_avg",
    WORKERS_SQL
    + """
    , tracts_rate AS (SELECT stcotr_code, stco_code, CAST(sum(amt_tot) AS DOUBLE) AS amt, count(*) AS n
                     FROM loans GROUP BY ALL),
    stats AS (SELECT sum(amt) / sum(n) AS average, max(amt / n) AS best FROM tracts_rate)
    SELECT stcotr_code, round((average - amt / n) * n + 1e-7::DOUBLE, 2) AS gap_avg, round((best - amt / n) * n + 1e-7::DOUBLE, 2) AS gap
    FROM tracts_rate, stats
    """,
)
def q_peer_gap_avg(spark, sf):
    """Every tract against the weighted average and the best tract: the compared set grows with the data."""
    rates = loans(spark, sf).groupBy("stcotr_code").agg(
        money_sum("amt_tot").alias("amt"), F.count(F.lit(1)).alias("n")
    ).withColumn("rate", ratio("amt", "n"))
    gaps = compare_to_peers(settle(rates), {"gap": ("rate", "n")})
    return gaps.select("stcotr_code", _rounded("gap_avg", 2).alias("gap_avg"), _rounded("gap", 2).alias("gap"))


# ---- reshape -------------------------------------------------------------------


@query(
    "pivot_sum_prefix",
    with_sql("tracts", "lender")
    + """
    SELECT year, stcotr_code, CAST(sum(amt_tot) FILTER (WHERE purpose = 'click') AS DOUBLE) AS amt_click,
           CAST(sum(amt_tot) FILTER (WHERE purpose = 'view') AS DOUBLE) AS amt_view,
           CAST(sum(amt_tot) FILTER (WHERE purpose NOT IN ('click', 'view', 'error')) AS DOUBLE) AS amt_unlisted,
           CAST(sum(amt_tot) FILTER (WHERE purpose = 'error') AS DOUBLE) AS "amt_NA"
    FROM lender GROUP BY ALL
    """,
)
def q_pivot_sum_prefix(spark, sf):
    """Sums by purpose as columns; an unknown purpose has the column amt_NA, all that are not listed share one."""
    loans_ = lender(spark, sf).withColumn("purpose", F.nullif("purpose", F.lit("error")))
    return widen(
        loans_, ["year", "stcotr_code"], "purpose", ["click", "view", "NA"], "amt_tot",
        aggregate=lambda c: F.when(F.count(c) > 0, money_sum(c)), rest="unlisted", prefix="amt_",
    )


@query(
    "pivot_open_vocabulary",
    with_sql("tracts", "lender")
    + """, cells AS (SELECT purpose, year, stcotr_code AS name, CAST(sum(amt_tot) * 100 AS BIGINT) AS c FROM lender GROUP BY ALL)
    SELECT purpose, year, count(*) AS n_names, CAST(sum(c) AS BIGINT) AS cents, min(name) AS first_name, arg_min(c, name) AS first_cents
    FROM cells GROUP BY ALL
    """,
)
def q_pivot_open_vocabulary(spark, sf):
    """Sums by tract as one map a purpose and year, the tracts not being listed anywhere; read back as count, total and first cell."""
    wide = widen_open(lender(spark, sf), ["purpose", "year"], "stcotr_code", cents("amt_tot"))
    names, amounts = F.map_keys("cells"), F.map_values("cells")
    return wide.select(
        "purpose", "year", F.size(names).cast("long").alias("n_names"), F.aggregate(amounts, F.lit(0).cast("long"), lambda a, c: a + c).alias("cents"),
        F.element_at(names, 1).alias("first_name"), F.element_at(amounts, 1).alias("first_cents"))


@query(
    "pivot_two_name_columns",
    """
    SELECT l_linenumber, """
    + ", ".join(
        f"""sum(l_quantity) FILTER (WHERE l_returnflag = '{flag}' AND l_linestatus = '{status}') AS "{flag}_{status}\""""
        for flag in "ANR" for status in "FO"
    )
    + " FROM lineitem GROUP BY 1",
)
def q_pivot_two_name_columns(spark, sf):
    line = table(spark, sf, "lineitem")
    return widen(line, ["l_linenumber"], ["l_returnflag", "l_linestatus"], ["A_F", "A_O", "N_F", "N_O", "R_F", "R_O"], "l_quantity", rest=None)


@query(
    "pivot_two_values",
    """
    SELECT l_linenumber, sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS "qty_F",
           sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS "qty_O",
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_linestatus = 'F') AS DOUBLE) AS "price_F",
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_linestatus = 'O') AS DOUBLE) AS "price_O"
    FROM lineitem GROUP BY 1
    """,
)
def q_pivot_two_values(spark, sf):
    values = {"qty": "l_quantity", "price": "l_extendedprice"}
    return widen(
        table(spark, sf, "lineitem"), ["l_linenumber"], "l_linestatus", ["F", "O"], values, rest=None,
        aggregate=lambda c: F.when(F.count(c) > 0, money_sum(c)),
    )


@query(
    "unpivot_pattern",
    """
    SELECT p_partkey, 'p_retailprice' AS measure, p_retailprice AS value FROM part
    UNION ALL SELECT p_partkey, 'p_price_if_large', CASE WHEN p_size > 25 THEN p_retailprice END FROM part
    """,
)
def q_unpivot_pattern(spark, sf):
    """Price columns as rows; missing values keep theirs."""
    part = table(spark, sf, "part").select(
        "p_partkey", "p_retailprice", F.when(F.col("p_size") > 25, F.col("p_retailprice")).alias("p_price_if_large")
    )
    return lengthen(part, containing(part, "price"), "measure", "value")
