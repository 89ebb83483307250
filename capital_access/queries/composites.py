"""Program cleaners, merges, reports and panels as whole pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from capital_access.functions.columns import pick
from capital_access.functions.nulls import cents
from capital_access.functions.text import pad_code
from capital_access.operators.quality import step_accounting
from capital_access.operators.reshape import vocabulary
from capital_access.operators.rows import bind_rows, set_difference
from capital_access.operators.spatial import ids_overlapping, rectangle
from capital_access.plans import gaps, merge, panel, programs
from capital_access.queries.registry import query
from capital_access.queries.roles import (
    COMPARED_SQL,
    PURPOSES,
    STUDY,
    attainment,
    award_county,
    blocks,
    county_metro,
    demographics,
    disclosure,
    emp_sql,
    exporter_county,
    exports,
    lender,
    loans,
    money_sql,
    owners,
    pad_sql,
    round_sql,
    rounded,
    table,
    tracts,
    with_sql,
    zones,
)
from capital_access.session import scratch_path, settle
from capital_access.sources.readers import csv_strings


# ---- cleaners ------------------------------------------------------------------


def _disclosure_lines(spark, sf):
    """The disclosure extract as raw lines: three spellings of the tag, subtotals, a foreign tag."""
    rows = disclosure(spark, sf)

    def number(c):
        return F.lpad(F.floor(c).cast("string"), 10, " ")

    spelling = F.col("year") % 3
    tag = F.when(spelling == 0, "A1-1 ").when(spelling == 1, "A1-1a").otherwise("A1-1")
    level = F.when(F.col("co_code") == "001", F.lit("200")).otherwise(F.lit("   "))
    body = F.concat(
        F.col("year").cast("string"), F.lit("4 "), "st_code", "co_code", F.lit("99999"), "tract_code",
        F.lit(" 1"), F.lit(" 14"), level,
        *[number(F.col(f"{kind}_{band}")) for band in programs.SIZE_BANDS for kind in ("n", "amt")],
        # the amount of the smallest loans is blank when there are none
        number(F.col("n_stot")),
        F.when(F.col("n_stot") > 0, number(F.col("amt_stot"))).otherwise(F.lit(" " * 10)),
        F.lit(" trailing"),
    )
    other = F.concat(F.lit("A2-1 "), body)
    return rows.select(F.explode(F.array(F.concat(tag, body), other)).alias("value"))


@query(
    "disclosure_clean",
    with_sql("tracts", "loans", "disclosure")
    + """
    SELECT year, '   ' AS level, substr(stcotr_code, 1, 2) AS st_code, substr(stcotr_code, 3, 3) AS co_code,
           '99999' AS cbsa_code, substr(stcotr_code, 6, 4) || '.' || substr(stcotr_code, 10, 2) AS tract_code,
           substr(stcotr_code, 1, 5) AS stco_code,
           CAST(floor(amt_below100k) * 1000 AS DOUBLE) AS amt_below100k,
           CAST(floor(amt_100to250k) * 1000 AS DOUBLE) AS amt_100to250k,
           CAST(floor(amt_250kto1m) * 1000 AS DOUBLE) AS amt_250kto1m,
           CASE WHEN n_stot > 0 THEN CAST(floor(amt_stot) * 1000 AS DOUBLE) END AS amt_stot,
           CAST((floor(amt_below100k) + floor(amt_100to250k) + floor(amt_250kto1m)) * 1000 AS DOUBLE) AS amt_tot,
           CAST(n_below100k AS DOUBLE) AS n_below100k, CAST(n_100to250k AS DOUBLE) AS n_100to250k,
           CAST(n_250kto1m AS DOUBLE) AS n_250kto1m, CAST(n_stot AS DOUBLE) AS n_stot, CAST(n_tot AS DOUBLE) AS n_tot
    FROM disclosure WHERE substr(stcotr_code, 3, 3) <> '001'
    """,
)
def q_disclosure_clean(spark, sf):
    """Raw fixed-width lines to detail rows in dollars."""
    return programs.clean_disclosure(programs.parse_disclosure(_disclosure_lines(spark, sf)))


def _lender_raw(spark, sf):
    """The community-lender extract, all text."""
    key, day = F.col("o_custkey"), F.col("o_orderdate")
    tract = (F.col("o_custkey") * 100003 + 17).cast("string")
    race = F.element_at(
        F.array(*[F.lit(r) for r in ("WHITE", "BLACK", "ASIAN", "PACIFIC", "OTHER", "")]),
        (key % 6 + 1).cast("int"),
    )
    return table(spark, sf, "orders").select(
        F.when(key % 4 == 0, "NONE").otherwise(tract).alias("projectfipscode_2010"),
        F.concat(F.lit("9"), tract).alias("projectfipscode_2000"),
        F.date_format(day, "dd-MMMM-yy").alias("dateclosed"),
        F.when(key % 5 == 0, "FEMALE").when(key % 5 == 1, "MALE").when(key % 5 == 2, "BOTH").otherwise("").alias("gender"),
        F.when(key % 3 == 0, "YES").when(key % 3 == 1, "NO").otherwise("").alias("womenownedorcontrolled"),
        race.alias("race"),
        F.when(F.col("o_orderkey") % 2 == 0, "NO").otherwise("YES").alias("hispanicorigin"),
        F.when(F.col("o_orderkey") % 97 == 0, "unknown")
        .otherwise(F.col("o_totalprice").cast("string")).alias("originalamount"),
        F.col("o_orderpriority").alias("purpose"),
        F.lit("52").alias("naicscode"),
        F.col("o_orderkey").cast("string").alias("transactionid"),
    )


@query(
    "community_lender_clean",
    f"""
    WITH raw AS (
        SELECT *, CAST(o_custkey * 100003 + 17 AS VARCHAR) AS t, o_custkey % 6 AS r, o_orderkey % 2 = 1 AS hispanic,
               o_custkey % 5 AS g, o_custkey % 3 AS w FROM orders),
    coded AS (
        SELECT *, CASE WHEN o_custkey % 4 = 0 THEN {pad_sql("'9' || t", 11)} ELSE {pad_sql('t', 11)} END AS stcotr_code FROM raw)
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, stcotr_code, substr(stcotr_code, 1, 5) AS stco_code,
           CASE WHEN o_custkey % 4 = 0 THEN 'NONE' ELSE t END AS projectfipscode_2010, '9' || t AS projectfipscode_2000,
           '52' AS naicscode, CAST(o_orderkey AS VARCHAR) AS transactionid, o_orderpriority AS purpose,
           CASE WHEN o_orderkey % 97 <> 0 THEN o_totalprice END AS amt_tot,
           CASE WHEN g IN (0, 2) OR w = 0 THEN true WHEN g = 1 OR w = 1 THEN false END AS is_woman,
           CASE WHEN r = 0 AND NOT hispanic THEN 'white' WHEN r = 1 AND NOT hispanic THEN 'black'
                WHEN r = 2 AND NOT hispanic THEN 'asian' WHEN r = 3 AND NOT hispanic THEN 'other'
                WHEN r IN (4, 5) AND hispanic THEN 'latino' ELSE 'NA' END AS race
    FROM coded
    """,
)
def q_community_lender_clean(spark, sf):
    """Codes, closing year, owner's gender and race, and amount out of text records."""
    raw, landed = _lender_raw(spark, sf), [scratch_path(spark, "lender") for _ in range(2)]
    late = F.col("dateclosed").substr(-2, 2) >= "98"
    # Blank fields are written as such, and later files have their columns in another order.
    raw.filter(~late).write.csv(landed[0], header=True, emptyValue="")
    raw.filter(late).select(*reversed(raw.columns)).write.csv(landed[1], header=True, emptyValue="")
    return programs.clean_community_lender(csv_strings(spark, landed, raw.columns))


@query(
    "yearly_program_totals",
    with_sql("tracts", "loans")
    + """
    SELECT year, purpose, CAST(sum(amt_tot) * 100 AS BIGINT) AS amt, CAST(sum(amt_tot) * 100 AS DOUBLE) / count(*) AS mean
    FROM loans GROUP BY ALL
    """,
)
def q_yearly_program_totals(spark, sf):
    """Sum and mean per year and program in cents, newest first."""
    return programs.yearly_totals(loans(spark, sf).withColumn("v", cents("amt_tot")), "v", ("year", "purpose"))


@query(
    "award_year_totals",
    """
    WITH t AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) ELSE CAST(o_orderdate AS DATE) + 2 END AS d,
                      CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders)
    SELECT CAST(year(d) AS INTEGER) AS year, CAST(sum(v) * 100 AS BIGINT) AS amt, CAST(sum(v) * 100 AS DOUBLE) / count(*) AS mean
    FROM t GROUP BY 1
    """,
)
def q_award_year_totals(spark, sf):
    """Research awards whose year is a day serial or text, totalled by the repaired year."""
    day = F.col("o_orderdate").cast("date")
    raw = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("January "), F.year(day).cast("string")))
        .otherwise(F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string")).alias("Award Year"),
        cents("o_totalprice").alias("Award Amount"),
    )
    return programs.yearly_totals(programs.clean_awards(raw), "Award Amount")


# ---- merges --------------------------------------------------------------------


def _employment(spark, sf):
    return merge.employment_years(blocks(spark, sf, 1996, 1999), {1996: 14, 1999: 17})


@query(
    "employment_by_tract",
    with_sql("tracts", "jobs")
    + f""", {emp_sql(1996, '14')}, {emp_sql(1999, '17')}
    SELECT * FROM emp14 FULL JOIN emp17 USING (stcotr_code)
    """,
)
def q_employment_by_tract(spark, sf):
    """Blocks to tracts, ten groups, two years side by side."""
    return _employment(spark, sf)


def _inputs(spark, sf, first=None, last=None):
    """What the tract merge takes, with disclosure since the first and until the last year."""
    return (
        _employment(spark, sf),
        merge.disclosure_tracts(disclosure(spark, sf, first, last)),
        lender(spark, sf),
        zones(spark, sf),
    )


def _master(spark, sf, one_row_per_key=True):
    """The tract master; the disclosure rows are sums by tract and year, so no key repeats."""
    return merge.tract_master(*_inputs(spark, sf), PURPOSES, one_row_per_key)


LENT_SQL = ", ".join(
    [f"CAST(sum(amt_tot) FILTER (WHERE purpose = '{p}') AS DOUBLE) AS amt_{p}" for p in PURPOSES]
    + [f"CAST(sum(amt_tot) FILTER (WHERE coalesce(purpose, 'NA') NOT IN {PURPOSES}) AS DOUBLE) AS amt_unlisted"]
)
MASTER_SQL = (
    with_sql("county_metro", "tracts", "loans", "disclosure", "lender", "zones", "jobs")
    + f""", {emp_sql(1996, '14')}, {emp_sql(1999, '17')},
    emp AS (SELECT * FROM emp14 FULL JOIN emp17 USING (stcotr_code)),
    lent AS (SELECT year, stcotr_code, {LENT_SQL}, CAST(sum(amt_tot) AS DOUBLE) AS "amt_tot_CDFI",
                    count(*) AS "n_tot_CDFI" FROM lender GROUP BY ALL),
    disc AS (SELECT stcotr_code, year, n_below100k, n_100to250k, n_250kto1m, n_stot, n_tot,
                    CAST(amt_below100k AS DOUBLE) AS amt_below100k, CAST(amt_100to250k AS DOUBLE) AS amt_100to250k,
                    CAST(amt_250kto1m AS DOUBLE) AS amt_250kto1m, CAST(amt_stot AS DOUBLE) AS amt_stot,
                    CAST(amt_tot AS DOUBLE) AS amt_tot
             FROM disclosure WHERE CAST(substr(stcotr_code, 1, 2) AS INTEGER) NOT BETWEEN 60 AND 95),
    lending AS (SELECT * FROM disc FULL JOIN lent USING (year, stcotr_code)),
    master AS (SELECT * FROM emp LEFT JOIN lending USING (stcotr_code) LEFT JOIN zones USING (stcotr_code))
    """
)
# Lending of the study years and areas with employment, as the reports use it.
STUDIED_SQL = (
    MASTER_SQL
    + f""", studied AS (
        SELECT * REPLACE (coalesce("amt_tot_CDFI", 0) AS "amt_tot_CDFI"), substr(stcotr_code, 1, 5) AS stco_code
        FROM master WHERE year >= {STUDY.first_year} AND emp_tot_17 IS NOT NULL
          AND substr(stcotr_code, 1, 5) IN {COMPARED_SQL}),
    analysis AS (SELECT * FROM studied LEFT JOIN county_metro USING (stco_code))
    """
)


@query("tract_master", MASTER_SQL + "SELECT * FROM master")
def q_tract_master(spark, sf):
    """Employment with both tract programs by year, and the zone."""
    return rounded(_master(spark, sf), 2)


@query("tract_master_hot_keys", MASTER_SQL + "SELECT * FROM master")
def q_tract_master_hot_keys(spark, sf):
    """The same by the joins for disclosure rows that may repeat a key."""
    return rounded(_master(spark, sf, one_row_per_key=False), 2)


def _analysis(spark, sf):
    return merge.study_master(*_inputs(spark, sf, STUDY.first_year), county_metro(spark, sf), STUDY, PURPOSES, one_row_per_key=True)


@query("analysis_master", STUDIED_SQL + "SELECT * FROM analysis")
def q_analysis_master(spark, sf):
    """The tract master cut to the study's years and areas."""
    return rounded(_analysis(spark, sf), 2)


EXPORTS_SQL = f"""
    approved AS (
        SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey AS k, {money_sql('o_totalprice')} AS v
        FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F'),
    exported AS (
        SELECT CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN {pad_sql('c_nationkey * 3001', 5)} END AS stco_code, year,
               CAST(sum(v) AS DOUBLE) AS amt_tot,
               CAST(coalesce(sum(v) FILTER (WHERE v < 200000), 0) AS DOUBLE) AS amt_small,
               CAST(coalesce(sum(v) FILTER (WHERE k % 2 = 0), 0) AS DOUBLE) AS amt_woman,
               CASE WHEN count(*) FILTER (WHERE k % 1000 = 1 AND k % 3 <> 0) = 0
                    THEN CAST(coalesce(sum(v) FILTER (WHERE k % 3 = 0), 0) AS DOUBLE) END AS amt_minority
        FROM approved JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""
AWARDED_SQL = """
    awarded AS (
        SELECT stco_code, year,
               CASE WHEN count(*) FILTER (WHERE loan_id % 500 = 3) = 0
                    THEN CAST(coalesce(sum(amt_tot) FILTER (WHERE decision = 'F'), 0) AS DOUBLE) END AS amt_female,
               CAST(coalesce(sum(amt_tot) FILTER (WHERE purpose = '1-URGENT'), 0) AS DOUBLE) AS amt_minority,
               CAST(sum(amt_tot) AS DOUBLE) AS amt_tot
        FROM loans GROUP BY ALL)"""


def _exported(spark, sf):
    cleaned = programs.clean_export_credit(exports(spark, sf))
    return merge.exporters_by_county(cleaned, exporter_county(spark, sf), county_metro(spark, sf))


def _awarded(spark, sf):
    return merge.awards_by_county(award_county(spark, sf), county_metro(spark, sf))


@query(
    "county_program_merge",
    with_sql("county_metro", "tracts", "loans")
    + f""", {EXPORTS_SQL}, {AWARDED_SQL}
    SELECT 'export' AS program, stco_code, year, stco_name, cbsa_name, amt_tot, amt_small, amt_woman, amt_minority
    FROM exported LEFT JOIN county_metro USING (stco_code)
    UNION ALL
    SELECT 'award', stco_code, year, stco_name, cbsa_name, amt_tot, NULL, amt_female, amt_minority
    FROM awarded LEFT JOIN county_metro USING (stco_code)
    """,
)
def q_county_program_merge(spark, sf):
    """Export credit and awards by county and year with the metro's name."""
    columns = ["program", "stco_code", "year", "stco_name", "cbsa_name", "amt_tot", "amt_small", "amt_woman", "amt_minority"]
    exported = _exported(spark, sf).withColumn("program", F.lit("export"))
    awarded = _awarded(spark, sf).withColumns(
        {"program": F.lit("award"), "amt_small": F.lit(None).cast("double"), "amt_woman": F.col("amt_female")}
    )
    return rounded(exported.select(columns).unionByName(awarded.select(columns)), 2)


@query(
    "county_program_average",
    with_sql("county_metro", "tracts", "loans")
    + f""", {EXPORTS_SQL}
    SELECT stco_code, stco_name, {round_sql('sum(amt_tot) / count(*)', 2)} AS "amt_tot_EXIM",
           {round_sql('sum(amt_small) / count(*)', 2)} AS "amt_small_EXIM", {round_sql('sum(amt_woman) / count(*)', 2)} AS "amt_woman_EXIM",
           CASE WHEN count(amt_minority) = count(*) THEN {round_sql('sum(amt_minority) / count(*)', 2)} END AS "amt_minority_EXIM"
    FROM exported JOIN county_metro USING (stco_code)
    WHERE year >= {STUDY.first_year} AND stco_code IN {COMPARED_SQL} GROUP BY ALL
    """,
)
def q_county_program_average(spark, sf):
    """Yearly mean of each export amount per study area."""
    return rounded(merge.program_average(_exported(spark, sf), STUDY, "_EXIM", known_county=True), 2)


@query(
    "program_shares",
    with_sql("tracts", "loans")
    + f""", {EXPORTS_SQL}, {AWARDED_SQL}
    SELECT 'export' AS program, stco_code, year, {round_sql('amt_small / nullif(amt_tot, 0)', 8)} AS pct_small,
           {round_sql('amt_woman / nullif(amt_tot, 0)', 8)} AS pct_woman, {round_sql('amt_minority / nullif(amt_tot, 0)', 8)} AS pct_minority
    FROM exported
    UNION ALL
    SELECT 'award', stco_code, year, NULL, {round_sql('amt_female / nullif(amt_tot, 0)', 8)}, {round_sql('amt_minority / nullif(amt_tot, 0)', 8)}
    FROM awarded
    """,
)
def q_program_shares(spark, sf):
    """Shares of the amounts by owner group in both county programs."""
    exported = gaps.export_shares(_exported(spark, sf)).select(
        F.lit("export").alias("program"), "stco_code", "year", "pct_small", "pct_woman", "pct_minority"
    )
    awarded = gaps.award_shares(_awarded(spark, sf)).select(
        F.lit("award").alias("program"), "stco_code", "year", F.lit(None).cast("double").alias("pct_small"),
        F.col("pct_female").alias("pct_woman"), "pct_minority",
    )
    return rounded(exported.unionByName(awarded), 8)


# ---- lending per worker ----------------------------------------------------------


EMP_GROUPS = [g.removeprefix("emp_") for g in merge.EMPLOYMENT_GROUPS]


def per_worker_sql(amount: str, suffix: str, name: str) -> str:
    """CTE ``name`` with the lending per worker of each study area."""
    means = ",\n".join(
        f"""sum(a * emp_{g}_17) FILTER (WHERE emp_{g}_17 <> 0) / nullif(sum(emp_{g}_17) FILTER (WHERE a IS NOT NULL), 0)
            AS amt_per_{g}, sum(emp_{g}_17 / {STUDY.n_years}.0::DOUBLE) AS emp_{g}_17_sum"""
        for g in EMP_GROUPS
    )
    outputs = ",\n".join(
        f'amt_per_{g} AS "amt_per_{g}{suffix}", emp_{g}_17_sum AS "emp_{g}_17_sum{suffix}"' for g in EMP_GROUPS
    )
    return f"""
    {name}_rates AS (SELECT *, {amount} / nullif(CAST(emp_tot_17 AS DOUBLE), 0) AS a FROM analysis),
    {name}_areas AS (
        SELECT stco_code, stco_name, {means},
               sum(coalesce(a * emp_tot_17, 0)) FILTER (WHERE stco_type IS NOT NULL) AS z,
               sum(coalesce(a * emp_tot_17, 0)) FILTER (WHERE stco_type IS NULL) AS nz,
               sum(emp_tot_17) FILTER (WHERE stco_type IS NOT NULL) AS zw,
               sum(emp_tot_17) FILTER (WHERE stco_type IS NULL) AS nzw
        FROM {name}_rates GROUP BY ALL),
    {name} AS (
        SELECT stco_code, stco_name, {outputs},
               (max(amt_per_tot) OVER () - amt_per_tot) * emp_tot_17_sum AS "gap_amt_emp{suffix}",
               (sum(amt_per_tot * emp_tot_17_sum) OVER () / sum(emp_tot_17_sum) OVER () - amt_per_tot)
                 * emp_tot_17_sum AS "gap_amt_emp_avg{suffix}",
               z / nullif(z + nz, 0) AS "pct_amt_oz{suffix}", z / nullif(zw, 0) AS "amt_per_oz{suffix}",
               nz / nullif(nzw, 0) AS "amt_per_noz{suffix}"
        FROM {name}_areas)"""


NUMBERS = "COLUMNS(* EXCLUDE (stco_code, stco_name))"


@query(
    "per_worker_summary",
    STUDIED_SQL
    + f""", {per_worker_sql('amt_tot', '_FDIC', 'fdic')}
    SELECT stco_code, stco_name, {round_sql(NUMBERS, 2)} FROM fdic
    """,
)
def q_per_worker_summary(spark, sf):
    """Lending per worker by employment group and zone with the gaps to the peers."""
    return rounded(gaps.per_worker_summary(_analysis(spark, sf), "amt_tot", STUDY, "_FDIC"), 2)


@query(
    "zone_split_summary",
    STUDIED_SQL
    + f""", {per_worker_sql('"amt_tot_CDFI"', '', 'cdfi')}
    SELECT stco_code, stco_name, {round_sql('pct_amt_oz')} AS pct_amt_oz, {round_sql('amt_per_oz')} AS amt_per_oz,
           {round_sql('amt_per_noz')} AS amt_per_noz FROM cdfi
    """,
)
def q_zone_split_summary(spark, sf):
    """Community lending inside and outside the zones of each area."""
    return rounded(gaps.zone_split(_analysis(spark, sf), "amt_tot_CDFI", STUDY.keys))


PRODUCTS = ["amt_below100k", "amt_100to250k", "amt_250kto1m", "amt_stot", "amt_tot",
            *[f"amt_{p}" for p in PURPOSES], "amt_tot_CDFI"]


def _category_sql(product: str) -> str:
    if product in ("amt_tot", "amt_tot_CDFI"):
        return "all"
    return "FDIC" if "0" in product else "CDFI" if any(c.isupper() for c in product) else "others"


@query(
    "per_worker_by_product",
    STUDIED_SQL
    + ", sums AS (SELECT stco_code, stco_name, "
    + ", ".join(f'coalesce(sum("{p}"), 0) AS "{p}"' for p in PRODUCTS)
    + """, sum(emp_tot_17) AS w FROM analysis GROUP BY ALL)
    """
    + " UNION ALL ".join(
        f"""SELECT stco_code, stco_name, '{p}' AS program, {round_sql(f'"{p}" / nullif(w, 0)')} AS amt_per_emp,
        '{_category_sql(p)}' AS category FROM sums"""
        for p in PRODUCTS
    ),
)
def q_per_worker_by_product(spark, sf):
    """Amount per worker of every loan product, one row per area and product."""
    rows = _analysis(spark, sf)
    ordered = pick(rows, STUDY.keys, "emp_tot_17", PRODUCTS)
    return rounded(gaps.per_worker_by_product(ordered, STUDY.keys))


# ---- ownership -------------------------------------------------------------------


OWNED = {
    "Female-owned": "c_mktsegment IN ('AUTOMOBILE', 'FURNITURE')",
    "Male-owned": "c_mktsegment IN ('BUILDING', 'HOUSEHOLD', 'MACHINERY')",
    "White": "c_mktsegment IN ('AUTOMOBILE', 'BUILDING')",
    "Black or African American": "c_mktsegment IN ('FURNITURE', 'MACHINERY')",
    "Hispanic": "c_mktsegment = 'HOUSEHOLD'",
    "Minority": "c_mktsegment IN ('FURNITURE', 'HOUSEHOLD', 'MACHINERY')",
    "Nonminority": "c_mktsegment IN ('AUTOMOBILE', 'BUILDING')",
}
TRADED = {"traded": "c_acctbal >= 2500", "local": "c_acctbal < 2500"}


def _count_sql(label: str, condition: str) -> str:
    cells = []
    for kind, where in TRADED.items():
        n = f"count(*) FILTER (WHERE {condition} AND {where})"
        cells.append(f'CAST(nullif({n}, 0) AS DOUBLE) AS "{label}_{kind}"')
    return ", ".join(cells)


OWNERS_SQL = (
    f"""firms AS (
        SELECT stco_code, stco_name AS "GEO_TTL", {_count_sql('All_classified', 'true')},
               {', '.join(_count_sql(g, c) for g, c in OWNED.items())},
               count(*) FILTER (WHERE c_custkey % 2 = 0) / CAST(count(*) AS DOUBLE) AS female,
               count(*) FILTER (WHERE c_custkey % 3 = 0) / CAST(count(*) AS DOUBLE) AS "Black or Hispanic"
        FROM tracts JOIN county_metro USING (stco_code) WHERE stco_code IN {COMPARED_SQL} GROUP BY ALL),
    shares AS (
        SELECT *, "All_classified_traded" + "All_classified_local" AS tot_firms,
               "All_classified_traded" / tot_firms AS pct_traded,
    """
    + ", ".join(
        f'"{label}_traded" / "All_classified_traded" AS pct_{g}_traded, '
        f'("{label}_traded" + "{label}_local") / tot_firms AS pct_{g}_all'
        for g, label in gaps.OWNER_GROUPS.items()
    )
    + """, pct_female_all / nullif(female, 0) AS share_female,
               (pct_hispanic_all + pct_black_all) / nullif("Black or Hispanic", 0) AS share_hispanic_black
        FROM firms),
    ownership AS (
        SELECT *, (max(share_female) OVER () * female - pct_female_all) * tot_firms AS gap_female_peer,
               gap_female_peer * pct_traded AS gap_female_peer_traded,
               (female - pct_female_all) * tot_firms AS gap_female_self,
               gap_female_self * pct_traded AS gap_female_self_traded,
               (max(share_hispanic_black) OVER () * "Black or Hispanic" - pct_hispanic_all - pct_black_all) * tot_firms
                 AS gap_hispanic_black_peer,
               gap_hispanic_black_peer * pct_traded AS gap_hispanic_black_peer_traded,
               ("Black or Hispanic" - pct_hispanic_all - pct_black_all) * tot_firms AS gap_hispanic_black_self,
               gap_hispanic_black_self * pct_traded AS gap_hispanic_black_self_traded,
               (max(pct_traded) OVER () - pct_traded) * tot_firms * pct_traded AS gap_traded,
               (sum(pct_traded * tot_firms) OVER () / sum(tot_firms) OVER () - pct_traded) * tot_firms AS gap_traded_avg
        FROM shares)"""
)


def _ownership(spark, sf):
    return gaps.ownership_summary(owners(spark, sf), demographics(spark, sf), STUDY)


@query(
    "ownership_gap",
    with_sql("county_metro", "tracts")
    + f""", {OWNERS_SQL}
    SELECT stco_code, "GEO_TTL", {round_sql('COLUMNS(* EXCLUDE (stco_code, "GEO_TTL"))', 6)} FROM ownership
    """,
)
def q_ownership_gap(spark, sf):
    """Firms by owner group, and the firms missing to the best peer and to parity."""
    return rounded(_ownership(spark, sf), 6)


@query(
    "attainment_summary",
    f"""
    SELECT {pad_sql('c_nationkey * 3001', 5)} AS stco_code,
    """
    + ", ".join(
        f"count(*) FILTER (WHERE c_custkey % {m} = 1) AS {name}"
        for name, m in {"baplus_white": 2, "baplus_black": 3, "baplus_asian": 4, "baplus_latino": 5,
                        "hsplus_white": 6, "hsplus_black": 7, "hsplus_asian": 8, "hsplus_latino": 9}.items()
    )
    + f" FROM customer GROUP BY 1 HAVING stco_code IN {COMPARED_SQL}",
)
def q_attainment_summary(spark, sf):
    """Education counts of the compared areas under readable names."""
    return gaps.attainment_summary(attainment(spark, sf), STUDY)


# ---- reports ---------------------------------------------------------------------


def _combined(spark, sf):
    """All summaries of the study areas side by side."""
    lending = gaps.per_worker_summaries(_analysis(spark, sf), {"_FDIC": "amt_tot", "_CDFI": "amt_tot_CDFI"}, STUDY)
    return gaps.combine_summaries(
        gaps.attainment_summary(attainment(spark, sf), STUDY),
        _ownership(spark, sf),
        lending["_FDIC"],
        lending["_CDFI"],
        merge.program_average(_exported(spark, sf), STUDY, "_EXIM", known_county=True),
        merge.program_average(_awarded(spark, sf), STUDY, "_SSTR"),
        STUDY,
    )


def _average_sql(source: str, columns: list[str], suffix: str, name: str) -> str:
    means = ", ".join(
        f'CASE WHEN count({c}) = count(*) THEN sum({c}) / count(*) END AS "{c}{suffix}"' for c in columns
    )
    return f"""{name} AS (SELECT stco_code, {means} FROM {source}
        WHERE year >= {STUDY.first_year} AND stco_code IN {COMPARED_SQL} GROUP BY 1)"""


EDUCATED_SQL = "educated AS (SELECT stco_code, " + ", ".join(
    f"CAST(count(*) FILTER (WHERE c_custkey % {m} = 1) AS DOUBLE) AS {n}"
    for n, m in {"baplus_white": 2, "baplus_black": 3, "hsplus_white": 6, "hsplus_black": 7}.items()
) + f" FROM tracts WHERE stco_code IN {COMPARED_SQL} GROUP BY 1)"
COMBINED_SQL = (
    STUDIED_SQL
    + f""", {per_worker_sql('amt_tot', '_FDIC', 'fdic')}, {per_worker_sql('"amt_tot_CDFI"', '_CDFI', 'cdfi')},
    {EXPORTS_SQL}, {AWARDED_SQL}, {OWNERS_SQL}, {EDUCATED_SQL},
    {_average_sql('exported', ['amt_tot', 'amt_small', 'amt_woman', 'amt_minority'], '_EXIM', 'exim')},
    {_average_sql('awarded', ['amt_female', 'amt_minority', 'amt_tot'], '_SSTR', 'sstr')},
    combined AS (
        SELECT * FROM educated LEFT JOIN ownership USING (stco_code) LEFT JOIN fdic USING (stco_code)
        LEFT JOIN (SELECT * EXCLUDE (stco_name) FROM cdfi) USING (stco_code)
        LEFT JOIN exim USING (stco_code) LEFT JOIN sstr USING (stco_code))
    """
)


OWNER_GAPS = [f"gap_{g}_{to}" for g in ("female", "hispanic_black") for to in ("peer", "peer_traded", "self", "self_traded")]
SHOWN_GAPS_SQL = ", ".join(
    [f'{round_sql(name, 2)} AS "{name}_SBO"' for name in (*OWNER_GAPS, "gap_traded", "gap_traded_avg")]
    + [f"""{round_sql(f'"gap_amt_emp{avg}_{p}"', 2)} AS "gap_amt_emp{avg}_{p}\"""" for p in ("FDIC", "CDFI") for avg in ("", "_avg")]
)


def _peer_report_sql(sstr: str, strict: bool) -> str:
    """The report over the combined table; ``strict`` has the study's own modes for missing rates."""
    def gap(name: str, rate: str, weight: str, best: bool, average: bool) -> str:
        best_rate = f"max({rate}) OVER ()"
        mean = f"sum({rate} * {weight}) OVER () / sum({weight}) FILTER (WHERE {rate} IS NOT NULL) OVER ()"
        whole = f"count({rate}) OVER () = count(*) OVER ()"
        best_rate = f"CASE WHEN {whole} THEN {best_rate} END" if best and strict else best_rate
        mean = f"CASE WHEN {whole} THEN {mean} END" if average and strict else mean
        return (f"""round(({best_rate} - {rate}) * {weight} + 1e-7::DOUBLE, 2) AS "{name}",
                round(({mean} - {rate}) * {weight} + 1e-7::DOUBLE, 2) AS "{name}_avg\"""")

    return COMBINED_SQL + f""", r AS (
        SELECT * REPLACE ({sstr} AS "amt_tot_SSTR"), "emp_tot_17_sum_FDIC" AS emp, tot_firms / nullif(emp, 0) AS pct_owner,
               "All_classified_traded" AS t, "amt_tot_EXIM" / nullif(t, 0) AS x, {sstr} / nullif(t, 0) AS s
        FROM combined)
    SELECT stco_code, stco_name, {round_sql('emp', 2)} AS emp_tot, {SHOWN_GAPS_SQL},
           {gap("gap_allfirms_emp", "pct_owner", "emp", True, True)}, {gap("gap_amt_traded_EXIM", "x", "t", False, False)},
           {gap("gap_amt_traded_SSTR", "s", "t", True, False)},
           tot_firms AS "tot_firms_SBO", t AS tot_traded, {round_sql('"amt_tot_EXIM"', 2)} AS "amt_tot_EXIM", {round_sql('"amt_tot_SSTR"', 2)} AS "amt_tot_SSTR"
    FROM r
    """


@query("peer_gap_report", _peer_report_sql('"amt_tot_SSTR"', strict=False))
def q_peer_gap_report(spark, sf):
    """Gaps to the peers in firms, export credit and awards, beside those of the summaries."""
    return rounded(gaps.peer_gap_report(_combined(spark, sf)), 2)


MISSING_AWARDS = STUDY.peers[0]


@query("peer_gap_report_modes", _peer_report_sql(f"""CASE WHEN stco_code <> '{MISSING_AWARDS}' THEN "amt_tot_SSTR" END""", strict=True))
def q_peer_gap_report_modes(spark, sf):
    """The report with the study's own modes for missing rates, where one area lacks its awards."""
    amount = F.when(F.col("stco_code") != MISSING_AWARDS, F.col("amt_tot_SSTR"))
    combined = _combined(spark, sf).withColumn("amt_tot_SSTR", amount)
    return rounded(gaps.peer_gap_report(combined, gaps.REPORT_MODES), 2)


DEMOGRAPHIC_GAPS = {
    "gap_hsplus_all_white_black":
        "(tot_firms * pct_white_all / nullif(hsplus_white, 0) - tot_firms * pct_black_all / nullif(hsplus_black, 0)) * hsplus_black",
    "gap_baplus_traded_white_black":
        '("White_traded" / nullif(baplus_white, 0) - "Black or African American_traded" / nullif(baplus_black, 0)) * baplus_black',
    **{f"gap_{p}_white_black": f'"amt_per_white_{p}" - "amt_per_black_{p}"' for p in ("FDIC", "CDFI")},
    **{f"gap_{p}_male_female": f'"amt_per_male_{p}" - "amt_per_female_{p}"' for p in ("FDIC", "CDFI")},
    **{f"gap_{p}_oz": f'"amt_per_noz_{p}" - "amt_per_oz_{p}"' for p in ("FDIC", "CDFI")},
    **{
        f"gap_{p}_{name}": f'"amt_{part}_{p}" / nullif("{group}_traded", 0)'
        f' - ("amt_tot_{p}" - "amt_{part}_{p}") / nullif("{others}_traded", 0)'
        for p, women in (("EXIM", "woman"), ("SSTR", "female"))
        for name, part, group, others in (
            ("white_nonwhite", "minority", "Minority", "Nonminority"),
            ("male_female", women, "Female-owned", "Male-owned"),
        )
    },
}


@query(
    "demographic_gap_report",
    COMBINED_SQL
    + f"SELECT stco_code, stco_name, {SHOWN_GAPS_SQL}, "
    + ", ".join(f'{round_sql(sql, 2)} AS "{name}"' for name, sql in DEMOGRAPHIC_GAPS.items())
    + " FROM combined",
)
def q_demographic_gap_report(spark, sf):
    """Gaps by race, gender and zone in every program, beside those of the summaries."""
    return rounded(gaps.demographic_gap_report(_combined(spark, sf)), 2)


# ---- row accounting --------------------------------------------------------------


@query(
    "merge_row_accounting",
    MASTER_SQL
    + """, flagged AS (SELECT stcotr_code FROM tracts WHERE c_acctbal < 0),
    n AS (SELECT (SELECT count(*) FROM priced) AS lines, (SELECT count(*) FROM disclosure) AS sums, (SELECT count(*) FROM flagged) AS flags,
                 (SELECT count(*) FROM zones) AS zoned, (SELECT count(*) FROM disc) AS disc, (SELECT count(*) FROM lent) AS lent,
                 (SELECT count(*) FROM (SELECT year, stcotr_code FROM disc UNION ALL SELECT year, stcotr_code FROM lent) x) AS both_rows,
                 (SELECT count(*) FROM (SELECT DISTINCT stcotr_code FROM disc UNION SELECT stcotr_code FROM lent) x) AS active,
                 (SELECT count(*) FROM emp) AS employed,
                 (SELECT count(*) FROM (SELECT stcotr_code FROM emp EXCEPT (SELECT stcotr_code FROM disc UNION SELECT stcotr_code FROM lent)) x) AS idle),
    r AS (SELECT unnest([
        {'position': 1, 'step': 'aggregate lines to tracts', 'rows_in': lines, 'rows_out': sums},
        {'position': 2, 'step': 'distinct zones', 'rows_in': flags, 'rows_out': zoned},
        {'position': 3, 'step': 'union of both programs', 'rows_in': disc + lent, 'rows_out': both_rows},
        {'position': 4, 'step': 'distinct tracts', 'rows_in': both_rows, 'rows_out': active},
        {'position': 5, 'step': 'tracts without lending', 'rows_in': employed, 'rows_out': idle}], recursive := true) FROM n)
    SELECT CAST(position AS BIGINT) AS position, step, rows_in, rows_out, rows_in - rows_out AS rows_dropped FROM r
    """,
)
def q_merge_row_accounting(spark, sf):
    """What the aggregates, unions, distincts and differences on the way to the tract merge keep and drop."""
    employment, lent, community, zone = _inputs(spark, sf)
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("loan_id")).join(loans(spark, sf).select("loan_id"), "loan_id")
    flagged = tracts(spark, sf).filter("c_acctbal < 0").select("stcotr_code")
    keys = settle(lent.select("year", "stcotr_code"), "disclosure_keys")
    other = settle(merge.lender_tracts(community, PURPOSES).select("year", "stcotr_code"), "lender_keys")
    both = bind_rows(keys, other)
    active = settle(both.select("stcotr_code").distinct(), "tract_keys")
    places = settle(employment.select("stcotr_code"), "employment_keys")
    return step_accounting([
        ("aggregate lines to tracts", [lines], disclosure(spark, sf)),
        ("distinct zones", [flagged], zone),
        ("union of both programs", [keys, other], both),
        ("distinct tracts", [both], active),
        ("tracts without lending", [places], set_difference(places, active)),
    ])


# ---- panel -----------------------------------------------------------------------


TARGET_METRO, TARGET_COUNTY = "00002", "21007"
CITY_SQL = "x <= 70 AND 20 <= x + w AND y <= 80 AND 30 <= y + w"


def _city_tracts(spark, sf):
    """Tracts of the city: those whose box meets the city's border."""
    key = F.col("c_custkey")
    x, y, w = (key * 37) % 1000 / 10, (key * 53) % 970 / 10, key % 7 / 4
    shapes = table(spark, sf, "customer").select(
        F.concat(pad_code(F.col("c_nationkey") * 3001, 5), pad_code(key % 1000000, 6)).alias("stcotr_code"),
        rectangle(x, y, x + w, y + w).alias("ring"),
    )
    city = spark.range(1).select(
        F.lit("city").alias("name"), rectangle(F.lit(20), F.lit(30), F.lit(70), F.lit(80)).alias("ring")
    )
    return ids_overlapping(shapes, city, "stcotr_code", "name", cell=25.0)


def _members(spark, sf, *names):
    """Which of the named levels (all unless given) each tract lies in; a table of tracts, written once."""
    metro = county_metro(spark, sf).select("stco_code", "cbsa_code")
    places = tracts(spark, sf).select("stcotr_code", "stco_code").distinct().join(metro, "stco_code", "left")
    levels = panel.geo_levels(F.col("in_city"), TARGET_METRO, TARGET_COUNTY)
    if not names or "city" in names:
        places = places.join(_city_tracts(spark, sf).withColumn("in_city", F.lit(True)), "stcotr_code", "left")
    return settle(panel.membership(places, "stcotr_code", {k: p for k, p in levels.items() if not names or k in names}), "members")


def _panel(spark, sf, *names):
    first, last = STUDY.panel_years
    is_award = F.col("decision") == "P"
    lent = loans(spark, sf, first, last).select(
        "stcotr_code", "year", F.when(is_award, "SBIR").otherwise("SBA").alias("type"),
        F.when(~is_award, F.when(F.col("purpose") < "3", "7A").otherwise("504")).alias("Program"), cents("amt_tot").alias("amount"))
    recent = lender(spark, sf).filter(F.col("year").between(first, last))
    both = bind_rows(merge.disclosure_tracts(disclosure(spark, sf, first, last)), merge.lender_tracts(recent, PURPOSES))
    # One row a tract, so an inner join; a semi-join would be pushed into both tables, and employment computed for each.
    places = both.join(_employment(spark, sf).select("stcotr_code"), "stcotr_code")
    in_cents = places.withColumns({c: cents(c) for c in ("amt_tot", "amt_stot", "amt_tot_CDFI")})
    return panel.member_panel(lent, in_cents, _members(spark, sf, *names), STUDY.panel_years)


def _program_rows(cte: str, where: str, geo: str, total: str, mean: str, kind: str, program: str, keys: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{geo}' AS geo, {program} AS "Program", year, '{measure}' AS measure, '{kind}' AS type,
        CAST({value} AS DOUBLE) AS value FROM {cte} WHERE {where} GROUP BY {keys}"""
        for measure, value in (("total", total), ("mean", mean))
    )


def _panel_sql(levels: dict[str, str]) -> str:
    parts = []
    for geo, where in levels.items():
        total = "CAST(sum(amt_tot) * 100 AS DOUBLE)"
        parts.append(_program_rows("placed", f"{where} AND decision = 'P'", geo, total, f"{total} / count(*)", "SBIR", "'SBIR'", "year"))
        parts.append(
            _program_rows("placed", f"{where} AND decision <> 'P'", geo, total, f"{total} / count(*)", "SBA",
                          "'SBA ' || CASE WHEN purpose < '3' THEN '7A' ELSE '504' END", "ALL")
        )
        for kind, column in (("FDIC", "tot"), ("FDICsmall", "stot"), ("CDFI", "tot_CDFI")):
            total = f'coalesce(sum(CAST(round("amt_{column}" * 100) AS BIGINT)), 0)::DOUBLE'
            parts.append(
                _program_rows("tract_rows", where, geo, total, f'{total} / nullif(sum("n_{column}"), 0)', kind, f"'{kind}'", "year")
            )
    return " UNION ALL ".join(parts)


PANEL_SQL = (
    MASTER_SQL
    + f""", shapes AS (
        SELECT stcotr_code, (c_custkey * 37) % 1000 / 10.0::DOUBLE AS x, (c_custkey * 53) % 970 / 10.0::DOUBLE AS y,
               c_custkey % 7 / 4.0::DOUBLE AS w FROM tracts),
    city AS (SELECT DISTINCT stcotr_code, true AS in_city FROM shapes WHERE {CITY_SQL}),
    placed AS (
        SELECT loans.*, cbsa_code, coalesce(in_city, false) AS in_city FROM loans LEFT JOIN county_metro USING (stco_code)
        LEFT JOIN city USING (stcotr_code) WHERE year BETWEEN {STUDY.panel_years[0]} AND {STUDY.panel_years[1]}),
    tract_rows AS (
        SELECT m.*, stco_code, cbsa_code, coalesce(in_city, false) AS in_city
        FROM (SELECT *, substr(stcotr_code, 1, 5) AS stco_code FROM master) m LEFT JOIN county_metro USING (stco_code)
        LEFT JOIN city USING (stcotr_code) WHERE year BETWEEN {STUDY.panel_years[0]} AND {STUDY.panel_years[1]})
    """
)
LEVELS_SQL = {
    "metro": f"cbsa_code = '{TARGET_METRO}'",
    "county": f"stco_code = '{TARGET_COUNTY}'",
    "city": "in_city",
}


@query(
    "geo_level_panel",
    PANEL_SQL + f", panel AS ({_panel_sql(LEVELS_SQL)}) SELECT * FROM panel",
)
def q_geo_level_panel(spark, sf):
    """All programs at the metro, the county and the city, by year."""
    return _panel(spark, sf)


@query(
    "program_panel",
    PANEL_SQL
    + f""", panel AS ({_panel_sql({'county': LEVELS_SQL['county']})})
    SELECT * EXCLUDE (geo) FROM panel
    """,
)
def q_program_panel(spark, sf):
    """All programs at one geography, given as a predicate."""
    return _panel(spark, sf, "county").drop("geo")


@query(
    "growth_rate",
    PANEL_SQL
    + f""", panel AS ({_panel_sql(LEVELS_SQL)}),
    wide AS (SELECT geo, "Program", measure, type, """
    + ", ".join(f'sum(value) FILTER (WHERE year = {y}) AS "{y}"' for y in range(1996, 2001))
    + """ FROM panel GROUP BY ALL)
    SELECT geo, "Program", measure, type, """
    + ", ".join(f'"{y}"' for y in range(1996, 2001))
    + """, round(pow("2000" / nullif("1996", 0), 0.25) - 1, 6) AS "CAGR_96_00" FROM wide
    """,
)
def q_growth_rate(spark, sf):
    """Years side by side with the compound annual growth."""
    wide = panel.growth_rate(_panel(spark, sf), 1996, 2000)
    return wide.withColumn("CAGR_96_00", F.round("CAGR_96_00", 6))


@query(
    "purpose_vocabulary",
    "SELECT DISTINCT coalesce(nullif(event_type, 'error'), 'NA') AS name FROM events",
)
def q_purpose_vocabulary(spark, sf):
    """The column names a widened table would get from the data."""
    events = table(spark, sf, "events").withColumn("purpose", F.nullif("event_type", F.lit("error")))
    return vocabulary(events, "purpose")
