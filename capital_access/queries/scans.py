"""Sources and sinks: tables are landed in the extract's format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from capital_access.functions.nulls import money_sum, to_integer, to_number
from capital_access.functions.text import pad_code
from capital_access.operators.joins import join_renamed
from capital_access.operators.rows import bind_rows
from capital_access.queries.registry import query
from capital_access.queries.roles import county_metro, in_years, loans, money_sql, table, with_sql
from capital_access.session import scratch_path, settle
from capital_access.sources.archives import read_zip_lines
from capital_access.sources.files import locate
from capital_access.sources.readers import (
    csv_strings,
    csv_typed,
    fixed_width,
    json_records,
    yearly_parquet,
)
from capital_access.sources.stores import load_bundle, save_bundle, save_csv, save_report, save_table


def _orders(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.year("o_orderdate").alias("year"),
        F.col("o_totalprice").alias("amt"),
        "o_orderpriority",
    )


@query(
    "scan_multi_file_union",
    f"""
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n,
           CAST(sum({money_sql('o_totalprice')}) AS DOUBLE) AS amt,
           count(*) FILTER (WHERE year(o_orderdate) > 1998) AS n_with_priority
    FROM orders GROUP BY 1
    """,
)
def scan_multi_file_union(spark, sf):
    """Two generations of a yearly extract, the older one without a column."""
    orders, root = _orders(spark, sf), scratch_path(spark, "yearly")
    save_table(orders.filter("year <= 1998").drop("o_orderpriority"), f"{root}/old", ["year"])
    save_table(orders.filter("year > 1998"), f"{root}/new", ["year"])
    both = bind_rows(*[yearly_parquet(spark, f"{root}/{part}") for part in ("old", "new")])
    return both.groupBy("year").agg(
        F.count(F.lit(1)).alias("n"),
        money_sum("amt").alias("amt"),
        F.count("o_orderpriority").alias("n_with_priority"),
    )


def _zipped(lines, root):
    """Paths of archives of lines, one per batch; the members' names change from batch to batch."""

    def pack(batches):
        import zipfile

        import pandas as pd
        from pyspark import TaskContext

        names = (["exp_aggr.dat"], ["12exp_aggr.dat", "13exp_aggr.dat", "14exp_aggr.dat"], ["cra2016_Aggr_A11.dat"])
        attempt = TaskContext.get().taskAttemptId()
        for i, batch in enumerate(batches):
            path = f"{root}/{attempt}-{i}.zip"
            system, name = locate(path)
            system.create_dir(name.rpartition("/")[0], recursive=True)
            members = names[(attempt + i) % 3]
            with system.open_output_stream(name) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("readme.txt", "not data\n")
                for k, member in enumerate(members):
                    archive.writestr(member, "".join(f"{line}\n" for line in batch["value"][k::len(members)]))
            yield pd.DataFrame({"path": [path]})

    return [r["path"] for r in settle(lines.mapInPandas(pack, "path string"), "archives").collect()]


@query(
    "scan_zip_members",
    f"""
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n,
           CAST(sum({money_sql('o_totalprice')}) AS DOUBLE) AS amt
    FROM orders GROUP BY 1
    """,
)
def scan_zip_members(spark, sf):
    """Zipped fixed-width extracts whose members are named in three ways, read member by member."""
    lines = _orders(spark, sf).select(
        F.concat(pad_code("year", 4), F.lpad(F.col("amt").cast("string"), 14, " ")).alias("value")
    )
    patterns = [r"^exp_aggr\.dat$", r"^\d\dexp_aggr\.dat$", r"^cra20\d\d_Aggr_A11\.dat$"]
    fields = fixed_width(read_zip_lines(spark, _zipped(lines, scratch_path(spark, "zips")), patterns), [("year", 4), ("amt", 14)])
    return fields.groupBy(to_integer("year").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), money_sum(to_number("amt")).alias("amt")
    )


@query(
    "fixed_width_parse",
    """
    SELECT lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS cust, CAST(year(o_orderdate) AS INTEGER) AS year,
           o_orderstatus AS status, CAST(o_totalprice AS DOUBLE) AS amt,
           rpad(substr(o_orderpriority, 1, 6), 6, ' ') AS purpose
    FROM orders
    """,
)
def fixed_width_parse(spark, sf):
    """Lines with five fields and trailing text, cut by position."""
    lines = table(spark, sf, "orders").select(
        F.concat(
            F.lpad(F.col("o_custkey").cast("string"), 9, "0"),
            F.year("o_orderdate").cast("string"),
            "o_orderstatus",
            F.lpad(F.col("o_totalprice").cast("string"), 16, " "),
            F.rpad("o_orderpriority", 20, " "),
        ).alias("value")
    )
    layout = [("cust", 9), ("year", 4), ("status", 1), ("amt", 16), ("purpose", 6)]
    return fixed_width(lines, layout).withColumns({"year": to_integer("year"), "amt": to_number("amt")})


@query(
    "csv_all_string_scan",
    """
    SELECT substr(lpad(CAST(c_custkey AS VARCHAR), 11, '0'), 1, 9) AS prefix, count(*) AS n,
           min(c_mktsegment) AS first_segment
    FROM customer GROUP BY 1
    """,
)
def csv_all_string_scan(spark, sf):
    """Codes with leading zeros survive the round trip through CSV."""
    path = scratch_path(spark, "csv")
    codes = table(spark, sf, "customer").select(pad_code("c_custkey", 11).alias("code"), "c_mktsegment")
    save_csv(codes, path)
    return (
        csv_strings(spark, path, ["code", "c_mktsegment"])
        .groupBy(F.substring("code", 1, 9).alias("prefix"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("c_mktsegment").alias("first_segment"))
    )


@query(
    "csv_typed_scan",
    f"""
    SELECT l_returnflag, CAST(sum(l_quantity) AS DOUBLE) AS qty,
           CAST(sum({money_sql('l_extendedprice')}) AS DOUBLE) AS price
    FROM lineitem WHERE year(l_shipdate) = 1999 GROUP BY 1
    """,
)
def csv_typed_scan(spark, sf):
    """One year's CSV, found by a path that holds the year, with a declared schema."""
    root, year = scratch_path(spark, "typed"), 1999
    line = table(spark, sf, "lineitem").filter(in_years("l_shipdate", year, year))
    save_csv(line.select("l_returnflag", "l_quantity", F.col("l_extendedprice").alias("price")), f"{root}/{year}")
    schema = "l_returnflag string, l_quantity double, price double"
    return csv_typed(spark, f"{root}/{year}", schema).groupBy("l_returnflag").agg(
        F.sum("l_quantity").alias("qty"), money_sum("price").alias("price")
    )


@query(
    "json_records_scan",
    f"""
    SELECT event_type, count(*) AS n, CAST(sum({money_sql('value')}) AS DOUBLE) AS amt,
           count(DISTINCT user_id) AS users
    FROM events GROUP BY 1
    """,
)
def json_records_scan(spark, sf):
    path = scratch_path(spark, "json")
    table(spark, sf, "events").select("event_id", "user_id", "event_type", "value").write.json(path)
    records = json_records(spark, path, "event_id long, user_id long, event_type string, value double")
    return records.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        money_sum("value").alias("amt"),
        F.count_distinct("user_id").alias("users"),
    )


@query(
    "bundle_roundtrip",
    with_sql("county_metro", "tracts", "loans")
    + """
    SELECT cbsa_name, year, count(*) AS n, CAST(sum(amt_tot) AS DOUBLE) AS amt
    FROM loans JOIN county_metro USING (stco_code) GROUP BY ALL
    """,
)
def bundle_roundtrip(spark, sf):
    """Cleaned tables saved under their names, the facts by year, and read back."""
    root = scratch_path(spark, "bundle")
    tables = {
        "loans_cleaned": loans(spark, sf).select("stco_code", "year", "amt_tot"),
        "county_cleaned": county_metro(spark, sf),
        "raw_orders": table(spark, sf, "orders"),
    }
    save_bundle(spark, tables, root, "_cleaned$", {"loans_cleaned": ["year"]})
    back = load_bundle(spark, root)
    return back["loans_cleaned"].join(back["county_cleaned"], "stco_code").groupBy("cbsa_name", "year").agg(
        F.count(F.lit(1)).alias("n"), money_sum("amt_tot").alias("amt")
    )


@query(
    "csv_sink_roundtrip",
    with_sql("tracts", "loans")
    + """
    SELECT stco_code, year, CAST(sum(amt_tot) AS DOUBLE) AS amt FROM loans GROUP BY ALL
    """,
)
def csv_sink_roundtrip(spark, sf):
    path = scratch_path(spark, "panel")
    panel = loans(spark, sf).groupBy("stco_code", "year").agg(money_sum("amt_tot").alias("amt"))
    save_csv(panel, path)
    return csv_typed(spark, path, "stco_code string, year int, amt double")


@query(
    "report_manifest",
    with_sql("tracts", "loans")
    + """
    SELECT 'county_summary' AS name, CAST(3 AS INTEGER) AS n_columns, count(DISTINCT stco_code) AS n_rows FROM loans
    UNION ALL
    SELECT 'year_summary', CAST(2 AS INTEGER), count(DISTINCT year) FROM loans
    """,
)
def report_manifest(spark, sf):
    """All tables named as summaries, written with a manifest; other tables are left out."""
    facts = loans(spark, sf)
    tables = {
        "county_summary": facts.groupBy("stco_code").agg(F.sum("amt_tot").alias("amt"), F.count("*").alias("n")),
        "year_summary": facts.groupBy("year").agg(F.sum("amt_tot").alias("amt")),
        "facts": facts,
    }
    return save_report(spark, tables, scratch_path(spark, "report")).drop("path")


@query(
    "inline_dim_join",
    f"""
    WITH priorities AS (
        SELECT * FROM (VALUES ('1-URGENT', 'Urgent'), ('2-HIGH', 'High'), ('3-MEDIUM', 'Medium'),
                              ('5-LOW', 'Low')) AS t(abb, name))
    SELECT o_orderpriority, name AS priority_name, count(*) AS n,
           CAST(sum({money_sql('o_totalprice')}) AS DOUBLE) AS amt
    FROM orders LEFT JOIN priorities ON o_orderpriority = abb GROUP BY ALL
    """,
)
def inline_dim_join(spark, sf):
    """A table written in the program, one row appended, joined on a differently named key."""
    schema = "abb string, name string"
    names = spark.createDataFrame([("1-URGENT", "Urgent"), ("2-HIGH", "High"), ("3-MEDIUM", "Medium")], schema)
    names = bind_rows(names, spark.createDataFrame([("5-LOW", "Low")], schema))
    sums = _orders(spark, sf).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), money_sum("amt").alias("amt")
    )
    return join_renamed(sums, names, {"o_orderpriority": "abb"}).withColumnRenamed("name", "priority_name")
