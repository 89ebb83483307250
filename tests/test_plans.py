"""Cleaners, merges, gap reports and panels on hand-made extracts."""

import pytest
from pyspark.sql import functions as F

from capital_access.config import StudyConfig
from capital_access.plans import gaps, merge, panel, programs
from tests.conftest import rows

CBSA = StudyConfig(area="cbsa", peers=("10", "20"), targets=("30",))


def records(df, *columns):
    return [r.asDict() for r in (df.select(*columns) if columns else df).collect()]


# ---- cleaners ------------------------------------------------------------------


def line(tag, level="   ", st="01", amounts=("5", "10", "7", "20", "3", "30", "1", "2"), tail=""):
    return f"{tag}2014" + "4 " + st + "999" + "70001" + "0001.02" + " 1" + " 14" + level + "".join(f"{a:>10}" for a in amounts) + tail


def test_disclosure_lines(spark):
    blank = ("5", "", "7", "20", "3", "30", "1", "2")
    lines = [line("A1-1 "), line("A1-1a", tail="junk"), line("A1-1"), line("A2-1 "), line("A1-1 ", level="200"), line("A1-1 ", amounts=blank)]
    parsed = programs.parse_disclosure(spark.createDataFrame([(v,) for v in lines], "value string"))
    assert parsed.count() == 5
    cleaned = programs.clean_disclosure(parsed)
    got = records(cleaned, "year", "stco_code", "cbsa_code", "tract_code", "n_tot", "amt_tot", "amt_stot", "amt_below100k")
    base = {"year": 2014, "stco_code": "01999", "cbsa_code": "70001", "tract_code": "0001.02", "n_tot": 15.0, "amt_stot": 2000.0}
    whole = {**base, "amt_tot": 60000.0, "amt_below100k": 10000.0}
    assert got.count(whole) == 3 and got.count({**base, "amt_tot": None, "amt_below100k": None}) == 1
    county = programs.clean_disclosure(parsed, "county")
    assert county.count() == 1
    assert cleaned.columns[:2] == ["year", "level"]


def lender_row(**changed):
    row = dict(projectfipscode_2010="1999000100", projectfipscode_2000="01999000200", dateclosed="05-January-17", gender="MALE",
               womenownedorcontrolled="", race="WHITE", hispanicorigin="NO", originalamount="100.50", purpose="MICRO", naicscode="44",
               transactionid="t")
    return {**row, **changed}


@pytest.mark.parametrize("changed, column, expected", [
    ({}, "stcotr_code", "01999000100"),
    ({"projectfipscode_2010": "NONE"}, "stcotr_code", "01999000200"),
    ({"projectfipscode_2010": "123456789012"}, "stcotr_code", "123456789012"),
    ({}, "stco_code", "01999"),
    ({"dateclosed": "05-JAN-75"}, "year", 1975),
    ({"dateclosed": ""}, "year", None),
    ({"originalamount": "abc"}, "amt_tot", None),
    ({}, "is_woman", False),
    ({"gender": "BOTH"}, "is_woman", True),
    ({"gender": "MALE", "womenownedorcontrolled": "YES"}, "is_woman", True),
    ({"gender": "", "womenownedorcontrolled": "NO"}, "is_woman", False),
    ({"gender": "", "womenownedorcontrolled": ""}, "is_woman", None),
    ({"gender": None, "womenownedorcontrolled": None}, "is_woman", None),
    ({}, "race", "white"),
    ({"race": "PACIFIC"}, "race", "other"),
    ({"race": "", "hispanicorigin": "YES"}, "race", "latino"),
    ({"hispanicorigin": "YES"}, "race", "NA"),
    ({"race": None}, "race", "NA"),
])
def test_community_lender(spark, changed, column, expected):
    row = lender_row(**changed)
    raw = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in row))
    cleaned = programs.clean_community_lender(raw)
    assert cleaned.first()[column] == expected
    assert "transactionid" in cleaned.columns and "gender" not in cleaned.columns


def test_export_credit(spark):
    columns = ["unique_identifier", "program", "decision", "fiscal_year", "approved_declined_amount", "small_business_authorized_amount",
               "woman_owned_authorized_amount", "minority_owned_authorized_amount", "primary_export_product_naics_sic_code", "primary_lender"]
    rows_ = [("1", "Working Capital", "Approved", "2014", "10.5", "1", " ", "n/a", "3344", "bank"),
             ("2", "Working Capital", "Declined", "2014", "1", "1", "1", "1", "1", "b"),
             ("3", "Insurance", "Approved", "2014", "1", "1", "1", "1", "1", "b")]
    cleaned = programs.clean_export_credit(spark.createDataFrame(rows_, ", ".join(f"{c} string" for c in columns)))
    assert records(cleaned) == [{"year": 2014, "unique_identifier": "1", "naics4_code": "3344", "primary_lender": "bank",
                                 "amt_tot": 10.5, "amt_small": 1.0, "amt_woman": None, "amt_minority": None}]


def test_yearly_totals_newest_first(spark):
    df = spark.createDataFrame([(2014, 1.0), (None, 5.0), (2016, None), (2014, 3.0), (2016, None)], "year int, amt_tot double")
    assert [tuple(r) for r in programs.yearly_totals(df).collect()] == [(2016, 0.0, None), (2014, 4.0, 2.0), (None, 5.0, 5.0)]
    assert [r["amt"] for r in programs.yearly_totals(df, na_rm=False).collect()] == [None, 4.0, 5.0]


# ---- merges --------------------------------------------------------------------


def blocks(spark, data):
    values = [(code, *[n] * len(merge.EMPLOYMENT_CODES)) for code, n in data]
    return spark.createDataFrame(values, "w_geocode string, " + ", ".join(f"{c} long" for c in merge.EMPLOYMENT_CODES))


def test_employment_by_tract(spark):
    a = merge.employment_by_tract(blocks(spark, [("19990001021000", 1), ("019990001021001", 2), ("489990001021001", 5)]), 14)
    b = merge.employment_by_tract(blocks(spark, [("019990001021000", 7), ("990000000000000", 0)]), "17")
    assert rows(a.select("stcotr_code", "emp_tot_14", "emp_below40k_14", "emp_tradable_14", "emp_other_14")) == [
        ("01999000102", 3, 6, 21, 9), ("48999000102", 5, 10, 35, 15)]
    both = merge.join_employment_years(a, b).select("stcotr_code", "emp_tot_14", "emp_tot_17")
    assert rows(both) == [("01999000102", 3, 7), ("48999000102", 5, None), ("99000000000", None, 0)]


@pytest.mark.parametrize("one_row_per_key", [True, False])
def test_tract_master(spark, one_row_per_key):
    employment = spark.createDataFrame([("01999000102", 10), ("01999000200", 20), ("01999000300", 30)], "stcotr_code string, emp_tot_17 long")
    disclosure = spark.createDataFrame(
        [("2014", "01", "999", "0001.02", 5.0, 1.0), ("2015", "01", "999", "0001.02", 6.0, 2.0), ("2014", "72", "999", "0002.00", 7.0, 1.0),
         ("2014", None, "999", "0009.00", 8.0, 1.0)],
        "year string, st_code string, co_code string, tract_code string, amt_tot double, n_tot double",
    )
    lender = spark.createDataFrame(
        [(2014, "01999000102", "A", 1.0), (2014, "01999000102", "A", None), (2014, "01999000102", None, 4.0), (2016, "01999000200", "B", None),
         (None, "01999000200", "B", 3.0), (2014, None, "A", 9.0)],
        "year int, stcotr_code string, purpose string, amt_tot double",
    )
    zones = spark.createDataFrame([("01999000102", "urban")], "stcotr_code string, stco_type string")
    kept = merge.disclosure_tracts(disclosure)
    assert kept.count() == 3  # the territory is dropped, the unknown state is not
    master = merge.tract_master(employment, kept, lender, zones, one_row_per_key=one_row_per_key)
    got = rows(master.select("stcotr_code", "year", "emp_tot_17", "amt_tot", "amt_A", "amt_NA", "amt_B", "amt_tot_CDFI", "n_tot_CDFI", "stco_type"))
    assert got == [
        ("01999000102", 2014, 10, 5.0, 1.0, 4.0, None, 5.0, 3, "urban"),
        ("01999000102", 2015, 10, 6.0, None, None, None, None, None, "urban"),
        ("01999000200", 2016, 20, None, None, None, 0.0, 0.0, 1, None),
        ("01999000200", None, 20, None, None, None, 3.0, 3.0, 1, None),
        ("01999000300", None, 30, None, None, None, None, None, None, None),
    ]


def test_lender_total_counts_all_purposes(spark):
    lender = spark.createDataFrame([(2014, "t", "A", 1.0), (2014, "t", "B", 5.0), (2014, "t", None, 4.0)], "year int, stcotr_code string, purpose string, amt_tot double")
    listed = merge.lender_tracts(lender, ["A"]).first().asDict()
    assert listed == {"year": 2014, "stcotr_code": "t", "amt_A": 1.0, "amt_unlisted": 9.0, "amt_tot_CDFI": 10.0, "n_tot_CDFI": 3}
    assert merge.lender_tracts(lender).columns == ["year", "stcotr_code", "amt_A", "amt_B", "amt_NA", "amt_tot_CDFI", "n_tot_CDFI"]


def test_employment_years_in_one_scan(spark):
    data = [("019990001021001", 1), ("019990001021001", 2), ("489990001021001", 5), ("990000000000000", 0)]
    both = blocks(spark, data).withColumn("year", F.when(F.col("w_geocode").startswith("48"), 2014).otherwise(2017))
    both = both.unionByName(blocks(spark, [("19990001021000", 4)]).withColumn("year", F.lit(2014)))
    joined = merge.join_employment_years(*(merge.employment_by_tract(both.filter(F.col("year") == y), s) for y, s in ((2014, 14), (2017, 17))))
    assert rows(merge.employment_years(both, {2014: 14, 2017: 17}).select(joined.columns)) == rows(joined)


@pytest.mark.parametrize("area", ["cbsa", "stco"])
def test_study_master_equals_the_merge_cut_afterwards(spark, county_metro, area):
    study = StudyConfig(area=area, peers=("10", "01999"), targets=("77777",), first_year=2014)
    employment = spark.createDataFrame([("01999000102", 10), ("02001000200", 20), ("77777000300", 30), ("01999000400", 5)], "stcotr_code string, emp_tot_17 long")
    disclosure = spark.createDataFrame([(y, t, 5.0) for y in (2013, 2014, 2015) for t in ("01999000102", "02001000200", "77777000300", None)],
                                       "year int, stcotr_code string, amt_tot double")
    lender = spark.createDataFrame([(y, t, "A", 1.0) for y in (2012, 2014, 2016, None) for t in ("01999000102", "77777000300", "01999000400")],
                                   "year int, stcotr_code string, purpose string, amt_tot double")
    zones = spark.createDataFrame([("01999000102", "z")], "stcotr_code string, stco_type string")
    whole = merge.analysis_master(merge.tract_master(employment, disclosure, lender, zones, ["A"]), county_metro, study)
    cut = merge.study_master(employment, disclosure, lender, zones, county_metro, study, ["A"])
    assert cut.columns == whole.columns and rows(cut) == rows(whole) and whole.count() > 2


@pytest.fixture
def county_metro(spark):
    return spark.createDataFrame([("01999", "Sample", 9, "10", "Ten"), ("02001", "Other", 8, "20", "Twenty")],
                                 "stco_code string, stco_name string, co_emp int, cbsa_code string, cbsa_name string")


def test_county_programs(spark, county_metro):
    exports = spark.createDataFrame(
        [(2014, "1", 10.0, 1.0), (2014, "2", 5.0, None), (2014, "9", 7.0, 7.0), (2015, "1", 1.0, 1.0)],
        "year int, unique_identifier string, amt_tot double, amt_small double")
    exporters = spark.createDataFrame([("1", "1999"), ("2", "01999")], "`Unique.Identifier` string, county14 string")
    got = rows(merge.exporters_by_county(exports, exporters, county_metro).select("stco_code", "year", "amt_tot", "amt_small", "cbsa_code"))
    assert got == [("01999", 2014, 15.0, None, "10"), ("01999", 2015, 1.0, 1.0, "10"), (None, 2014, 7.0, 7.0, None)]
    awards = spark.createDataFrame([("01999", 2014, 10.0, 1, 0), ("01999", 2014, 5.0, 0, None), ("77777", 2014, 2.0, 1, 1)],
                                   "stco_code string, year int, amt_tot double, gender int, disadv int")
    got = rows(merge.awards_by_county(awards, county_metro).select("stco_code", "amt_female", "amt_minority", "amt_tot", "cbsa_name"))
    assert got == [("01999", 10.0, None, 15.0, "Ten"), ("77777", 2.0, 2.0, 2.0, None)]


def test_program_average_is_strict(spark):
    df = spark.createDataFrame(
        [("10", "Ten", "a", 2014, 1.0, 1.0), ("10", "Ten", "a", 2015, 3.0, None), ("10", "Ten", None, 2015, 90.0, 1.0),
         ("10", "Ten", "a", 2013, 99.0, 1.0), ("99", "No", "a", 2014, 5.0, 5.0)],
        "cbsa_code string, cbsa_name string, stco_code string, year int, amt_tot double, amt_small double")
    got = merge.program_average(df, CBSA, "_EXIM", known_county=True)
    assert records(got) == [{"cbsa_code": "10", "cbsa_name": "Ten", "amt_tot_EXIM": 2.0, "amt_small_EXIM": None}]


def test_analysis_master(spark, county_metro):
    master = spark.createDataFrame(
        [("01999000102", 2014, 5, None), ("01999000102", 2013, 5, 1.0), ("01999000103", 2015, None, 1.0), ("02001000100", 2015, 1, 2.0),
         ("99999000100", 2015, 1, 2.0)],
        "stcotr_code string, year int, emp_tot_17 int, amt_tot_CDFI double")
    got = merge.analysis_master(master, county_metro, CBSA).select("stcotr_code", "year", "amt_tot_CDFI", "cbsa_name")
    assert rows(got) == [("01999000102", 2014, 0.0, "Ten"), ("02001000100", 2015, 2.0, "Twenty")]


# ---- gaps ----------------------------------------------------------------------


def tract_rows(spark):
    return spark.createDataFrame(
        [("10", "Ten", 100.0, 10, 4, "zone"), ("10", "Ten", 300.0, 10, 6, None), ("10", "Ten", 50.0, 0, 0, None),
         ("20", "Twenty", 100.0, 20, 5, None), ("20", "Twenty", None, 10, 10, None)],
        "cbsa_code string, cbsa_name string, amt_tot double, emp_tot_17 int, emp_black_17 int, stco_type string")


def test_per_worker_summary(spark):
    got = {r["cbsa_code"]: r for r in gaps.per_worker_summary(tract_rows(spark), "amt_tot", CBSA, "_FDIC").collect()}
    ten, twenty = got["10"], got["20"]
    assert (ten["amt_per_tot_FDIC"], ten["amt_per_black_FDIC"]) == (20.0, pytest.approx((10 * 4 + 30 * 6) / 10))
    assert (ten["emp_tot_17_sum_FDIC"], twenty["emp_tot_17_sum_FDIC"]) == (4.0, 6.0)
    assert (twenty["amt_per_tot_FDIC"], twenty["amt_per_black_FDIC"]) == (5.0, 5.0)  # the tract without an amount is skipped
    assert (ten["gap_amt_emp_FDIC"], twenty["gap_amt_emp_FDIC"]) == (0.0, 15.0 * 6)
    assert ten["gap_amt_emp_avg_FDIC"] + twenty["gap_amt_emp_avg_FDIC"] == pytest.approx(0)
    assert (ten["pct_amt_oz_FDIC"], ten["amt_per_oz_FDIC"], ten["amt_per_noz_FDIC"]) == (0.25, 10.0, 30.0)
    assert (twenty["pct_amt_oz_FDIC"], twenty["amt_per_oz_FDIC"]) == (None, None)
    assert twenty["amt_per_noz_FDIC"] == pytest.approx(100 / 30)
    split = gaps.zone_split(tract_rows(spark), "amt_tot", CBSA.keys)
    assert {(r["cbsa_code"], r["pct_amt_oz"]) for r in split.collect()} == {("10", 0.25), ("20", None)}


def test_products_by_category(spark):
    df = spark.createDataFrame([("10", "Ten", 10.0, 20.0, 30.0, 40.0, 50.0, 10)],
                               "cbsa_code string, cbsa_name string, amt_below100k double, amt_tot double, amt_MICRO double, "
                               "amt_other double, amt_tot_CDFI double, emp_tot_17 int")
    got = rows(gaps.per_worker_by_product(df, CBSA.keys).select("program", "amt_per_emp", "category"))
    assert got == [("amt_MICRO", 3.0, "CDFI"), ("amt_below100k", 1.0, "FDIC"), ("amt_other", 4.0, "others"), ("amt_tot", 2.0, "all"),
                   ("amt_tot_CDFI", 5.0, "all")]


def owners(spark):
    data = []
    for area, scale in (("10", 1.0), ("30", 2.0), ("99", 1.0)):
        for label, traded, local in ((gaps.ALL_FIRMS_LABEL, 40, 60), ("Female-owned", 10, 10 * scale), ("Male-owned", 20, 30), ("White", 20, 40),
                                     ("Black or African American", 4, 6), ("Hispanic", 2, 8), ("Minority", 8, 20), ("Nonminority", 30, 40),
                                     (gaps.DROPPED_LABEL, 5, 5)):
            data += [(area, f"Area {area}", label, "traded", float(traded), 1.0), (area, f"Area {area}", label, "local", float(local), 1.0)]
    data.append(data[0])  # an exact duplicate
    schema = "cbsa_code string, GEO_TTL string, label string, `is.traded` string, firmdemp double, firmall double"
    return spark.createDataFrame(data, schema)


def demographics(spark):
    return spark.createDataFrame([("10", 0.5, 0.4), ("30", 0.5, 0.4)], "cbsa_code string, female double, `Black or Hispanic` double")


def test_ownership(spark):
    summary = gaps.ownership_summary(owners(spark), demographics(spark), CBSA)
    got = {r["cbsa_code"]: r for r in summary.collect()}
    assert set(got) == {"10", "30"}
    ten, thirty = got["10"], got["30"]
    assert (ten["tot_firms"], ten["pct_traded"], ten["pct_female_all"], thirty["pct_female_all"]) == (100.0, 0.4, 0.2, 0.3)
    assert thirty["gap_female_peer"] == pytest.approx(0)
    assert ten["gap_female_peer"] == pytest.approx((0.6 * 0.5 - 0.2) * 100)
    assert ten["gap_female_peer_traded"] == pytest.approx(ten["gap_female_peer"] * 0.4)
    assert ten["gap_female_self"] == pytest.approx(30)
    assert ten["gap_hispanic_black_self"] == pytest.approx((0.4 - 0.1 - 0.1) * 100)
    assert (ten["gap_traded"], ten["gap_traded_avg"]) == (0.0, 0.0)
    assert summary.columns[:3] == ["cbsa_code", "GEO_TTL", "gap_female_peer"]


def test_owner_labels_and_contradictions(spark):
    more = spark.createDataFrame([("10", "Area 10", "Veteran-owned", "local", 3.0, 1.0)], owners(spark).schema)
    wide = {r["cbsa_code"]: r for r in gaps.clean_owners(owners(spark).union(more)).collect()}
    assert (wide["10"]["Veteran-owned_local"], wide["10"]["Veteran-owned_traded"], wide["30"]["Veteran-owned_local"]) == (3.0, None, None)
    other = spark.createDataFrame([("10", "Area 10", "White", "local", 8.0, 1.0)], owners(spark).schema)
    with pytest.raises(Exception, match="two values in one cell"):
        gaps.clean_owners(owners(spark).union(other)).collect()


def test_reports(spark):
    area = [("10", "Ten"), ("30", "Thirty")]
    attainment = spark.createDataFrame(
        [(int(a), 10, 20, 0, 0, 40, 50, 0, 0) for a, _ in area],
        "cbsa_code int, S1501_C01_033E long, S1501_C01_036E long, S1501_C01_042E long, S1501_C01_054E long, S1501_C01_032E long, "
        "S1501_C01_035E long, S1501_C01_041E long, S1501_C01_053E long")
    study = StudyConfig(area="cbsa", peers=("00010",), targets=("00030",))
    pad = F.lpad("cbsa_code", 5, "0")
    firms = owners(spark).withColumn("cbsa_code", pad)
    people = demographics(spark).withColumn("cbsa_code", pad)
    tracts = spark.createDataFrame(
        [(f"000{a}", n, float(amt), 10, 5, 5, 5, 5, z) for (a, n), amt, z in ((area[0], 100, "z"), (area[0], 300, None), (area[1], 800, None))],
        "cbsa_code string, cbsa_name string, amt_tot double, emp_tot_17 int, emp_white_17 int, emp_black_17 int, emp_male_17 int, "
        "emp_female_17 int, stco_type string")
    county = spark.createDataFrame(
        [("00010", "Ten", "c", 2014, 100.0, 10.0, 40.0, 20.0), ("00030", "Thirty", "c", 2014, 400.0, 10.0, 40.0, 20.0)],
        "cbsa_code string, cbsa_name string, stco_code string, year int, amt_tot double, amt_small double, amt_woman double, amt_minority double")
    combined = gaps.combine_summaries(
        gaps.attainment_summary(attainment, study),
        gaps.ownership_summary(firms, people, study),
        gaps.per_worker_summary(tracts, "amt_tot", study, "_FDIC"),
        gaps.per_worker_summary(tracts, "amt_tot", study, "_CDFI"),
        merge.program_average(county, study, "_EXIM"),
        merge.program_average(county.withColumnRenamed("amt_woman", "amt_female").drop("amt_small"), study, "_SSTR"),
        study,
    )
    peers = {r["cbsa_code"]: r for r in gaps.peer_gap_report(combined).collect()}
    assert peers["00010"]["gap_amt_traded_EXIM"] == pytest.approx((10.0 - 2.5) * 40)
    assert peers["00030"]["gap_amt_traded_EXIM"] == 0.0
    assert peers["00010"]["gap_amt_traded_SSTR_avg"] == pytest.approx((6.25 - 2.5) * 40)
    # firms per worker: 100 / 4 and 100 / 2
    assert peers["00010"]["gap_allfirms_emp"] == 100.0 and peers["00010"]["emp_tot"] == 4.0
    assert peers["00030"]["gap_allfirms_emp"] == 0.0
    some = combined.withColumn("amt_tot_SSTR", F.when(F.col("cbsa_code") == "00010", F.col("amt_tot_SSTR")))
    strict = {r["cbsa_code"]: r for r in gaps.peer_gap_report(some, gaps.REPORT_MODES).collect()}["00010"]
    skipping = {r["cbsa_code"]: r for r in gaps.peer_gap_report(some).collect()}["00010"]
    assert (strict["gap_amt_traded_SSTR"], strict["gap_amt_traded_SSTR_avg"], strict["gap_amt_traded_EXIM"]) == (None, 0.0, 300.0)
    assert (skipping["gap_amt_traded_SSTR"], skipping["gap_allfirms_emp"]) == (0.0, strict["gap_allfirms_emp"])
    demo = {r["cbsa_code"]: r for r in gaps.demographic_gap_report(combined).collect()}["00010"]
    assert demo["gap_FDIC_white_black"] == 0.0 and demo["gap_FDIC_oz"] == 20.0
    assert demo["gap_EXIM_white_nonwhite"] == pytest.approx(20 / 8 - 80 / 30)
    assert demo["gap_SSTR_male_female"] == pytest.approx(40 / 10 - 60 / 20)
    assert demo["gap_hsplus_all_white_black"] == pytest.approx((100 * 0.6 / 40 - 100 * 0.1 / 50) * 50)
    assert demo["gap_baplus_traded_white_black"] == pytest.approx((20 / 10 - 4 / 20) * 20)


def test_program_shares(spark):
    df = spark.createDataFrame([(10.0, 5.0, 2.0, 1.0, 4.0), (0.0, 0.0, 0.0, 0.0, 0.0)],
                               "amt_tot double, amt_small double, amt_woman double, amt_minority double, amt_female double")
    assert rows(gaps.export_shares(df).select("pct_small", "pct_woman", "pct_minority")) == [(0.5, 0.2, 0.1), (None, None, None)]
    assert rows(gaps.award_shares(df).select("pct_female", "pct_minority")) == [(0.4, 0.1), (None, None)]


# ---- panel ---------------------------------------------------------------------


def test_panel_and_growth(spark):
    schema = "year int, cbsa_code string, stco_code string, city string"
    awards = spark.createDataFrame(
        [(2013, "M", "C", "x", 10.0), (2013, "M", "D", "y", None), (2017, "M", "C", "x", 160.0), (2012, "M", "C", "x", 99.0), (2013, None, None, None, 5.0)],
        schema + ", `Award Amount` double")
    loans = spark.createDataFrame(
        [(2013, "M", "C", "x", "7A", 10.0), (2013, "M", "D", "x", "7A", None), (2013, "M", "C", "y", "504", 6.0)],
        schema + ", Program string, GrossApproval double")
    tracts = spark.createDataFrame(
        [(2013, "M", "C", "y", 10.0, 2, 4.0, 0, None, None), (2013, "M", "D", "y", 20.0, 3, None, None, 6.0, 3)],
        schema + ", amt_tot double, n_tot int, amt_stot double, n_stot int, amt_tot_CDFI double, n_tot_CDFI int")
    levels = panel.geo_levels(F.col("city") == "x", "M", "C")
    result = panel.program_panel((awards, levels), (loans, levels), (tracts, levels), (2013, 2018))
    got = {(r["geo"], r["Program"], r["measure"], r["year"]): r["value"] for r in result.collect()}
    assert got[("metro", "SBIR", "total", 2013)] == 10.0 and got[("metro", "SBIR", "mean", 2013)] == 10.0
    assert got[("metro", "SBA 7A", "total", 2013)] is None  # one missing amount spoils the sum
    assert got[("county", "SBA 7A", "total", 2013)] == 10.0 and got[("city", "SBA 7A", "total", 2013)] is None
    assert got[("metro", "FDIC", "total", 2013)] == 30.0 and got[("metro", "FDIC", "mean", 2013)] == 6.0
    assert got[("county", "FDICsmall", "mean", 2013)] is None and got[("metro", "CDFI", "mean", 2013)] == 2.0
    assert ("city", "FDIC", "total", 2013) not in got and not any(k[3] == 2012 for k in got)
    growth = {(r["geo"], r["Program"], r["measure"]): r for r in panel.growth_rate(result, 2013, 2017).collect()}
    assert growth[("county", "SBIR", "total")]["CAGR_13_17"] == pytest.approx(1.0)
    assert growth[("metro", "FDIC", "total")]["CAGR_13_17"] is None
    assert growth[("county", "SBIR", "total")]["2014"] is None


def test_member_panel(spark):
    loans = spark.createDataFrame(
        [("a", 2013, "SBIR", None, 10.0), ("b", 2013, "SBIR", None, None), ("a", 2013, "SBA", "7A", 10.0), ("b", 2013, "SBA", "7A", None),
         ("c", 2013, "SBA", "504", 6.0), ("a", 2012, "SBIR", None, 99.0), (None, 2013, "SBIR", None, 5.0)],
        "stcotr_code string, year int, type string, Program string, amount double")
    tracts = spark.createDataFrame(
        [("a", 2013, 10.0, 2, 4.0, 0, None, None), ("b", 2013, 20.0, 3, None, None, None, None), ("b", 2013, None, None, None, None, 6.0, 3)],
        "stcotr_code string, year int, amt_tot double, n_tot int, amt_stot double, n_stot int, amt_tot_CDFI double, n_tot_CDFI int")
    pairs = spark.createDataFrame([("a", "M"), ("b", "M"), ("b", "M"), ("a", "C"), ("c", "X"), ("z", "Z"), (None, "M"), ("a", None)], "stcotr_code string, geo string")
    members = panel.membership_of_pairs(pairs, "stcotr_code", "geo")
    result = panel.member_panel(loans, tracts, members, (2013, 2018)).collect()
    got = {(r["geo"], r["Program"], r["measure"], r["year"]): r["value"] for r in result}
    assert len(got) == len(result) and not any(k[3] == 2012 or k[0] == "Z" for k in got)
    assert got[("M", "SBIR", "total", 2013)] == 10.0 and got[("M", "SBIR", "mean", 2013)] == 10.0
    assert got[("M", "SBA 7A", "total", 2013)] is None and got[("M", "SBA 7A", "mean", 2013)] is None
    assert got[("C", "SBA 7A", "total", 2013)] == 10.0 and got[("X", "SBA 504", "mean", 2013)] == 6.0
    assert got[("M", "FDIC", "total", 2013)] == 30.0 and got[("M", "FDIC", "mean", 2013)] == 6.0
    assert got[("C", "FDICsmall", "mean", 2013)] is None and got[("M", "CDFI", "mean", 2013)] == 2.0 and got[("C", "CDFI", "total", 2013)] == 0.0


def test_thousands_of_levels(spark):
    loans = spark.range(4000).selectExpr("cast(id AS string) AS stcotr_code", "2015 AS year", "'SBIR' AS type", "cast(null AS string) AS Program", "1.0D AS amount")
    tracts = spark.createDataFrame([], "stcotr_code string, year int, amt_tot double, n_tot int, amt_stot double, n_stot int, amt_tot_CDFI double, n_tot_CDFI int")
    pairs = spark.range(4000).selectExpr("cast(id AS string) AS stcotr_code", "explode(array(concat('g', id % 3000), 'all')) AS geo")
    result = panel.member_panel(loans, tracts, panel.membership_of_pairs(pairs, "stcotr_code", "geo"), (2015, 2015)).filter("measure = 'total'")
    got = {r["geo"]: r["value"] for r in result.collect()}
    assert len(got) == 3001 and got["all"] == 4000.0 and got["g0"] == 2.0 and got["g2999"] == 1.0


def test_sums_by_level_equal_one_scan_per_level(spark):
    df = spark.range(200).select((F.col("id") % 5).alias("year"), (F.col("id") % 3).alias("a"), (F.col("id") % 7).alias("v"))
    levels = {"low": F.col("a") <= 1, "zero": F.col("a") == 0, "never": F.col("a") > 9}
    together = panel.sums_by_level(df, levels, ["year"], {"v": "v"})
    apart = [r for name, p in levels.items() for r in rows(
        df.filter(p).groupBy("year").agg(F.sum("v"), F.count("v"), F.count(F.lit(1))).select(F.lit(name), "*"))]
    assert sorted(rows(together)) == sorted(apart)
