"""Missing values, zero denominators, text, codes and dates, row by row."""

import pytest
from pyspark.sql import functions as F

from capital_access.functions import columns as cols
from capital_access.functions import dates, nulls, text
from tests.conftest import rows


@pytest.mark.parametrize(
    "value, expected",
    [(" 0000012", 12.0), ("   ", None), ("1,000", None), ("abc", None), ("", None), (None, None), ("NaN", None), ("1.5", 1.5)],
)
def test_to_number_never_fails(one, value, expected):
    assert one((value,), "x string", nulls.to_number("x")) == (expected,)


@pytest.mark.parametrize("value, expected", [("2014", 2014), ("2014.0", 2014), ("2014.7", 2014), ("-3.9", -3), ("x", None), ("", None), (None, None), ("1e99", None)])
def test_to_integer_cuts_decimals(one, value, expected):
    assert one((value,), "x string", nulls.to_integer("x")) == (expected,)


def test_ratio_of_zero_denominator_is_missing(one):
    got = one((1.0, 0.0, 0), "a double, b double, c int", nulls.ratio("a", "b"), nulls.ratio("b", "c"), nulls.ratio("c", "a"))
    assert got == (None, None, 0.0)


def test_aggregates_in_both_modes(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0), ("c", None)], "k string, x double")
    got = df.groupBy("k").agg(
        nulls.sum_of("x"), nulls.sum_of("x", False), nulls.mean_of("x"), nulls.mean_of("x", False),
        nulls.max_of("x"), nulls.max_of("x", False),
    )
    assert rows(got) == [
        ("a", 1.0, None, 1.0, None, 1.0, None),
        ("b", 6.0, 6.0, 3.0, 3.0, 4.0, 4.0),
        ("c", 0.0, None, None, None, None, None),
    ]


def test_sum_of_no_rows_is_zero(spark):
    empty = spark.createDataFrame([], "x double")
    assert empty.agg(nulls.sum_of("x"), nulls.sum_of("x", False), nulls.money_sum("x")).first()[:] == (0.0, 0.0, 0.0)


@pytest.mark.parametrize(
    "pairs, skipping, strict",
    [
        ([(1.0, 1.0), (3.0, 3.0)], 2.5, 2.5),
        ([(None, 5.0), (3.0, 3.0)], 3.0, None),  # a missing measure is skipped or spoils
        ([(None, 0.0), (3.0, 3.0)], 3.0, 3.0),  # but never with weight zero
        ([(1.0, None), (3.0, 3.0)], None, None),  # a missing weight always spoils
        ([(None, None), (3.0, 3.0)], 3.0, None),  # unless its measure is skipped
        ([(1.0, 0.0), (3.0, 0.0)], None, None),  # no weight at all
        ([(None, 1.0)], None, None),
    ],
)
def test_weighted_mean(spark, pairs, skipping, strict):
    df = spark.createDataFrame(pairs, "x double, w double")
    got = df.agg(nulls.weighted_mean("x", "w"), nulls.weighted_mean("x", "w", na_rm=False)).first()
    assert tuple(got) == (skipping, strict)


def test_money_sum_is_exact_in_any_order(spark):
    amounts = [(0.1,), (1e9 + 0.2,), (0.3,), (-1e9,)] * 1000
    df = spark.createDataFrame(amounts, "x double")
    assert df.agg(nulls.money_sum("x")).first()[0] == 600.0
    assert df.orderBy(F.desc("x")).repartition(7).agg(nulls.money_sum("x")).first()[0] == 600.0


def test_lists_and_missing_values(spark):
    df = spark.createDataFrame([("60",), ("01",), (None,)], "st string")
    assert rows(df.filter(nulls.not_in("st", ["60", "61"]))) == [("01",), (None,)]
    assert rows(df.filter(nulls.is_in("st", ["60", "61"]))) == [("60",)]


@pytest.mark.parametrize(
    "value, width, expected", [("7", 5, "00007"), ("123456", 5, "123456"), ("12345", 5, "12345"), (None, 5, None), ("", 2, "00")]
)
def test_pad_code_never_shortens(one, value, width, expected):
    assert one((value,), "x string", text.pad_code("x", width)) == (expected,)


def test_trim_removes_all_kinds_of_blanks(one):
    assert one((" \t x y\r\n",), "x string", text.trim_ws("x")) == ("x y",)


@pytest.mark.parametrize("value, expected", [("a.b.c", "a-b.c"), ("abc", "abc"), ("a\nb.c", "a\nb-c"), (None, None), (".", "-")])
def test_replace_first_replaces_once(one, value, expected):
    assert one((value,), "x string", text.replace_first("x", r"\.", "-")) == (expected,)


def test_place_and_county_spellings_meet(one):
    schema = "a string, b string, c string, d string"
    got = one(
        (" Saint Paul\t", "Saint Louis ", "St. Louis MO", "Saint Joseph"), schema,
        text.place_label("a"), text.county_label("b", F.lit("MO")), text.county_label("c"),
        text.county_label("d", F.lit("IN")),
    )
    assert got == ("st. paul", "ST. LOUIS MO", "ST. LOUIS MO", "ST. JOSEPH IN")


@pytest.mark.parametrize(
    "name, expected",
    [
        ("St Joseph IN", "ST. JOSEPH IN"), ("Bedford VA (R)", "BEDFORD VA"), ("Orleans Parish LA", "ORLEANS LA"),
        ("Juneau Borough AK", "JUNEAU AK"), ("Cook IL", "COOK IL"),
    ],
)
def test_county_rules(one, name, expected):
    assert one((name,), "x string", text.county_label("x")) == (expected,)


def test_name_parts(one):
    got = one(("total_FDIC..x",), "x string", *[text.name_part("x", i) for i in range(4)])
    assert got == ("total", "FDIC", "x", None)


@pytest.mark.parametrize(
    "value, year",
    [("05-January-17", 2017), ("05-JAN-17", 2017), ("5-january-17", 2017), ("05-January-75", 1975), ("05-January-69", 1969),
     ("05-January-68", 2068), ("31-February-17", None), ("unknown", None), (None, None)],
)
def test_text_dates(one, value, year):
    assert one((value,), "x string", dates.month_date_year("x")) == (year,)


@pytest.mark.parametrize(
    "value, origin, year",
    [("42734", "1900-01-01", 2017), ("42734", "1899-12-30", 2016), ("January 2017", "1900-01-01", 2017), ("x", "1900-01-01", None),
     (None, "1900-01-01", None), ("42000.7", "1900-01-01", 2014), ("9e20", "1900-01-01", None)],
)
def test_day_serials(one, value, origin, year):
    assert one((value,), "x string", dates.serial_year("x", origin)) == (year,)


def test_column_choices(spark):
    df = spark.createDataFrame([(1, 2.0, "x", 3.0, None)], "id int, AMT_a double, Code string, amt_b double, `is.x` string")
    assert cols.containing(df, "amt_") == ["AMT_a", "amt_b"]
    assert cols.matching(df, "^code|_b$") == ["Code", "amt_b"]
    assert cols.numeric(df) == ["id", "AMT_a", "amt_b"]
    assert cols.between_columns(df, "AMT_a", "amt_b") == ["AMT_a", "Code", "amt_b"]
    assert cols.pick(df, "is.x", cols.containing(df, "amt_"), rest=True).columns == ["is.x", "AMT_a", "amt_b", "id", "Code"]
    assert cols.suffixed(df, cols.containing(df, "amt"), "_X").columns == ["id", "AMT_a_X", "Code", "amt_b_X", "is.x"]
    assert cols.select_renamed(df, a="is.x", b="id").columns == ["a", "b"]
    scaled = cols.map_columns(df, cols.containing(df, "amt"), lambda c: c * 1000)
    assert scaled.first()[:] == (1, 2000.0, "x", 3000.0, None)


def test_row_sum_counts_missing_as_zero(one):
    assert one((1.0, None, 2.0), "a double, b double, c double", cols.row_sum(["a", "b", "c"])) == (3.0,)
