"""Joins, aggregates, reshaping, matching and overlap on small tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from capital_access.config import StudyConfig, select_codes
from capital_access.operators import aggregates, joins, matching, quality, reshape, spatial
from capital_access.operators import rows as row_ops
from tests.conftest import rows


def test_missing_keys_match_only_when_asked(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("z", 3)], "k string, x int")
    right = spark.createDataFrame([("a", 10), (None, 20), ("b", 30)], "k string, y int")
    assert rows(joins.left_join(left, right, "k")) == [("a", 1, 10), ("z", 3, None), (None, 2, None)]
    assert rows(joins.null_safe_join(left, right, "k")) == [("a", 1, 10), ("z", 3, None), (None, 2, 20)]
    plain = [("a", 1, 10), ("b", None, 30), ("z", 3, None), (None, 2, None), (None, None, 20)]
    assert rows(joins.full_join(left, right, "k")) == plain
    assert rows(joins.full_join(left, right, "k")) == rows(left.join(right, ["k"], "full"))
    assert rows(joins.full_join_many(left, right, "k")) == plain
    twice = left.union(left), right.union(right)
    assert rows(joins.full_join_many(*twice, "k")) == rows(twice[0].join(twice[1], ["k"], "full"))
    safe = [("a", 1, 10), ("b", None, 30), ("z", 3, None), (None, 2, 20)]
    assert rows(joins.null_safe_full_join(left, right, "k")) == safe
    assert rows(joins.null_safe_join(left, right, "k", "full")) == safe


def test_left_join_from_dim_equals_left_join(spark):
    dim = spark.createDataFrame([(k, f"d{k}") for k in range(6)] + [(None, "none")], "k int, name string")
    facts = spark.createDataFrame([(0, i) for i in range(50)] + [(3, 1), (3, 2), (9, 9), (None, 5)], "k int, v int")
    assert rows(joins.left_join_from_dim(dim, facts, "k")) == rows(dim.join(facts, ["k"], "left"))


def test_natural_join_and_suffixes(spark):
    left = spark.createDataFrame([(1, "a", 5)], "k int, name string, x int")
    right = spark.createDataFrame([(1, "b", 6)], "k int, name string, y int")
    assert joins.shared_names(left, right) == ["k", "name"]
    assert rows(joins.natural_left_join(left, right)) == [(1, "a", 5, None)]
    joined = joins.join_with_suffixes(left, right, "k")
    assert joined.columns == ["k", "name_x", "x", "name_y", "y"]
    with pytest.raises(ValueError):
        joins.natural_left_join(left.select("x"), right.select("y"))


def test_unmatched_keeps_missing_keys(spark):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    right = spark.createDataFrame([("a",), (None,)], "k string")
    assert rows(joins.unmatched(left, right, "k")) == [("b",), (None,)]
    assert rows(joins.keep_matching(left, right, "k")) == [("a",)]


def test_codes_of_a_study(spark):
    xwalk = spark.createDataFrame([("1", "A"), ("2", "A"), ("3", "B"), (None, "A")], "stco_code string, cbsa_code string")
    picked = select_codes(xwalk, "stco_code", F.col("cbsa_code") == "A", ["2"])
    assert rows(picked) == [("1",), (None,)]
    study = StudyConfig(area="stco", peers=("1", "2"), targets=("2", "3"))
    assert study.compared == ["1", "2", "3"] and study.keys == ["stco_code", "stco_name"]
    assert StudyConfig(peers=("1",), targets=("3",), include_targets=False).compared == ["1"]
    assert rows(xwalk.filter(study.in_area()).select("stco_code")) == [("1",), ("2",), ("3",)]


def test_top_with_ties_keeps_every_tie(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 9.0, 1), ("a", 2.0, 1.0, 2), ("a", 2.0, 3.0, 3), ("a", 2.0, 3.0, 4), ("b", None, 5.0, 5),
         (None, 1.0, 1.0, 6), (None, 1.0, None, 7), ("c", 1.0, None, 8)],
        "k string, f double, g double, id int",
    )
    assert [r[3] for r in rows(row_ops.top_with_ties(df, ["k"], ["f", "g"]))] == [3, 4, 6]
    assert sorted(r[3] for r in rows(row_ops.top_with_ties(df, ["k"], ["f"]))) == [2, 3, 4, 6, 7, 8]


def test_bind_and_difference(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "i int, s string")
    b = spark.createDataFrame([(2, None)], "i int, s string")
    assert rows(row_ops.bind_rows(a, b.drop("s"))) == [(1, "x"), (1, "x"), (2, None), (2, None)]
    assert rows(row_ops.set_difference(a, b)) == [(1, "x")]
    assert rows(row_ops.bind_common([a, b], ["i"])) == [(1,), (1,), (2,), (2,)]


@pytest.mark.parametrize("values", [
    [5.0], [1.0, 2.0], [3.0] * 10, [-5.0, -1.0, 0.0, 0.0, 2.5, 1e12], [float(i * i % 97) - 40 for i in range(501)],
    [random.Random(1).lognormvariate(0, 5) for _ in range(300)],
])
def test_quantiles_are_exact(spark, values):
    import numpy as np

    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["p"]: r["value"] for r in aggregates.quantiles(df, "x", ps).collect()}
    assert got == pytest.approx({p: float(np.quantile(values, p)) for p in ps}, rel=1e-12, abs=1e-12)


def test_six_numbers(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)] + [(None,), (float("nan"),)], "x double")
    assert aggregates.six_numbers(df, "x").first()[:] == (1.0, 2.0, 3.0, 3.0, 4.0, 5.0, 2)
    empty = aggregates.six_numbers(df.filter("x IS NULL OR isnan(x)"), "x").first()
    assert empty[:] == (None, None, None, None, None, None, 2)


@pytest.mark.parametrize("at_once", [50, 100_000])
def test_quantiles_of_close_values_and_infinities(spark, monkeypatch, at_once):
    monkeypatch.setattr(aggregates, "_RANKED_AT_ONCE", at_once)
    rng = random.Random(3)
    close = [1000 + rng.random() * 5 for _ in range(3000)] + [1002.5] * 500 + [-7.0, 0.0]
    inf = float("inf")
    for values in (close, [inf, -inf, 1.0, 2.0, inf], [inf] * 3, [5e-324, 1e308, -1e308]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
        ordered = sorted(values)
        got = {r.p: r.value for r in aggregates.quantiles(df, "x", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
        for p, value in got.items():
            at = (len(ordered) - 1) * p
            low, high = ordered[int(at)], ordered[min(int(at) + (at % 1 > 0), len(ordered) - 1)]
            assert value == (low if low == high else pytest.approx(low + (high - low) * (at % 1)))
        six = aggregates.six_numbers(df, "x").first()
        assert (six["min"], six["max"], six["n_missing"]) == (ordered[0], ordered[-1], 1)


def test_gaps_to_peers(spark):
    df = spark.createDataFrame([("a", 1.0, 10.0), ("b", 3.0, 30.0), ("c", None, 5.0)], "k string, rate double, w double")
    got = {r["k"]: (r["g"], r["g_avg"]) for r in aggregates.compare_to_peers(df, {"g": ("rate", "w")}).collect()}
    assert got == {"a": (20.0, 15.0), "b": (0.0, -15.0), "c": (None, None)}
    assert sum(v[1] for v in got.values() if v[1] is not None) == pytest.approx(0)
    strict = aggregates.compare_to_peers(df, {"g": ("rate", "w", False, False)})
    assert {(r["g"], r["g_avg"]) for r in strict.collect()} == {(None, None)}


def test_roll_up_is_strict_by_default(spark):
    df = spark.createDataFrame([("0100", 1), ("0199", 2), ("0200", None), ("0201", 4)], "code string, n int")
    assert rows(aggregates.roll_up_code(df, "code", 2, ["n"], "st")) == [("01", 3), ("02", None)]


def test_widen_names_and_empty_cells(spark):
    df = spark.createDataFrame([("t1", "a", 1.0), ("t1", None, 2.0), ("t2", "a", None), ("t2", "b", 3.0)], "k string, p string, v double")
    assert reshape.column_names(reshape.vocabulary(df, "p")) == ["NA", "a", "b"]
    many = spark.range(600).select(F.concat(F.lit("n"), "id").alias("p"))
    assert len(reshape.column_names(reshape.vocabulary(many, "p"))) == 600
    wide = reshape.widen(df, ["k"], "p", ["a", "b", "NA"], "v", rest=None, prefix="amt_")
    assert wide.columns == ["k", "amt_a", "amt_b", "amt_NA"]
    assert rows(wide) == [("t1", 1.0, None, 2.0), ("t2", None, 3.0, None)]
    rest = reshape.widen(df, ["k"], "p", ["a"], "v", rest="rest", prefix="amt_")
    assert rows(rest) == [("t1", 1.0, 2.0), ("t2", None, 3.0)] and rest.columns == ["k", "amt_a", "amt_rest"]
    both = reshape.widen(df, ["k"], ["k", "p"], ["t1_a", "t2_b"], {"s": "v", "t": F.col("v") * 2}, rest=None)
    assert both.columns == ["k", "s_t1_a", "s_t2_b", "t_t1_a", "t_t2_b"]


def test_widen_without_a_list_of_names(spark):
    from capital_access.plans.gaps import _only_value
    df = spark.createDataFrame([("x", "a", 1.0), ("x", "a", 2.0), ("x", None, 5.0), ("y", "b", None), (None, "b", 4.0)], "k string, p string, v double")
    wide = reshape.widen_open(df, ["k"], "p", "v")
    assert {r["k"]: r["cells"] for r in wide.collect()} == {"x": {"NA": 5.0, "a": 3.0}, "y": {"b": None}, None: {"b": 4.0}}
    assert {r["k"]: r["b"] for r in wide.select("k", reshape.cell("b").alias("b")).collect()} == {"x": None, "y": None, None: 4.0}
    assert reshape.widen_open(df.where("false"), ["k"], "p", "v").collect() == []
    with pytest.raises(Exception, match="two values in one cell"):
        reshape.widen_open(df, ["k"], "p", "v", _only_value).collect()
    many = spark.range(200_000).select((F.col("id") % 2).alias("k"), F.concat(F.lit("n"), F.col("id") % 100_000).alias("p"), F.lit(1).alias("v"))
    open_ = reshape.widen_open(many, ["k"], "p", "v").select("k", F.size("cells").alias("n"), reshape.cell("n7").alias("c")).collect()
    assert sorted(map(tuple, open_)) == [(0, 50_000, None), (1, 50_000, 2)]



def test_lengthen_keeps_missing_values(spark):
    df = spark.createDataFrame([("a", 1, None)], "k string, x int, y double")
    assert rows(reshape.lengthen(df, ["x", "y"])) == [("a", "x", 1.0), ("a", "y", None)]


# ---- matching ------------------------------------------------------------------


@pytest.fixture
def crosswalks(spark):
    place_county = spark.createDataFrame(
        [
            ("st. paul", "Minnesota", "27123", 0.9, 1.0), ("st. paul", "Minnesota", "27003", 0.1, 1.0),
            ("tied", "Ohio", "39001", 0.5, 0.5), ("tied", "Ohio", "39003", 0.5, 0.5), ("tied", "Ohio", "39005", 0.5, 0.4),
            ("whole", "Ohio", "39007", None, None), ("whole", "Ohio", "39009", 0.99, 1.0),
            ("nowhere", "Ohio", None, 1.0, 1.0),
        ],
        "pl_label string, st_name string, stco_code string, afact1 double, afact2 double",
    )
    county_metro = spark.createDataFrame(
        [("27123", "33460", "Twin Cities", 100), ("39001", "17140", "Cincinnati", 50), ("39003", "17140", "Cincinnati", 50)],
        "stco_code string, cbsa_code string, cbsa_name string, cbsa_pop int",
    )
    facts = spark.createDataFrame(
        [(1, "Saint Paul ", "Minnesota"), (2, "Tied", "Ohio"), (3, "Whole", "Ohio"), (4, "Nowhere", "Ohio"), (5, None, "Ohio"),
         (6, "Saint Paul ", "Minnesota")],
        "id int, city_name string, region_name string",
    )
    return facts, place_county, county_metro


def test_places_match_their_main_county(crosswalks):
    facts, place_county, _ = crosswalks
    places = matching.place_keys(facts)
    found = matching.match_places(places, place_county)
    assert sorted(r["stco_code"] for r in found.matched.collect()) == ["27123", "39001", "39003", "39007"]
    assert rows(found.unmatched.select("city_name")) == [("Nowhere",), (None,)]
    first = matching.match_places(places, place_county, on_ties="min_code")
    assert sorted(r["stco_code"] for r in first.matched.collect()) == ["27123", "39001", "39007"]
    assert places.count() == first.matched.count() + first.unmatched.count()


def test_facts_get_county_and_metro(crosswalks):
    got = rows(matching.locate_by_place(*crosswalks).select("id", "stco_code", "cbsa_code"))
    assert got == [
        (1, "27123", "33460"), (2, "39001", "17140"), (2, "39003", "17140"), (3, "39007", None), (4, None, None),
        (5, None, None), (6, "27123", "33460"),
    ]


def test_dictionary_resolves_only_new_places(spark, crosswalks, tmp_path):
    facts, place_county, county_metro = crosswalks
    root = f"file://{tmp_path}/places"
    columns = ["id", "stco_code", "cbsa_code"]

    def located(some, counties=place_county, on_ties="all"):
        return rows(matching.locate_with_dictionary(some, counties, county_metro, root, on_ties).select(*columns))

    def files():
        return sorted(str(p) for p in tmp_path.rglob("*.parquet"))

    whole = rows(matching.locate_by_place(*crosswalks).select(*columns))
    assert located(facts.where("id < 3")) == [r for r in whole if r[0] < 3]
    first = files()
    assert located(facts) == whole and set(first) < set(files())  # the first answers stay, new ones are added
    second = files()
    assert located(facts.union(facts.limit(0))) == whole and files() == second  # nothing is left to resolve
    assert located(facts.limit(0)) == [] and files() == second
    assert [r[1] for r in located(facts, on_ties="min_code") if r[0] == 2] == ["39001"]
    # The same places appended once more, as by two runs side by side, are read once.
    folder = next(p for p in (tmp_path / "places").iterdir() if p.name.startswith("all-"))
    spark.createDataFrame(spark.read.parquet(f"file://{folder}").collect(), spark.read.parquet(f"file://{folder}").schema).write.mode(
        "append").parquet(f"file://{folder}")
    assert located(facts) == whole
    # Another crosswalk has a dictionary of its own.
    moved = place_county.withColumn("stco_code", F.regexp_replace("stco_code", "^27123$", "27125"))
    assert [r[1] for r in located(facts, moved) if r[0] == 1] == ["27125"]
    assert located(facts) == whole


def test_version_of_content(spark):
    schema = "a string, b string"
    one = spark.createDataFrame([("x", None), ("y", "z")], schema)
    assert matching.content_version(one) == matching.content_version(one.orderBy(F.col("a").desc()))
    others = [[(None, "x"), ("y", "z")], [("x", None)], [("x", None), ("y", "z"), ("y", "z")], [("x", ""), ("y", "z")], []]
    versions = [matching.content_version(spark.createDataFrame(o, schema)) for o in others]
    versions += [matching.content_version(one), matching.content_version(one.toDF("a", "c"))]
    assert len(set(versions)) == len(versions)


def test_counties_match_by_name(spark):
    counties = spark.createDataFrame(
        [("29510", "St. Louis MO"), ("18141", "St. Joseph IN"), ("22071", "Orleans Parish LA"), ("51019", "Bedford VA (R)"), ("29510", "St. Louis MO")],
        "stco_code string, stco_name string",
    )
    facts = spark.createDataFrame(
        [(1, "SAINT LOUIS", "MO"), (2, "st joseph \t", "IN"), (3, "ORLEANS", "LA"), (4, "Bedford", "VA"), (5, "Unknown", "XX"), (6, "Saint Joseph", "IN")],
        "id int, ProjectCounty string, ProjectState string",
    )
    got = matching.locate_by_county_name(facts, counties, "ProjectCounty", "ProjectState").select("id", "stco_code")
    assert rows(got) == [(1, "29510"), (2, "18141"), (3, "22071"), (4, "51019"), (5, None), (6, "18141")]


# ---- overlap -------------------------------------------------------------------


def test_rectangles_against_brute_force(spark):
    rng = random.Random(7)

    def boxes(n, size):
        out = []
        for i in range(n):
            x, y = rng.randrange(-200, 200) / 10, rng.randrange(-200, 200) / 10
            out.append((i, x, y, x + rng.randrange(0, size) / 10, y + rng.randrange(0, size) / 10))
        return out

    a, b = boxes(120, 30), boxes(40, 120)
    def table(data):
        df = spark.createDataFrame(data, "id int, x0 double, y0 double, x1 double, y1 double")
        return df.select("id", spatial.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("ring"))

    left, right = table(a).withColumnRenamed("id", "l"), table(b).withColumnRenamed("id", "r")
    expected = sorted(
        (p[0], q[0]) for p, q in itertools.product(a, b)
        if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]
    )
    for cell in (1.0, 7.5):
        got = spatial.overlap_join(left, right, "l", "r", cell=cell)
        assert sorted(tuple(r) for r in got.collect()) == expected


def test_polygons_meet(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    shapes = {
        "inside": [(1, 1), (2, 1), (2, 2)], "around": [(-9, -9), (20, -9), (20, 20), (-9, 20)], "corner": [(4, 4), (6, 5), (6, 6)],
        "cross": [(-1, 2), (5, 2), (5, 2.5), (-1, 2.5)], "beside": [(5, 0), (6, 0), (6, 4)], "box_only": [(3, 6), (6, 3), (6, 6)],
        "edge": [(4, 1), (6, 1), (6, 2), (4, 2)],
    }
    ring = "array<struct<x:double,y:double>>"
    def as_rows(named):
        return [(n, [(float(x), float(y)) for x, y in points]) for n, points in named.items()]

    left = spark.createDataFrame(as_rows(shapes), f"name string, ring {ring}")
    right = spark.createDataFrame(as_rows({"sq": square}), f"city string, ring {ring}")
    got = rows(spatial.ids_overlapping(left, right, "name", "city", cell=2.0))
    assert [g[0] for g in got] == ["around", "corner", "cross", "edge", "inside"]


def test_parts_and_holes_against_points(spark):
    """Unions of cells with holes, against comparing the cells themselves."""
    def box(x, y, w, h):
        return [(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + h)), (float(x), float(y + h))]

    frame = [box(0, 0, 10, 10), box(2, 2, 6, 6)]  # a square with a square hole
    shapes = {
        "in_hole": [box(4, 4, 1, 1)], "in_frame": [box(0.5, 0.5, 1, 1)], "over_both": [box(4, 4, 30, 1)], "around": [box(-50, -50, 200, 200)],
        "far": [box(40, 40, 1, 1)], "two_parts": [box(40, 40, 1, 1), box(1, 1, 0.5, 0.5)], "touches_hole": [box(2, 3, 1, 1)],
        "around_hole_in_hole": [box(2.5, 2.5, 5, 5), box(3, 3, 4, 4)], "huge_frame": [box(-500, -500, 1000, 1000), box(-1, -1, 12, 12)],
        "part_in_huge": [box(-300, -300, 1, 1), box(5, 5, 0.1, 0.1)],
    }
    kind = "array<array<struct<x:double,y:double>>>"
    left = spark.createDataFrame(list(shapes.items()), f"name string, ring {kind}")
    right = spark.createDataFrame([("frame", frame)], f"city string, ring {kind}")
    expected = ["around", "in_frame", "over_both", "touches_hole", "two_parts"]
    for cell in (0.5, 3.0, 1000.0):
        assert [r[0] for r in rows(spatial.ids_overlapping(left, right, "name", "city", cell=cell))] == expected
        assert rows(spatial.overlap_join(left, right, "name", "city", cell=cell).select("name")) == [(n,) for n in expected]
    assert spatial.overlap_join(left.where("false"), right, "name", "city").collect() == []


# ---- accounting ----------------------------------------------------------------


def test_step_accounting(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int")
    steps = [("distinct", [a], a.distinct()), ("union", [a, b], a.union(b)), ("difference", [a], row_ops.set_difference(a, b)),
             ("aggregate", [a], a.groupBy("x").count()), ("empty", [a.where("false")], b.where("false"))]
    assert rows(quality.step_accounting(steps)) == [
        (1, "distinct", 3, 2, 1), (2, "union", 5, 5, 0), (3, "difference", 3, 1, 2), (4, "aggregate", 3, 2, 1), (5, "empty", 0, 0, 0)]


def test_row_accounting(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "a")], "x int, k string")
    steps = quality.filter_accounting(df, [("big", F.col("x") > 1), ("is a", F.col("k") == "a")])
    assert [tuple(r) for r in steps.orderBy("position").collect()] == [(1, "big", 4, 3, 1), (2, "is a", 3, 1, 2)]
    dim = spark.createDataFrame([("a",), ("a",), ("c",)], "k string")
    assert quality.join_accounting(df, dim, ["k"], "j").first()[:] == ("j", 4, 2, 2, 6)
    assert rows(quality.by_year(df.withColumnRenamed("x", "year"), "k")) == [(1, 1), (3, 1), (4, 1)]
