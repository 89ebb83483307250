"""All queries against their SQL on the smallest tables, and the shape of their plans."""

import re

import pytest

import __spark_entry__ as entry_module
from capital_access.queries import catalogue
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_entry_points(spark):
    assert entry_module.entry(spark).columns == ["stco_code", "amt", "workers", "rate", "gap", "gap_avg"]
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    if name not in catalogue.ORACLES:
        assert catalogue.QUERIES[name](spark, SF).columns
        return
    assert difference(spark, duck, SF, catalogue.QUERIES[name], catalogue.ORACLES[name]) == ""


def executed(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["peer_gap", "peer_gap_avg", "tract_master", "tract_master_hot_keys", "per_worker_summary",
                                  "topn_with_ties_per_group", "place_match_best_factor", "resolve_and_join_back", "geo_level_panel",
                                  "overlap_join_grid", "ownership_gap", "full_join_hot_side"])
def test_no_cross_join_and_no_unkeyed_window(spark, name):
    plan = executed(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Window" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = executed(spark, "filter_between_years")
    assert "GreaterThanOrEqual(o_orderdate" in plan
    assert re.search(r"ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string>", plan)
    plan = executed(spark, "agg_ratio_of_sums")
    assert "ReadSchema: struct<l_linenumber:int,l_quantity:double,l_extendedprice:double>" in plan


def test_aggregates_are_reduced_before_their_shuffle(spark):
    for name in ("agg_weighted_mean", "agg_multi_weight_means", "pivot_sum_prefix", "distinct_keys"):
        plan = executed(spark, name)
        assert plan.index("Exchange hashpartitioning") < plan.rindex("HashAggregate(")


def scans(plan, name):
    return plan.count(f"/{name}.parquet]")


def test_study_filters_are_below_the_merge(spark):
    plan = executed(spark, "analysis_master")
    merged = plan.index("FullOuter")
    assert plan.index("o_orderdate", merged) and "GreaterThanOrEqual(o_orderdate,1997-01-01" in plan[merged:]
    assert re.search(r"substring\(.*\) IN \(", plan[merged:]) or "INSET" in plan[merged:]
    assert "GreaterThanOrEqual(l_shipdate,1996-01-01" in plan


def test_hot_key_merge_scans_the_facts_no_more_often(spark):
    once, hot = (executed(spark, name) for name in ("tract_master", "tract_master_hot_keys"))
    assert scans(hot, "lineitem") <= scans(once, "lineitem") == 2


def test_panel_years_reach_the_scans(spark):
    plan = executed(spark, "geo_level_panel")
    # Two scans have dates: the loans of all programs, and the loans of disclosed lines.
    assert len(re.findall(r"o_orderdate#\d+ < 2001-01-01", plan)) == 2 and scans(plan, "lineitem") == 2


def test_panel_reads_each_program_once(spark):
    for name in ("geo_level_panel", "growth_rate", "program_panel"):
        plan = executed(spark, name)
        # orders: the loans, the keys of disclosed lines, the keys of employment; customer beside each of these and beside the lender's events
        assert scans(plan, "orders") == 3 and scans(plan, "customer") == 4 and scans(plan, "events") == 1
