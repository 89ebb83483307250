"""Times the headline queries; prints one JSON line.

Each query is warmed up once and then timed ``BENCH_RUNS`` times (median), from
writing the plan to the last row.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from capital_access.queries import catalogue  # noqa: E402
from capital_access.session import build_session  # noqa: E402

HEADLINE = [
    "scan_multi_file_union", "scan_zip_members", "fixed_width_parse", "json_records_scan", "bundle_roundtrip",
    "left_join_dim", "full_outer_two_key", "null_safe_full_join", "star_join_summaries", "resolve_and_join_back",
    "place_match_best_factor", "county_name_match", "overlap_join_grid", "topn_with_ties_per_group", "set_difference",
    "agg_weighted_mean", "agg_many_cols_funcs", "agg_multi_weight_means", "describe_six_number",
    "rollup_code_prefix", "pivot_sum_prefix", "unpivot_pattern", "peer_gap", "peer_gap_avg",
    "disclosure_clean", "community_lender_clean", "employment_by_tract", "tract_master", "tract_master_hot_keys", "analysis_master",
    "county_program_merge", "ownership_gap", "per_worker_summary", "per_worker_by_product",
    "peer_gap_report", "demographic_gap_report", "geo_level_panel", "growth_rate",
]


def timed(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8,
                          **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
                             "spark.checkpoint.dir": f"file://{tempfile.mkdtemp(prefix='run-')}"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        timed(spark, sf_dir, name)
        seconds[name] = round(statistics.median(timed(spark, sf_dir, name) for _ in range(runs)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cores, "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
