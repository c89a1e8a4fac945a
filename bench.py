"""Headline queries timed on the benchmark tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from longview.session import local_session  # noqa: E402
from workload import load  # noqa: E402

HEADLINE = [
    "a1_sum", "a4_weighted_mean", "a7_within_series_range", "a10_daily_rollup", "a12_densify",
    "a13_histogram", "a16_boxplot", "a24_pivot_mean", "c1_difference_from_base", "c5_difference_from_total",
    "c8_chained_comparisons", "j2_value_map", "p1_filter_in_lists", "t6_top_n_series", "t9_equal_number_breakpoints",
    "w3_running_sum_any_size", "w8_stack_levels", "w11_top_rows_per_group", "w13_share_of_partition",
    "d3_annualized_cost", "d16_value_factors", "d17_competitiveness", "r5_hourly_profile", "r9_slice_energy", "r18_new_purchases",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus, "20g")
    queries = load()[0]
    # Start-up cost of the JVM and of code generation is not part of a query.
    queries["a1_sum"](spark, sf).write.format("noop").mode("overwrite").save()
    times = {"cold": {}, "warm": {}}
    for run in times:
        for name in names:
            t = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            times[run][name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline_query_seconds_warm", "value": round(sum(times["warm"].values()), 3), "unit": "sec",
                      "queries": times["warm"], "cold_queries": times["cold"], "cold_value": round(sum(times["cold"].values()), 3),
                      "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
