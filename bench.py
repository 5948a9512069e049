"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelstats.session import local_session, stages  # noqa: E402

HEADLINE = [
    "q_ratio_top10", "q_pair_flags", "q_cond_sums", "q_adjusted_sums", "q_weighted_mean", "q_summary_median", "q_quantiles",
    "q_subgroup_sweep", "q_complete_panel", "q_crosswalk", "q_interpolate", "q_survey_mean", "q_survey_many", "q_survey_prop",
    "q_dissimilarity", "q_theil_h", "q_exposure", "q_dissimilarity_boot", "q_ols_fe_cluster", "q_ols_twoway", "q_ddd_saturated",
    "q_dd_controls", "q_ordered_logit", "q_mixed", "q_sim_ci", "q_combo_sweep", "q_placebo_sweep", "q_couples", "q_dyad_panel",
    "q_area_profiles", "q_count_panel_mixed",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    only = sys.argv[1:]
    spark = local_session("bench", cpus, **{"spark.ui.showConsoleProgress": "false"})
    from panelstats.catalog import QUERIES
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        with stages(spark):
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
