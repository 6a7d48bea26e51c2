"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from twinside.plans import registry
from twinside.session import drop_work, local_session

HEADLINE = (
    "A_02_season_side_profile",
    "A_03_both_profile_levels",
    "A_06_form_last_n",
    "A_09_standings",
    "A_10_latest_rolling",
    "A_11_distribution",
    "A_12_threshold_rates",
    "W_03_season_means",
    "W_05_rolling_means",
    "W_08_table_before_day",
    "W_12_league_last20",
    "W_16_feature_table",
    "A_20_fixture_features",
    "U_08_reciprocal_pairs",
    "M_13_walk_forward_baseline",
    "M_14_brier",
    "L_03_settle_selections",
    "Q_02_season_patterns",
    "Q_08_matched_patterns",
    "Q_10_ranked_patterns",
    "L_02_archive_points",
    "M_08_total_over",
    "W_01_rows_before",
    "W_18_run_lengths",
)


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    registry.queries["A_02_season_side_profile"](spark, root).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in HEADLINE:
        start = time.time()
        registry.queries[name](spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    sf = os.path.basename(root.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    drop_work(spark)
    spark.stop()


if __name__ == "__main__":
    main()
