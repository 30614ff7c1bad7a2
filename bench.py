"""Times the headline queries on ``$BENCH_SF_DIR`` and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from stratagrid.plans.registry import QUERIES
from stratagrid.session import local_session

HEADLINE = [
    "sc01_bars", "wk01_rolling_mean", "wk04_rolling_quantile", "wt03_moving_averages", "wt07_bollinger", "wt15_position_20", "wt17_trend_20", "wt04_05_24_recursive", "technical_all", "cx01_date_wise_z", "cx06_rank_normal", "cx15_daily_rank_ic",
    "cx18_quintiles", "flagship", "jn01_event_channel", "jn04_state_channel", "jn06_as_of", "jn10_member_flag", "wo28_outlier_clip", "wo37_targets", "wo35_36_eligibility", "ag01_block_days", "ag09_daily_stats", "pf06_15_contract", "ud05_06_risk",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "16g", 8)
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    QUERIES["sc01_bars"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the workers
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
