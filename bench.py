"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 8) the threads.
Every query writes all its rows to a sink that discards them; building the plan is part of the time.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from remitspark.plans.registry import all_queries
from remitspark.session import build_session

HEADLINE = (
    "exec_monthly", "root_cause", "ar_aging", "payer_perf", "provider_quality", "heuristic_queue", "dq_scorecard",
    "drift_monthly", "enriched_base", "contracts_quarantine", "fk_violations", "calendar_dim", "surrogate_dim",
    "slot_unpivot", "bag_diff", "prior_rates", "temporal_split", "pit_events", "event_log_build", "variants", "km",
    "chi2", "kruskal", "oe_funnel", "auc_ap_brier", "calibration", "threshold_cost", "work_queue_arrival",
    "month_queues", "rule_compare", "mi_dependency", "feature_auc",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cpus, **{"spark.sql.shuffle.partitions": cpus})
    queries = all_queries()
    # load the JVM's classes and compile its hot loops once, outside the timing
    for name in ("activity_shares", "exec_monthly", "heuristic_queue"):
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline query time, summed",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf.group(1)) if sf else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
