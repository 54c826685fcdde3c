"""List what each query's physical plan contains that may not scale.

usage: python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from remitspark.plans.registry import all_queries  # noqa: E402
from remitspark.session import build_session  # noqa: E402

WATCHED = ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition", "Python", "MapInPandas", "BroadcastExchange", "Exchange hash", "Exchange range")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = build_session("plans", 8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    for name, query in all_queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        df = query(spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        found = {w: len(re.findall(w, plan)) for w in WATCHED if w in plan}
        scans = len(re.findall("FileScan parquet", plan))
        print(f"{name:22s} scans {scans:2d} {found}", flush=True)


if __name__ == "__main__":
    main()
