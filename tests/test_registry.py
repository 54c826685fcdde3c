import duckdb
import pytest

import __spark_entry__ as entry
from remitspark.plans import registry

SF = "/root/testdata/sf0.001"
# Iterative fits, resampling and hash fingerprints have no SQL form; they are tested on their own.
NO_SQL = {
    "fingerprint", "cox", "ph_check", "score_all", "model_metrics", "gbt", "training_run", "score_requests", "global_drivers", "linear_drivers", "driver_reasons", "bootstrap_ci",
}


def test_every_query_has_sql_or_is_listed():
    names, sql = set(registry.all_queries()), set(registry.all_sql())
    assert sql <= names
    assert names - sql == NO_SQL


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["exec_monthly", "ar_aging", "prior_rates", "work_queue_arrival", "auc_ap_brier", "hash_crosswalk"])
def test_queries_match_sql_on_the_smallest_tables(spark, name):
    from tools.check_oracle import canonical

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    mine = registry.all_queries()[name](spark, SF).toPandas()
    theirs = con.execute(registry.all_sql()[name]).df()
    assert canonical(mine) == canonical(theirs)


def test_line_scan_reads_only_what_a_view_needs(spark):
    plan = registry.all_queries()["auth_status"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "ReadSchema" in line and "l_orderkey" in line]
    assert scans and all(c not in s for s in scans for c in ("l_shipdate", "l_partkey", "l_extendedprice"))


def test_bag_difference_reads_only_its_columns(spark):
    plan = registry.all_queries()["bag_diff"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan and "l_extendedprice" not in plan
