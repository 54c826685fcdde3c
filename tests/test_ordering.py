import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from remitspark.operators import ordering as o


def test_positions_are_dense_even_when_one_value_holds_most_rows(spark):
    random.seed(7)
    data = [(i, 5 if i % 3 else random.randint(0, 100)) for i in range(2000)]
    df = spark.createDataFrame(data, "k int, v int").repartition(7)
    got = {r["k"]: r["p"] for r in o.with_position(df, ["v", "k"], "p").collect()}
    expected = {k: i + 1 for i, (v, k) in enumerate(sorted((v, k) for k, v in data))}
    assert got == expected


def test_hot_value_is_spread_over_partitions(spark):
    df = spark.range(4000).selectExpr("id as k", "if(id % 3 = 0, 1, 2) as v")
    parts = o.range_sorted(df, ["v", "k"], 8).groupBy("_part").count().collect()
    assert max(r["count"] for r in parts) < 4000 / 4


def test_running_totals_by_group(spark):
    data = [(g, i, i % 5) for g in ("a", "b", None) for i in range(50)]
    df = spark.createDataFrame(data, "g string, i int, x int")
    got = {(r["g"], r["i"]): r["s"] for r in o.running_totals(df, ["i", "g"], {"s": F.col("x")}, ["g"]).collect()}
    for g in ("a", "b", None):
        run = 0
        for i in range(50):
            run += i % 5
            assert got[(g, i)] == run


def test_exclusive_totals(spark):
    df = spark.range(10).selectExpr("id as i")
    got = {r["i"]: r["s"] for r in o.running_totals(df, ["i"], {"s": F.col("i")}, inclusive=False).collect()}
    assert got == {i: sum(range(i)) for i in range(10)}


def test_number_in_group(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 9), ("a", 2)], "g string, v int")
    assert {(r["g"], r["v"]): r["n"] for r in o.number_in_group(df, ["g"], ["v"], "n").collect()} == {
        ("a", 1): 1, ("a", 2): 2, ("a", 3): 3, ("b", 9): 1,
    }


def test_hot_and_null_groups_are_numbered_whole(spark):
    df = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'hot', if(id % 3 = 1, null, concat('g', id % 50))) as g").repartition(5)
    got = o.number_in_group(df, ["g"], ["id"], "n", 8)
    check = got.groupBy("g").agg(F.min("n"), F.max("n"), F.countDistinct("n"), F.count("n")).collect()
    assert sum(r["count(n)"] for r in check) == 3000
    assert all(r["min(n)"] == 1 and r["max(n)"] == r["count(n)"] == r["count(DISTINCT n)"] for r in check)


def test_mid_ranks(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (5,), (None,)], "v int")
    assert {r["v"]: r["mid_rank"] for r in o.mid_ranks(df, "v").collect()} == {1: 1.0, 2: 2.5, 5: 4.0}


@pytest.mark.parametrize("n,tiles", [(10, 4), (3, 4), (17, 5), (12, 4)])
def test_ntile_matches_the_window_function(spark, n, tiles):
    df = spark.range(1, n + 1).selectExpr("id", f"ntile({tiles}) over (order by id) as t", f"{o.ntile_of('id', str(n), tiles)} as u")
    assert df.where("t <> u").isEmpty()


@pytest.mark.parametrize("n", [17, 193, 1000, 4173])
@pytest.mark.parametrize("q", [5, 10])
def test_equal_count_bin_matches_quantile_cut(spark, n, q):
    import pandas as pd

    got = [r["b"] for r in spark.range(1, n + 1).selectExpr("id", f"{o.equal_count_bin('id', str(n), q)} as b").orderBy("id").collect()]
    want = pd.qcut(pd.Series(range(1, n + 1)), q, labels=False).tolist()
    assert got == want


def test_exact_quantiles_interpolate(spark):
    import numpy as np

    values = [float(v) for v in np.random.default_rng(3).normal(size=501)] + [0.25] * 300
    df = spark.createDataFrame([(v, "g" if i % 2 else "h") for i, v in enumerate(values)], "v double, g string")
    ps = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r["probability"]: r["quantile"] for r in o.exact_quantiles(df, "v", ps).collect()}
    for p in ps:
        assert got[p] == pytest.approx(float(np.quantile(values, p)), abs=1e-12)
    by = {(r["g"], r["probability"]): r["quantile"] for r in o.exact_quantiles(df, "v", [0.3], ["g"]).collect()}
    for g, par in (("g", 1), ("h", 0)):
        part = [v for i, v in enumerate(values) if i % 2 == par]
        assert by[(g, 0.3)] == pytest.approx(float(np.quantile(part, 0.3)), abs=1e-12)


def test_top_fraction_breaks_ties_by_hash_not_by_row_order(spark):
    df = spark.range(1000).selectExpr("id as k", "1.0D as s", "if(id < 100, 1, 0) as early")
    top = o.top_fraction_flag(df, "s", 0.1, "k", 1337).where("in_top")
    assert top.count() == 100
    assert top.agg(F.sum("early")).first()[0] < 30


def plain_pass(data):
    """(key: number, sum, decimal sum, sum of doubles) of every row, group by group."""
    out, run = {}, {}
    for g, k, x, d, f in sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        n, a, b, c = run.get(g, (0, 0, Decimal(0), 0.0))
        run[g] = (n + 1, a + (x or 0), b + (d or 0), c + f)
        out[k] = run[g]
    return out


@pytest.mark.parametrize("partitions", [1, 2, 9])
def test_one_pass_numbers_and_sums_hot_null_and_small_groups(spark, partitions):
    random.seed(partitions)
    data = [(random.choice(["hot", "hot", None, f"g{i % 40}"]), i, random.choice([i % 7, None]), Decimal(i) / 4 if i % 5 else None, i / 8) for i in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # runs go over batches too
    try:
        df = spark.createDataFrame(data, "g string, k int, x int, d decimal(12,2), f double").repartition(4)
        rows = o.sorted_pass(df, ["k"], {"xs": "x", "ds": "d", "fs": "f"}, ["g"], partitions).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["k"]: (r["_number"], r["xs"], r["ds"], r["fs"]) for r in rows} == plain_pass(data) and len(rows) == 3000


def test_a_sorted_pass_exchanges_the_rows_once(spark):
    df = spark.range(2000).selectExpr("id", "id % 5 as g")
    for out in (o.number_in_group(df, ["g"], ["id"], "n", 6), o.running_totals(df, ["id"], {"s": F.col("id")}, ["g"], 6)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        wide = [line for line in plan.splitlines() if "Exchange" in line and "hashpartitioning(_part" in line]
        assert not wide and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_sorted_pass_over_no_rows(spark):
    df = spark.createDataFrame([], "g string, k int, x int")
    assert o.sorted_pass(df, ["k"], {"xs": "x"}, ["g"], 3).count() == 0
    assert o.running_totals(df, ["k"], {"xs": F.col("x")}).count() == 0
