import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from remitspark.operators import workqueue as w
from remitspark.plans import queries_models
from remitspark.plans.roles import claims

E = w.Economics()
AS_OF = dt.date(2024, 6, 1)
SF = "/root/testdata/sf0.001"


def queue(spark, data, as_of="date'2024-06-01'", economics=E):
    """data: (claim, p, amount, days left, category)"""
    rows = [(c, p, a, AS_OF + dt.timedelta(days=left - 120), cat) for c, p, a, left, cat in data]
    df = spark.createDataFrame(rows, "claim_sk long, p double, amt double, review date, cat string")
    return w.work_queue(df, "claim_sk", "p", "amt", "review", "cat", economics, as_of)


def test_deadline_outranks_money(spark):
    q = queue(spark, [(1, 0.9, 500_000.0, 119, "OTHER"), (2, 0.9, 200.0, 3, "OTHER")])
    assert [r["claim_sk"] for r in q.orderBy("queue_position").collect()] == [2, 1]


def test_expired_rows_stay_and_are_marked(spark):
    q = {r["claim_sk"]: r["tier"] for r in queue(spark, [(1, 0.9, 9e9, -1, "MEDICAL_NECESSITY"), (2, 0.5, 900.0, 60, "OTHER")]).collect()}
    assert q == {1: "EXPIRED", 2: "VALUE"}


def test_below_cost_only_downgrades_value(spark):
    q = {r["claim_sk"]: r["tier"] for r in queue(
        spark, [(1, 0.1, 10.0, 60, "OTHER"), (2, 0.1, 10.0, 60, "MEDICAL_NECESSITY"), (3, 0.1, 10.0, 5, "OTHER"), (4, 0.1, 10.0, -9, "OTHER")]
    ).collect()}
    assert q == {1: "BELOW_COST", 2: "MANDATORY_REVIEW", 3: "DEADLINE_CRITICAL", 4: "EXPIRED"}


def test_cost_moves_the_cut_but_not_the_order(spark):
    data = [(i, 0.5, float(100 * i), 60, "OTHER") for i in range(1, 9)]
    order = lambda cost: [r["claim_sk"] for r in queue(spark, data, economics=w.Economics(processing_cost=cost)).orderBy("queue_position").collect()]
    assert order(10.0) == order(300.0)


def test_arrival_mode_gives_the_whole_window(spark):
    q = queue(spark, [(1, 0.9, 500.0, -400, "OTHER"), (2, 0.9, 500.0, 3, "OTHER")], as_of=None)
    assert {r["sim_days_to_deadline"] for r in q.collect()} == {120}
    assert q.first()["as_of"] == AS_OF + dt.timedelta(days=3 - 120)


def test_random_queues_keep_the_tier_guarantee(spark):
    random.seed(2)
    data = [
        (i, random.random(), random.uniform(1, 1e6), random.randint(-30, 120), random.choice(["OTHER", "MEDICAL_NECESSITY"]))
        for i in range(3000)
    ]
    q = queue(spark, data)
    assert w.outranked_tiers(q).isEmpty()
    assert q.agg(F.max("queue_position"), F.countDistinct("queue_position")).first() == (3000, 3000)
    broken = q.withColumn("queue_position", F.expr("3001 - queue_position"))
    assert not w.outranked_tiers(broken).isEmpty()


def test_recovery_ratio(spark):
    df = spark.createDataFrame([(80.0, 100.0, True), (0.0, 100.0, False), (30.0, 50.0, True), (5.0, 0.0, True)], "r double, d double, won boolean")
    assert w.recovery_ratio(df, "r", "d", "won") == pytest.approx(0.7)
    with pytest.raises(ValueError):
        w.recovery_ratio(df.where("not won"), "r", "d", "won")


def test_monthly_snapshots_follow_the_open_interval(spark):
    df = spark.createDataFrame(
        [(1, 0.9, 500.0, dt.date(2024, 1, 15), "OTHER"), (2, 0.9, 500.0, dt.date(2024, 3, 1), "OTHER"), (3, 0.9, 500.0, dt.date(2024, 8, 2), "OTHER")],
        "claim_sk long, p double, amt double, review date, cat string",
    )
    rows = w.monthly_queue_rows(df, "claim_sk", "p", "amt", "review", "cat", E)
    got = {(r["claim_sk"], str(r["as_of"])[:7]) for r in rows.collect()}
    assert got == {(1, "2024-02"), (1, "2024-03"), (1, "2024-04"), (1, "2024-05"), (2, "2024-03"), (2, "2024-04"), (2, "2024-05"), (2, "2024-06")}
    pressure = {r["tier"]: (r["appearances"], r["claims"]) for r in w.deadline_pressure(rows, "claim_sk").collect()}
    assert sum(v[0] for v in pressure.values()) == 8 and pressure["DEADLINE_CRITICAL"] == (1, 1)


def test_paging_and_tier_filter(spark):
    q = queue(spark, [(i, 0.9, 100.0 * i, 60, "OTHER") for i in range(1, 8)])
    assert [r["claim_sk"] for r in w.page(q, 2, 2, "value").collect()] == [5, 4]
    assert {r["tier"]: r["n"] for r in w.empty_tiers(q).collect()}["EXPIRED"] == 0


def test_probability_sources(spark):
    req = spark.createDataFrame([(1, "A", 0.9), (2, "A", None), (3, "A", None), (4, "Z", None)], "k long, c string, given double")
    shipped = spark.createDataFrame([(2, 0.4)], "k long, p_shipped double")
    rates = spark.createDataFrame([("A", 0.2), ("B", 0.6)], "c string, p_category double")
    got = {r["k"]: (r["probability"], r["probability_source"]) for r in w.resolve_probability(req, shipped, rates, "k", "c", "given").collect()}
    assert got == {1: (0.9, "caller"), 2: (0.4, "shipped_score"), 3: (0.2, "category_rule"), 4: (pytest.approx(0.4), "book_rate")}


def test_every_denied_claim_is_asked_in_every_way(spark):
    rows = queries_models.probability_source(spark, SF)
    denied = claims(spark, SF).where("sim_denial_flag").count()
    got = {(r["asked"], r["probability_source"]): r["count"] for r in rows.groupBy("asked", "probability_source").count().collect()}
    assert denied > 0 and got == {("estimate", "caller"): denied, ("claim", "shipped_score"): denied, ("category", "category_rule"): denied, ("neither", "book_rate"): denied}


def test_rules_share_ties_and_capacity(spark):
    df = spark.range(100).selectExpr("id as k", "cast(id as double) as dollars")
    got = {r["rule"]: r for r in w.compare_rules(df, "k", {"best": "dollars", "flat": "0D"}, "dollars", 0.1).collect()}
    assert got["best"]["worked"] == got["flat"]["worked"] == 10
    assert got["best"]["share"] == pytest.approx(sum(range(90, 100)) / sum(range(100)))
