import pytest
from pyspark.sql import functions as F

from remitspark.operators.history import add_prior_rates, prior_rate
from remitspark.operators.relational import asof_backward, same_bag


def frame(spark, data):
    return spark.createDataFrame(data, "i int, d string, k string, y int").withColumn("d", F.to_date("d"))


def test_embargoed_counts_and_raw_rate(spark):
    df = frame(spark, [(1, "2024-01-01", "A", 1), (2, "2024-01-01", "A", 0), (3, "2024-03-01", "A", 1), (4, "2024-06-01", "A", 0)])
    out = {r["i"]: r for r in prior_rate(df, "d", "y", "k", embargo_days=60).collect()}
    assert [out[i]["prior_count"] for i in (1, 2, 3, 4)] == [0, 0, 2, 3]
    assert out[1]["prior_raw_rate"] is None and out[2]["prior_raw_rate"] is None
    assert out[3]["prior_raw_rate"] == 0.5 and out[4]["prior_raw_rate"] == pytest.approx(2 / 3)


def test_same_day_rows_do_not_see_each_other(spark):
    df = frame(spark, [(1, "2024-01-10", "A", 1), (2, "2024-01-10", "A", 0), (3, "2024-01-11", "A", 0)])
    out = prior_rate(df, "d", "y", "k", embargo_days=1).orderBy("i").collect()
    assert [r["prior_count"] for r in out] == [0, 0, 2]


def test_zero_embargo_is_refused(spark):
    with pytest.raises(ValueError):
        prior_rate(frame(spark, [(1, "2024-01-10", "A", 1)]), "d", "y", "k", embargo_days=0)


def test_longer_embargo_sees_less(spark):
    df = frame(spark, [(1, "2024-01-01", "A", 1), (2, "2024-02-01", "A", 0), (3, "2024-03-01", "A", 0)])
    counts = lambda e: [r["prior_count"] for r in prior_rate(df, "d", "y", "k", embargo_days=e).orderBy("i").collect()]
    assert counts(1) == [0, 1, 2]
    assert counts(60) == [0, 0, 1]


def test_no_book_history_gives_null_and_new_entity_gets_book_rate(spark):
    df = frame(spark, [(1, "2024-01-01", "A", 1), (2, "2024-01-02", "A", 0), (3, "2024-06-01", "NEW", 0), (4, "2024-06-01", None, 1)])
    out = {r["i"]: r for r in add_prior_rates(df, "d", "y", {"k": "k"}).collect()}
    assert out[1]["k_prior_rate"] is None
    assert out[3]["k_prior_rate"] == pytest.approx(0.5) and out[3]["k_prior_count"] == 0
    # a null entity has no history of its own
    assert out[4]["k_prior_rate"] == pytest.approx(0.5) and out[4]["k_prior_count"] == 0


def test_null_outcomes_add_no_history(spark):
    df = frame(spark, [(1, "2024-01-01", "A", None), (2, "2024-01-02", "A", 1), (3, "2024-06-01", "A", 0)])
    out = {r["i"]: r for r in prior_rate(df, "d", "y", "k").collect()}
    assert out[3]["prior_count"] == 1 and out[3]["prior_raw_rate"] == 1.0


def test_unkeyed_rate_shrinks_to_itself(spark):
    df = frame(spark, [(1, "2024-01-01", "A", 1), (2, "2024-01-02", "B", 0), (3, "2024-06-01", "A", 0)])
    out = {r["i"]: r for r in prior_rate(df, "d", "y", None).collect()}
    assert out[3]["prior_rate"] == pytest.approx(0.5)


def test_future_rows_do_not_move_the_past(spark):
    data = [(i, f"2024-{1 + i % 9:02d}-{1 + i % 27:02d}", "AB"[i % 2], i % 3 % 2) for i in range(60)]
    df = frame(spark, data)
    cut = "d < '2024-06-01'"
    scrambled = df.withColumn("y", F.expr("if(d >= '2024-06-01', 1 - y, y)"))
    a = add_prior_rates(df, "d", "y", {"k": "k"}).where(cut)
    b = add_prior_rates(scrambled, "d", "y", {"k": "k"}).where(cut)
    assert same_bag(a, b)


def test_asof_takes_latest_value_at_or_before_the_lagged_day(spark):
    left = spark.createDataFrame([("a", 10), ("a", 4), ("b", 10), (None, 10)], "k string, t int")
    right = spark.createDataFrame([("a", 1, 1.0), ("a", 5, 2.0), ("a", 9, 3.0)], "k string, s int, v double")
    got = {(r["k"], r["t"]): r["v"] for r in asof_backward(left, right, "k", "t", "s", ["v"], 1).collect()}
    assert got == {("a", 10): 3.0, ("a", 4): 1.0, ("b", 10): None, (None, 10): None}
