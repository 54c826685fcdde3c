import datetime as dt

import pytest
from pyspark.sql import functions as F

from remitspark.operators import splits


def dated(spark, days):
    return spark.createDataFrame([(d,) for d in days], "d date")


def test_cut_date_stays_on_one_side(spark):
    df = dated(spark, [dt.date(2024, 1, 1)] * 40 + [dt.date(2024, 6, 1)] * 10)
    out = splits.temporal_split(df, "d", 0.8)
    assert out.groupBy("d").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()
    assert out.where("fold = 'test'").count() == 10


def test_quantile_matches_linear_interpolation(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(1000)]
    cut = splits.date_cuts(dated(spark, days), "d", [0.8])[0]
    assert cut == dt.date(2020, 1, 1) + dt.timedelta(days=799)


def test_nulls_and_empty_folds_are_errors(spark):
    with pytest.raises(ValueError):
        splits.temporal_split(spark.createDataFrame([(None,), (dt.date(2024, 1, 1),)], "d date"), "d")
    with pytest.raises(ValueError):
        splits.temporal_split(dated(spark, [dt.date(2024, 1, 1)] * 5), "d")
    with pytest.raises(ValueError):
        splits.temporal_split(dated(spark, [dt.date(2024, 1, 1)]), "d", 1.0)


def test_nested_folds_are_in_time_order(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(500)]
    out = splits.nested_split(dated(spark, days), "d")
    ends = {r["fold"]: (r["first_date"], r["last_date"], r["fold_rows"]) for r in splits.split_evidence(out, "d").collect()}
    assert ends["fit"][1] < ends["calibrate"][0] and ends["calibrate"][1] < ends["test"][0]
    assert sum(v[2] for v in ends.values()) == 500


def test_forward_folds_expand_and_never_look_ahead(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(100)]
    out = splits.forward_folds(dated(spark, days), "d")
    per = out.groupBy("fold_no").pivot("role", ["train", "validate"]).agg(F.min("d"), F.max("d"), F.count("d")).collect()
    assert len(per) == 4
    for r in per:
        assert r["train_max(d)"] < r["validate_min(d)"]
    sizes = [r["train_count(d)"] for r in sorted(per, key=lambda r: r["fold_no"])]
    assert sizes == sorted(sizes) and sizes[0] < sizes[-1]


def test_trespass_counts_late_train_rows(spark):
    df = spark.createDataFrame([(1, "train"), (5, "train"), (3, "test"), (4, "test")], "d int, fold string")
    row = splits.temporal_trespass(df, "d").first()
    assert (row["trespassers"], row["train_rows"]) == (1, 2)
