import random

import pytest

from remitspark.operators import modeling
from remitspark.operators.scoring import ScoringModel
from remitspark.sources import sinks

SPEC = modeling.FeatureSpec(("amount", "days"), ("late",), ("payer",))


def fitted(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, rng.random() * 100]), float(rng.randrange(30)), rng.random() < 0.3, rng.choice("ab") if i % 50 else f"rare{i}") for i in range(600)]
    rows = [(*r, int(rng.random() < (0.7 if r[3] else 0.3))) for r in rows]
    df = spark.createDataFrame(rows, "request_id long, amount double, days double, late boolean, payer string, y int")
    prep = modeling.fit_preprocessor(df, SPEC)
    ready = prep.transform(df)
    model = modeling.fit_logistic(ready, "y")
    raw = modeling.raw_scores(model, ready)
    return df, ScoringModel(prep, model, modeling.fit_calibrator(raw, "y"))


def test_a_reloaded_model_scores_as_the_fitted_one(spark, tmp_path):
    df, model = fitted(spark)
    model.save(str(tmp_path / "m"))
    model.save(str(tmp_path / "m"))  # over what is there
    again = ScoringModel.load(spark, str(tmp_path / "m"))
    a, b = ({r["request_id"]: r["probability"] for r in m.score(df.drop("y")).collect()} for m in (model, again))
    assert a == b and len(a) == 600 and len(set(a.values())) > 2
    ScoringModel(model.preprocessor, model.classifier).save(str(tmp_path / "raw"))
    assert ScoringModel.load(spark, str(tmp_path / "raw")).calibrator is None


def test_incomplete_requests_name_what_was_imputed(spark):
    _, model = fitted(spark)
    asked = spark.createDataFrame([(1, True, None), (2, None, "a"), (3, None, None), (4, False, "never seen")], "request_id long, late boolean, payer string")
    got = {r["request_id"]: r for r in model.score(asked).collect()}
    assert got[1]["supplied"] == ["late"] and got[1]["imputed"] == ["amount", "days", "payer"]
    assert (got[2]["supplied_count"], got[2]["imputed_count"]) == (1, 3)
    assert got[3]["supplied"] == [] and got[3]["probability"] is not None and got[3]["band"]
    assert got[4]["supplied"] == ["late", "payer"] and got[1]["probability"] > got[4]["probability"]
    assert model.score(asked.limit(0)).count() == 0


def test_unknown_names_are_an_error(spark):
    _, model = fitted(spark)
    with pytest.raises(ValueError, match="not declared inputs.*payr"):
        model.score(spark.createDataFrame([(1, "a")], "request_id long, payr string"))
    with pytest.raises(ValueError, match="request_id"):
        model.score(spark.createDataFrame([("a",)], "payer string"))


def test_point_lookup_pushes_its_key_and_skips_row_groups(spark, tmp_path):
    df = spark.range(200_000).selectExpr("id as k", "concat('CLM', lpad(cast(id * 7919 % 200000 as string), 10, '0')) as name", "md5(cast(id as string)) as body").repartition(3)
    path = str(tmp_path / "keyed")
    sinks.keyed_table(df, path, "name", files=4, group_bytes=1 << 16)
    found = spark.read.parquet(path).where("name = 'CLM0000000042'")
    assert [r["k"] * 7919 % 200000 for r in found.collect()] == [42]
    plan = found._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "PushedFilters: [IsNotNull(name), EqualTo(name,CLM0000000042)]" in text
    scan = plan
    while scan.children().size():
        scan = scan.children().apply(0)
    assert scan.metrics().apply("numOutputRows").value() < 20_000  # of 200,000: the other row groups were not read
    with pytest.raises(ValueError, match="no column"):
        sinks.keyed_table(df, path, "other")
