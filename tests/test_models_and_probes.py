import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from remitspark.operators import evaluation as e
from remitspark.operators import leakage, modeling


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    n = 3000
    x, z = rng.normal(5, 2, n), rng.normal(size=n)
    g = rng.choice(["a", "b", "c"], n, p=[0.6, 0.395, 0.005])
    flag = rng.integers(0, 2, n)
    logit = -1.5 + 0.5 * (x - 5) + 1.0 * (g == "b") + 0.4 * flag
    y = rng.uniform(size=n) < 1 / (1 + np.exp(-logit))
    rows = [
        (int(i), bool(y[i]), float(x[i]) if i % 10 else None, float(z[i]), bool(flag[i]), str(g[i]), ["fit", "calibrate", "test"][0 if i < 2000 else 1 if i < 2500 else 2])
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "k long, y boolean, x double, z double, flag boolean, g string, fold string").cache()


SPEC = modeling.FeatureSpec(numeric=("x", "z"), boolean=("flag",), categorical=("g",))


@pytest.fixture(scope="module")
def fitted(data):
    prep = modeling.fit_preprocessor(data.where("fold = 'fit'"), SPEC)
    ready = prep.transform(data).cache()
    return prep, ready, modeling.fit_logistic(ready.where("fold = 'fit'"), "y")


def test_preprocessing_learns_on_the_fit_fold(data, fitted):
    prep, ready, _ = fitted
    fit = [r["x"] for r in data.where("fold = 'fit'").collect()]
    present = [v for v in fit if v is not None]
    assert prep.medians["x"] == pytest.approx(float(np.median(present)))
    filled = [v if v is not None else prep.medians["x"] for v in fit]
    assert prep.scale["x"] == (pytest.approx(np.mean(filled)), pytest.approx(np.std(filled)))
    assert list(prep.indicators) == ["x"]
    levels = {r["level"] for r in prep.frequent.collect()}
    assert levels == {"a", "b"}
    assert len(prep.owners) == ready.first()["features"].size
    assert ready.count() == data.count()


def test_unseen_and_missing_levels_are_scored(spark, data, fitted):
    prep, _, model = fitted
    new = data.limit(1).withColumn("g", F.lit("never seen")).withColumn("x", F.lit(None).cast("double"))
    row = modeling.raw_scores(model, prep.transform(new)).first()
    assert 0 < row["score"] < 1


def test_model_beats_baselines_and_is_calibrated(data, fitted):
    _, ready, model = fitted
    raw = modeling.raw_scores(model, ready).drop("features")
    test = raw.where("fold = 'test'").selectExpr("cast(y as int) as y", "score")
    auc = e.ranking_metrics(test, "y", "score").first()["roc_auc"]
    base = modeling.base_rate_scores(data.where("fold = 'fit'"), data.where("fold = 'test'"), "y").selectExpr("cast(y as int) as y", "score")
    group = modeling.group_rate_scores(data.where("fold = 'fit'"), data.where("fold = 'test'"), "g", "y").selectExpr("cast(y as int) as y", "score")
    g_auc = e.ranking_metrics(group, "y", "score").first()["roc_auc"]
    assert e.ranking_metrics(base, "y", "score").first()["roc_auc"] == 0.5
    assert auc > g_auc > 0.5 and auc > 0.68
    for method in ("isotonic", "platt"):
        cal = modeling.fit_calibrator(raw.where("fold = 'calibrate'"), "y", method=method)
        out = modeling.calibrated(cal, raw)
        assert out.agg(F.min("probability_calibrated"), F.max("probability_calibrated")).first()[0] >= 0
    flagged = modeling.flag_top_quantile(raw, "score", "fold").where("fold = 'test' and top_decile").count()
    assert flagged == pytest.approx(50, abs=1)
    with pytest.raises(ValueError):
        modeling.fit_calibrator(raw, "y", method="nope")


def test_penalty_matches_the_scaled_objective(spark):
    """At the optimum the gradient of C * loss + |w|^2 / 2 is zero."""
    rng = np.random.default_rng(0)
    X = rng.normal(size=(300, 2))
    y = (rng.uniform(size=300) < 1 / (1 + np.exp(-X[:, 0]))).astype(int)
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.dense(v), int(t)) for v, t in zip(X, y)], ["features", "y"])
    m = modeling.fit_logistic(df, "y", c=1.0)
    w, b = m.coefficients.toArray(), m.intercept
    p = 1 / (1 + np.exp(-(X @ w + b)))
    assert np.abs(X.T @ (p - y) + w).max() < 0.05 and abs((p - y).sum()) < 0.05


def test_boosted_trees_learn(fitted):
    _, ready, _ = fitted
    m = modeling.fit_boosted(ready.where("fold = 'fit'"), "y", trees=5, depth=3)
    test = modeling.raw_scores(m, ready.where("fold = 'test'")).selectExpr("cast(y as int) as y", "score")
    assert e.ranking_metrics(test, "y", "score").first()["roc_auc"] > 0.62


def test_contributions_fold_to_declared_features(data, fitted):
    prep, ready, model = fitted
    rows = ready.where("fold = 'fit'")
    table = {r["feature"]: r for r in modeling.global_importance(model, rows, prep.owners).collect()}
    assert set(table) == {"x", "z", "flag", "g"} and sum(r["share"] for r in table.values()) == pytest.approx(1.0)
    assert table["x"]["importance"] > table["z"]["importance"] and table["x"]["sim_reason_code"] == "UNMAPPED"
    d = modeling.row_drivers(model, rows, prep.owners, "k", 2).where("k < 3").collect()
    assert {(r["k"], r["driver_rank"]) for r in d} == {(k, i) for k in range(3) for i in (1, 2)}
    by = {(r["k"], r["driver_rank"]): abs(r["contribution"]) for r in d}
    assert all(by[(k, 1)] >= by[(k, 2)] for k in range(3))
    x = np.array([r["features"].toArray() for r in rows.collect()])
    dev = np.abs((x - x.mean(0)) * model.coefficients.toArray()).mean(0)
    want = sum(v for v, o in zip(dev, prep.owners) if o == "g")
    assert table["g"]["importance"] == pytest.approx(want, rel=1e-9)
    assert modeling.reasons_among_top(modeling.row_drivers(model, rows, prep.owners, "k"), "k").count() == 1


def test_champion_and_stop_rule():
    assert modeling.champion({"b": 0.3, "a": 0.3, "c": 0.1}) == "a"
    modeling.check_plausible(0.7, 0.5)
    with pytest.raises(ValueError):
        modeling.check_plausible(0.9, 0.5)


# ---------------------------------------------------------------- probes


def test_renamed_and_rescaled_forbidden_columns_are_found(spark, data):
    df = data.withColumn("secret", F.expr("cast(k * 7919 % 1000 as double)")).withColumn("leak", F.expr("log1p(secret)")).withColumn(
        "copy", F.expr("cast(y as string)")
    )
    u = {(r["feature"], r["forbidden"]): r["u"] for r in leakage.dependency(df, ["z", "leak", "copy"], ["secret", "y"]).collect()}
    assert u[("leak", "secret")] > 0.9 and u[("copy", "y")] == pytest.approx(1.0)
    assert u[("z", "y")] < 0.02 and u[("z", "secret")] < 0.25


def test_missingness_is_a_level(spark, data):
    df = data.withColumn("hole", F.expr("if(y, 1.0D, null)"))
    u = leakage.dependency(df, ["hole"], ["y"]).first()["u"]
    assert u == pytest.approx(1.0)
    n = leakage.null_indicator_auc(df.withColumn("t", F.expr("cast(y as int)")), "t", ["hole", "z"])
    assert {r["feature"]: r["auc"] for r in n.collect()} == {"hole": 1.0, "z": 0.5}


def test_constant_feature_explains_nothing(spark, data):
    assert leakage.dependency(data.withColumn("c", F.lit(1)), ["c"], ["y"]).first()["u"] == 0.0


def test_row_keys_are_skipped_and_hidden_keys_found(spark, data):
    df = data.withColumn("hidden", F.expr("k * 2 + 1"))
    assert leakage.row_keys(df, ["k", "g", "z"]) == ["k", "z"]
    assert leakage.dependency(df, ["g"], ["k", "y"]).select("forbidden").collect()[0][0] == "y"
    assert [r["feature"] for r in leakage.identifier_findings(df, ["hidden", "z", "g"], "k").collect()] == ["hidden"]


def test_spearman(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 5)], "a int, b int")
    assert leakage.spearman(df, "a", "b").first()["rho"] == pytest.approx(-0.2)


def test_single_feature_auc(spark, data):
    df = data.withColumn("t", F.expr("cast(y as int)"))
    got = {r["feature"]: r["auc"] for r in leakage.feature_auc(df, "k", "t", ["x", "z"], ["g"]).collect()}
    assert got["x"] > 0.6 and got["z"] < 0.56 and 0.5 < got["g"] < 0.7
    assert leakage.label_findings(leakage.feature_auc(df.withColumn("l", F.expr("cast(y as double) + z / 1000")), "k", "t", ["l"]), 0.68).count() == 1


def test_cross_fitting_stops_memorised_categories(spark, data):
    df = data.withColumn("t", F.expr("cast(y as int)")).withColumn("id", F.expr("cast(k as string)"))
    auc = leakage.feature_auc(df, "k", "t", [], ["id"]).first()["auc"]
    assert auc < 0.6 and not math.isnan(auc)


def test_gbt_query_fits_the_declared_ensemble(spark, monkeypatch):
    import inspect

    from remitspark.plans import queries_models as qm

    real, got = inspect.signature(modeling.fit_boosted), {}

    class Fitted(Exception):
        pass

    def fit(*args, **options):
        bound = real.bind(*args, **options)
        bound.apply_defaults()
        got.update(bound.arguments)
        raise Fitted

    monkeypatch.setattr(qm.modeling, "fit_boosted", fit)
    monkeypatch.setattr(qm, "_matrix", lambda s, d: (None, None, s.createDataFrame([("fit",)], "fold string")))
    with pytest.raises(Fitted):
        qm.gbt(spark, "unused")
    assert got["trees"] == 300 == real.parameters["trees"].default


def test_pair_counts_as_counted_row_by_row(spark):
    import random
    from collections import Counter

    from remitspark.operators.leakage import pair_counts

    rng = random.Random(2)
    rows = [(rng.choice("abc"), str(rng.randrange(300)), rng.choice(["x", "hot", "hot"])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "a string, b string, c string").repartition(4)
    for held in (1 << 20, 10):
        got = {(r["pair"], r["x"], r["f"]): r["n"] for r in pair_counts(df, [("a", "c"), ("b", "a")], held).collect()}
        want = Counter((0, r[0], r[2]) for r in rows) + Counter((1, r[1], r[0]) for r in rows)
        assert got == dict(want)
    assert pair_counts(df.limit(0), [("a", "c")]).count() == 0


def test_few_levels_and_groups_shuffle_no_rows(spark, data):
    fit = data.where("fold = 'fit'")
    prep = modeling.fit_preprocessor(fit, SPEC)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (prep.transform(data), modeling.group_rate_scores(fit, data, "g", "y")):
            assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bootstrap_query_reads_the_lines_once(spark, monkeypatch):
    from remitspark.plans import queries_models as q

    made, ranked = [], []
    scored, auc = q.scored, e.bootstrap_auc
    monkeypatch.setattr(q, "scored", lambda *a, **k: made.append(1) or scored(*a, **k))
    monkeypatch.setattr(e, "bootstrap_auc", lambda *a, **k: ranked.append(a[2]) or auc(*a, **k))
    got = q.bootstrap_ci(spark, "/root/testdata/sf0.001")
    assert "lineitem" not in got._jdf.queryExecution().optimizedPlan().toString() and len(made) == 1
    assert sorted(ranked) == ["score", "score_b"]
    assert {r["metric"] for r in got.collect()} == {"auc", "auc_difference", "capture_difference"}
