import random

import pytest
from pyspark.ml.linalg import Vectors

from remitspark.operators import modeling, training


def ready(spark, n=900, leak=False):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        x = rng.random()
        y = int(rng.random() < 0.2 + 0.5 * x)
        rows.append((i, ("fit", "fit", "fit", "calibrate", "test")[i * 5 // n], bool(y), Vectors.dense([float(y) if leak else x, rng.random()])))
    return spark.createDataFrame(rows, ["claim_sk", "fold", "y", "features"])


def candidates(c=1.0):
    return {"weak": lambda x: modeling.fit_logistic(x, "y", c=1e-2), "strong": lambda x: modeling.fit_logistic(x, "y", c=c), "trees": lambda x: modeling.fit_boosted(x, "y", trees=3)}


def test_champion_is_chosen_on_the_calibration_fold(spark):
    base = ready(spark).selectExpr("claim_sk", "fold", "y", "0.5D as score")
    run = training.train(ready(spark), "y", candidates(), baselines={"half": base})
    report = {(r["model"], r["variant"], r["fold"]): r for r in training.run_report(run).collect()}
    assert len(report) == 3 * 3 * 2 + 2
    best = max(("strong", "trees", "weak"), key=lambda m: report[m, "raw", "calibrate"]["pr_auc"])
    assert report[run.champion, "raw", "calibrate"]["pr_auc"] == report[best, "raw", "calibrate"]["pr_auc"]
    assert [k for k, r in report.items() if r["champion"]] and all(k[:2] == (run.champion, "isotonic") for k, r in report.items() if r["champion"])
    assert report[run.champion, "isotonic", "test"]["verdict"] == run.verdict and report["half", "baseline", "test"]["verdict"] is None
    # a calibrator is a map of the score: on its own fold the mean agrees with the rate
    on_own = report[run.champion, "isotonic", "calibrate"]
    assert on_own["mean_predicted"] == pytest.approx(on_own["base_rate"], abs=1e-6)
    assert run.score(ready(spark)).columns[-1] == "probability"


def test_a_leak_stops_the_run(spark):
    run = training.train(ready(spark, leak=True), "y", {"a": candidates()["strong"]})
    assert run.suspicious and "ROC-AUC" in run.verdict
    with pytest.raises(ValueError, match="training stopped"):
        training.train(ready(spark, leak=True), "y", {"a": candidates()["strong"]}, strict=True)


def test_folds_and_methods_are_checked(spark):
    with pytest.raises(ValueError, match="unknown calibration"):
        training.train(ready(spark), "y", candidates(), method="other")
    with pytest.raises(ValueError, match="must have rows"):
        training.train(ready(spark).where("fold <> 'calibrate'"), "y", candidates())
    assert training.sanity_verdict(None, None, training.Bounds()).startswith("not evaluated")
