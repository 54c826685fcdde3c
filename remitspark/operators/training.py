"""A training run: candidates fitted and calibrated on earlier folds, one grouped metric pass, the champion and the verdict on it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.inline import values_frame
from ..session import pin
from . import modeling
from .evaluation import ranking_metrics

CALIBRATIONS = ("isotonic", "platt")


@dataclass(frozen=True)
class Bounds:
    """Test metrics above these are too good to be honest: a leak to hunt, no result to report."""

    roc_auc: float = 0.75
    pr_auc: float = 0.95


@dataclass
class TrainingRun:
    models: dict[str, Model]
    calibrators: dict[tuple[str, str], Model]
    champion: str
    method: str
    verdict: str
    metrics: DataFrame = field(repr=False)

    @property
    def suspicious(self) -> bool:
        return self.verdict.startswith("SUSPICIOUS")

    def score(self, rows: DataFrame, out: str = "probability") -> DataFrame:
        """Calibrated probability of the champion."""
        raw = modeling.raw_scores(self.models[self.champion], rows)
        return modeling.calibrated(self.calibrators[self.champion, self.method], raw, out).drop("score")


def sanity_verdict(roc_auc: float | None, pr_auc: float | None, bounds: Bounds) -> str:
    if roc_auc is None or pr_auc is None:
        return "not evaluated: the test fold has one class"
    pairs = (("ROC-AUC", roc_auc, bounds.roc_auc), ("PR-AUC", pr_auc, bounds.pr_auc))
    over = [f"{name} {value:.4f} > {limit}" for name, value, limit in pairs if value > limit]
    return "SUSPICIOUS: " + "; ".join(over) if over else "within the bounds"


def train(
    ready: DataFrame, label: str, candidates: Mapping[str, Callable[[DataFrame], Model]], *, fold: str = "fold", key: str = "claim_sk",
    baselines: Mapping[str, DataFrame] | None = None, method: str = "isotonic", bounds: Bounds = Bounds(), strict: bool = False,
) -> TrainingRun:
    """Fit every candidate on the fit fold, calibrate it both ways on the calibration fold, and choose.

    ``ready``: key, fold (fit, calibrate, test), label, features. The champion has the best PR-AUC of raw scores on the calibration fold,
    which is earlier than the test fold and is never it; ties go to the first name. All candidates, calibrations and folds are
    measured in one grouped ranking pass. ``baselines`` (key, fold, label, score) are measured beside them and never chosen. With
    ``strict`` a suspicious champion raises. An empty fit or calibration fold raises.
    """
    if method not in CALIBRATIONS:
        raise ValueError(f"unknown calibration {method!r}; expected one of {CALIBRATIONS}")
    fit, held = ready.where(F.col(fold) == "fit"), ready.where(F.col(fold) != "fit")
    if fit.isEmpty() or ready.where(F.col(fold) == "calibrate").isEmpty():
        raise ValueError("the fit and calibration folds must have rows")
    models = {name: fitted(fit) for name, fitted in candidates.items()}
    calibrators: dict[tuple[str, str], Model] = {}
    parts = {}
    for name, model in models.items():
        raw = pin(modeling.raw_scores(model, held.select(key, fold, label, "features")).drop("features"))
        parts[name, "raw"] = raw
        for how in CALIBRATIONS:
            calibrators[name, how] = modeling.fit_calibrator(raw.where(F.col(fold) == "calibrate"), label, method=how)
            mapped = modeling.calibrated(calibrators[name, how], raw, "mapped")
            parts[name, how] = mapped.drop("score").withColumnRenamed("mapped", "score")
    for name, rows in (baselines or {}).items():
        parts[name, "baseline"] = rows
    stacked = None
    for (name, variant), rows in parts.items():
        one = rows.select(F.lit(name).alias("model"), F.lit(variant).alias("variant"), F.col(fold).alias("fold"), F.col(label).cast("int").alias("y"), F.col("score").cast("double").alias("score"))
        stacked = one if stacked is None else stacked.unionByName(one)
    metrics = pin(ranking_metrics(stacked.where("fold <> 'fit'"), "y", "score", ["model", "variant", "fold"]))
    table = {(r["model"], r["variant"], r["fold"]): r for r in metrics.collect()}  # one row a model, variant and fold

    def figure(name: str, variant: str, at: str, what: str) -> float | None:
        row = table.get((name, variant, at))
        return row[what] if row else None

    on_calibration = {name: figure(name, "raw", "calibrate", "pr_auc") for name in models}
    champion = modeling.champion({name: -1.0 if v is None else v for name, v in on_calibration.items()})
    verdict = sanity_verdict(figure(champion, method, "test", "roc_auc"), figure(champion, method, "test", "pr_auc"), bounds)
    if strict and verdict.startswith("SUSPICIOUS"):
        raise ValueError(f"training stopped, {champion}: {verdict}")
    return TrainingRun(models, calibrators, champion, method, verdict, metrics)


def run_report(run: TrainingRun) -> DataFrame:
    """One row for each model, variant and fold: its metrics, whether it is the champion as shipped, and the verdict on that one."""
    spark = run.metrics.sparkSession
    chosen = values_frame(spark, [(run.champion, run.method, run.verdict)], "model string, variant string, verdict string")
    return run.metrics.join(chosen.withColumn("champion", F.lit(True)), ["model", "variant"], "left").selectExpr(
        "model", "variant", "fold", "n", "positives", "base_rate", "mean_predicted", "roc_auc", "pr_auc", "brier", "coalesce(champion, false) as champion", "if(fold = 'test', verdict, null) as verdict"
    )
