"""Preprocessing, models, calibration and linear explanations with Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import REASON_CODES, reason_table
from ..functions.inline import literal, values_frame
from ..session import pin
from .boosting import fit_trees
from .leakage import long_numbers
from .ordering import exact_quantiles, quantile_scalars

MISSING = "__missing__"
RARE = "__infrequent__"
FEW_GROUPS = 10_000  # more groups than these are dealt out by a shuffle; the rates are the same


@dataclass(frozen=True)
class FeatureSpec:
    """Declared model inputs by kind."""

    numeric: Sequence[str] = ()
    boolean: Sequence[str] = ()
    categorical: Sequence[str] = ()

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *self.boolean, *self.categorical]


@dataclass
class Preprocessor:
    """Everything learned on the fit rows, and how to apply it."""

    spec: FeatureSpec
    medians: Mapping[str, float]
    indicators: Sequence[str]
    scale: Mapping[str, tuple[float, float]]
    modes: Mapping[str, float]
    frequent: DataFrame
    stages: Model | None = None
    owners: list[str] = field(default_factory=list)

    def _columns(self, df: DataFrame) -> DataFrame:
        """Imputed, scaled and level-folded columns next to the input columns."""
        kinds = dict(df.dtypes)
        out = df
        for c in self.spec.categorical:
            # the indexer has every level on the driver already; by a shuffle all rows would go to one task for each level
            side = F.broadcast(self.frequent.where(F.col("feature") == c).selectExpr("level as _level", "true as _ok"))
            out = (
                out.withColumn("_level", F.expr(f"coalesce(cast({c} as string), '{MISSING}')"))
                .join(side, "_level", "left")
                .withColumn(f"_c_{c}", F.expr(f"if(_ok, _level, '{RARE}')"))
                .drop("_level", "_ok")
            )
        exprs = []
        for c in self.spec.numeric:
            mean, sd = self.scale[c]
            exprs.append(f"(coalesce(cast({c} as double), {self.medians[c]!r}D) - {mean!r}D) / {sd!r}D as `_n_{c}`")
        exprs += [f"if({c} is null, 1D, 0D) as `_m_{c}`" for c in self.indicators]
        for c in self.spec.boolean:
            number = f"cast(cast({c} as int) as double)" if kinds[c] == "boolean" else f"cast({c} as double)"
            exprs.append(f"coalesce({number}, {self.modes[c]!r}D) as `_b_{c}`")
        return out.selectExpr("*", *exprs)

    def transform(self, df: DataFrame) -> DataFrame:
        ready = self.stages.transform(self._columns(df))
        return ready.select(*df.columns, "features")


def fit_preprocessor(fit_rows: DataFrame, spec: FeatureSpec, min_frequency: int = 30) -> Preprocessor:
    """Learn medians, scales, modes and frequent levels on the fit rows only.

    One job for all medians, one for means and deviations (population), one for all levels.
    """
    numeric, boolean, categorical = list(spec.numeric), list(spec.boolean), list(spec.categorical)
    medians: dict[str, float] = {}
    if numeric:
        rows = exact_quantiles(long_numbers(fit_rows, numeric), "value", [0.5], ["feature"]).collect()
        medians = {r["feature"]: float(r["quantile"]) for r in rows}
    medians = {c: medians.get(c, 0.0) for c in numeric}
    aggregates = []
    for c in numeric:
        filled = f"coalesce(cast({c} as double), {medians[c]!r}D)"
        aggregates += [f"avg({filled}) as `a_{c}`", f"stddev_pop({filled}) as `s_{c}`", f"count_if({c} is null) as `z_{c}`"]
    for c in boolean:
        aggregates.append(f"if(count_if({c}) > count_if(not {c}), 1D, 0D) as `b_{c}`")
    got = fit_rows.agg(*[F.expr(a) for a in aggregates]).first() if aggregates else {}
    scale = {c: (got[f"a_{c}"], got[f"s_{c}"] or 1.0) for c in numeric}
    indicators = [c for c in numeric if got[f"z_{c}"] > 0]
    modes = {c: got[f"b_{c}"] for c in boolean}
    items = ", ".join(
        f"struct({literal(c)} as feature, coalesce(cast({c} as string), '{MISSING}') as level)" for c in categorical
    )
    if categorical:
        frequent = pin(
            fit_rows.selectExpr(f"inline(array({items}))")
            .groupBy("feature", "level")
            .agg(F.expr("count(1) as n"))
            .where(f"n >= {min_frequency}")
            .select("feature", "level")
        )
    else:
        frequent = values_frame(fit_rows.sparkSession, [], "feature string, level string")
    prep = Preprocessor(spec, medians, indicators, scale, modes, frequent)
    stages = []
    if categorical:
        indexed = [f"_i_{c}" for c in categorical]
        # one indexer for all columns: their labels come from one job
        stages = [
            StringIndexer(
                inputCols=[f"_c_{c}" for c in categorical], outputCols=indexed, handleInvalid="keep",
                stringOrderType="alphabetAsc",
            ),
            OneHotEncoder(
                inputCols=indexed, outputCols=[f"_v_{c}" for c in categorical], dropLast=True, handleInvalid="keep"
            ),
        ]
    inputs = (
        [f"_n_{c}" for c in numeric] + [f"_m_{c}" for c in indicators] + [f"_b_{c}" for c in boolean]
        + [f"_v_{c}" for c in categorical]
    )
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    shaped = prep._columns(fit_rows)
    prep.stages = Pipeline(stages=stages).fit(shaped)
    owners = [*numeric, *indicators, *boolean]
    if categorical:
        for c, labels in zip(categorical, prep.stages.stages[0].labelsArray):
            # one slot per label plus the slot for unseen values
            owners += [c] * (len(labels) + 1)
    prep.owners = owners
    return prep


def fit_logistic(rows: DataFrame, label: str, c: float = 1.0, max_iter: int = 100) -> Model:
    """L2 logistic regression; the penalty is 1/(C*n) because Spark averages the loss."""
    n = rows.count()
    data = rows.withColumn("_label", F.col(label).cast("double"))
    return LogisticRegression(
        labelCol="_label", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-7
    ).fit(data)


def fit_boosted(
    rows: DataFrame, label: str, trees: int = 300, depth: int = 4, step: float = 0.05, subsample: float = 0.8,
    columns: float = 0.8, min_rows: int = 20, seed: int = 1337, key: str | None = None,
) -> Model:
    """Gradient-boosted trees on the same feature vector; ``columns`` is the share of slots that a node may split on."""
    return fit_trees(
        rows, label, key, trees=trees, depth=depth, step=step, subsample=subsample, columns=columns, min_rows=min_rows, seed=seed
    )


def raw_scores(model: Model, rows: DataFrame, out: str = "score") -> DataFrame:
    keep = [c for c in rows.columns if c != out]
    scored = model.transform(rows).withColumn(out, vector_to_array("probability")[1])
    return scored.select(*[c for c in keep], out)


def fit_calibrator(rows: DataFrame, label: str, score: str = "score", method: str = "isotonic") -> Model:
    """Isotonic or Platt calibration, fitted on the calibration fold."""
    data = rows.withColumn("_label", F.col(label).cast("double"))
    if method == "isotonic":
        return IsotonicRegression(labelCol="_label", featuresCol=score).fit(data)
    if method == "platt":
        vec = VectorAssembler(inputCols=[score], outputCol="_sv")
        return Pipeline(stages=[vec, LogisticRegression(labelCol="_label", featuresCol="_sv")]).fit(data)
    raise ValueError(f"unknown calibration {method!r}")


def calibrated(model: Model, rows: DataFrame, out: str = "probability_calibrated") -> DataFrame:
    if hasattr(model, "stages"):
        scored = model.transform(rows).withColumn(out, vector_to_array("probability")[1])
    else:
        scored = model.transform(rows).withColumnRenamed("prediction", out)
    return scored.select(*rows.columns, out)


def flag_top_quantile(rows: DataFrame, score: str, fold: str, reference: str = "test", q: float = 0.90, out: str = "top_decile") -> DataFrame:
    """Flag rows at or above the quantile of the reference fold's scores."""
    cut = next(iter(quantile_scalars(rows.where(F.col(fold) == reference), score, [q]).values()))
    return rows.withColumn(out, F.expr(f"{score} >= {cut!r}D"))


def base_rate_scores(fit_rows: DataFrame, rows: DataFrame, label: str, out: str = "score") -> DataFrame:
    """Every row gets the fit fold's base rate."""
    return rows.withColumn(out, fit_rows.agg(F.expr(f"avg(cast({label} as double))")).scalar())


def group_rate_scores(fit_rows: DataFrame, rows: DataFrame, group: str, label: str, out: str = "score") -> DataFrame:
    """The fit fold's rate of the row's group; unseen or null groups get the overall rate."""
    rates = fit_rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.expr(f"avg(cast({label} as double)) as _rate"))
    if fit_rows.where(F.col(group).isNotNull()).select(group).distinct().limit(FEW_GROUPS + 1).count() <= FEW_GROUPS:
        rates = F.broadcast(rates)  # by a shuffle every group's rows would be one task's
    overall = fit_rows.agg(F.expr(f"avg(cast({label} as double))"))
    return (
        rows.join(rates, group, "left")
        .withColumn("_all", overall.scalar())
        .withColumn(out, F.coalesce("_rate", "_all"))
        .select(*[c for c in rows.columns if c != out], out)
    )


def champion(metrics: Mapping[str, float]) -> str:
    """The model with the largest calibration-fold PR-AUC; the first name on ties."""
    return min(metrics, key=lambda name: (-metrics[name], name))


def check_plausible(roc_auc: float, pr_auc: float, max_roc: float = 0.75, max_pr: float = 0.95) -> None:
    """Stop on a score that is too good to be honest."""
    if roc_auc > max_roc or pr_auc > max_pr:
        raise ValueError(f"suspicious performance: ROC-AUC {roc_auc:.4f}, PR-AUC {pr_auc:.4f}")


# ---------------------------------------------------------------- linear explanations


def global_importance(model: Model, rows: DataFrame, owners: Sequence[str]) -> DataFrame:
    """(feature, importance, share, sim_reason_code, sim_analyst_action) of a linear model.

    mean |coef * (x - mean)| per vector slot is |coef| times the slot's mean absolute deviation,
    which one summarizer pass gives; slots are then folded to their declared feature.
    """
    centred = StandardScaler(inputCol="features", outputCol="_centred", withMean=True, withStd=False).fit(rows).transform(rows)
    row = centred.select(
        Summarizer.metrics("normL1", "count").summary(F.col("_centred")).alias("s")
    ).select("s.normL1", "s.count").first()
    deviation = row["normL1"].toArray() / row["count"]
    sums: dict[str, float] = dict.fromkeys(owners, 0.0)
    for owner, coef, dev in zip(owners, model.coefficients.toArray(), deviation):
        sums[owner] += abs(float(coef)) * float(dev)
    spark = rows.sparkSession
    table = values_frame(spark, list(sums.items()), "feature string, importance double")
    return table.join(reason_table(spark), "feature", "left").selectExpr(
        "feature", "importance", "importance / nullif(sum(importance) over (), 0D) as share",
        "coalesce(sim_reason_code, 'UNMAPPED') as sim_reason_code",
        "coalesce(sim_analyst_action, '-- no mapped action --') as sim_analyst_action",
    )


def row_drivers(model: Model, rows: DataFrame, owners: Sequence[str], key: str, k: int = 5) -> DataFrame:
    """(key, driver_rank, feature, contribution, direction, reason code, action): the k strongest
    declared features of each row. Worked out inside the row; nothing is shuffled."""
    means = rows.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()
    coefs = model.coefficients.toArray()
    names = list(dict.fromkeys(owners))
    slots = {n: [i for i, o in enumerate(owners) if o == n] for n in names}
    parts = []
    for n in names:
        body = " + ".join(f"(_x[{i}] - {float(means[i])!r}D) * {float(coefs[i])!r}D" for i in slots[n])
        code, action = REASON_CODES.get(n, ("UNMAPPED", "-- no mapped action --"))
        parts.append(
            f"struct(-abs({body}) as _s, {literal(n)} as feature, {body} as contribution, {literal(code)} as sim_reason_code, "
            f"{literal(action)} as sim_analyst_action)"
        )
    ranked = rows.withColumn("_x", vector_to_array("features")).selectExpr(
        key, f"posexplode(slice(array_sort(array({', '.join(parts)})), 1, {k})) as (_p, _d)"
    )
    return ranked.selectExpr(
        key, "_p + 1 as driver_rank", "_d.feature as feature", "_d.contribution as contribution",
        "if(_d.contribution >= 0, 'raises', 'lowers') as direction", "_d.sim_reason_code", "_d.sim_analyst_action",
    )


def reasons_among_top(drivers: DataFrame, key: str, max_rank: int = 3, k: int = 12) -> DataFrame:
    """Distinct rows per reason code among the first drivers; the k most frequent codes."""
    return (
        drivers.where(F.col("driver_rank") <= max_rank)
        .select(key, "sim_reason_code")
        .distinct()
        .groupBy("sim_reason_code")
        .agg(F.expr("count(1) as claims"))
        .orderBy(F.col("claims").desc(), "sim_reason_code")
        .limit(k)
    )
