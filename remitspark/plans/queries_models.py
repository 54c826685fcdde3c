"""Evaluation, queue, probe and model queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import rounded
from ..operators import evaluation as evl
from ..operators import checks, leakage, modeling, paired, scoring, serving, splits, training
from ..operators import relational as rel
from ..operators import workqueue as wq
from ..session import ensure_checkpoint_dir, pin
from . import views
from .features import LABEL, SUBMISSION_FEATURES, TIME, submission_base, submission_frame
from .queries_data import dq_scorecard
from .roles import claims, table

REVIEW_COST = 25.0
MULTIPLIER = evl.value_multiplier(0.50, 0.25)
SWEEP = (0.005, 0.01, 0.025, 0.055, 0.075, 0.125, 0.25, 0.5, 1.0)
ECONOMICS = wq.Economics(mandatory_categories=("1-URGENT", "5-LOW"))


def scored(spark: SparkSession, d: str, **dims: bool) -> DataFrame:
    """Claims with a fixed score (documentation score on a 0-1 scale), label and dollars."""
    return claims(spark, d, **dims).selectExpr(
        "claim_sk",
        "sim_submission_date",
        "sim_documentation_score",
        "cast(sim_documentation_score as double) / 10D as score",
        "cast(sim_coding_complexity_score as double) / 50D as score_b",
        "cast(sim_denial_flag as int) as y",
        "sim_denied_amount as amount",
        "sim_allowed_amount",
        *(["sim_payer_id"] if dims.get("payer") else []),
        *(["sim_service_line_id"] if dims.get("drg") else []),
    )


def auc_ap_brier(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evl.ranking_metrics(scored(spark, d), "y", "score"), 9)


def slices(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evl.slice_metrics(scored(spark, d, payer=True), "y", "score", "sim_payer_id"), 9)


def dollar_capture(spark: SparkSession, d: str) -> DataFrame:
    return evl.dollars_captured(scored(spark, d), "y", "score", "amount", "claim_sk")


def calibration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evl.calibration_bins(scored(spark, d), "y", "score", "claim_sk"), 9)


def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evl.calibration_error(evl.calibration_bins(scored(spark, d), "y", "score", "claim_sk")), 9)


def threshold_cost(spark: SparkSession, d: str) -> DataFrame:
    grid = evl.threshold_grid(scored(spark, d), "y", "score", "amount")
    return rounded(evl.cost_threshold(grid, REVIEW_COST, MULTIPLIER), 6)


def threshold_capacity(spark: SparkSession, d: str) -> DataFrame:
    """The top-decile threshold of early claims, applied to late ones."""
    rows = scored(spark, d)
    early, late = splits.two_folds(rows, "sim_submission_date")
    cut = evl.capacity_threshold(early, "score", 0.10)
    return rounded(evl.apply_threshold(late, "y", "score", "amount", cut, REVIEW_COST, MULTIPLIER), 6)


def sensitivity(spark: SparkSession, d: str) -> DataFrame:
    grid = evl.threshold_grid(scored(spark, d), "y", "score", "amount")
    return rounded(evl.multiplier_sweep(grid, REVIEW_COST, SWEEP), 6)


def break_even(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evl.break_even(scored(spark, d), "y", "amount", REVIEW_COST), 6)


def concentration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evl.concentration(scored(spark, d), "amount"), 6)


def value_bands(spark: SparkSession, d: str) -> DataFrame:
    """Bands learned on early claims, applied to all."""
    rows = scored(spark, d)
    banded = evl.value_bands(
        splits.two_folds(rows, "sim_submission_date")[0], rows, "sim_allowed_amount", [0, 0.25, 0.5, 0.75, 0.9, 1]
    )
    return banded.groupBy("value_band").agg(
        F.expr("count(1) as n"), F.expr("cast(sum(sim_allowed_amount) as double) as allowed")
    )


def risk_bands(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).selectExpr(f"{serving.risk_band('score / 2D')} as band", "y")
    return rows.groupBy("band").agg(F.expr("count(1) as n"), F.expr("sum(y) as denied"))


def group_rate(spark: SparkSession, d: str) -> DataFrame:
    """Payer-rule baseline: early payer rates applied to late claims."""
    rows = scored(spark, d, payer=True)
    early, late = splits.two_folds(rows, "sim_submission_date")
    return modeling.group_rate_scores(early, late.select("claim_sk", "sim_payer_id"), "sim_payer_id", "y")


def base_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d)
    early, late = splits.two_folds(rows, "sim_submission_date")
    out = modeling.base_rate_scores(early, late.select("claim_sk"), "y")
    return out.groupBy("score").agg(F.expr("count(1) as n"))


# ---------------------------------------------------------------- queues


def queue_rows(spark: SparkSession, d: str) -> DataFrame:
    """Denied claims with an overturn probability and their review date."""
    return claims(spark, d).where("sim_denial_flag").selectExpr(
        "claim_sk",
        "cast(sim_documentation_score as double) / 200D as p",
        "sim_denied_amount",
        "sim_denial_review_date",
        "sim_denial_category",
        "cast(recovered_amt as double) as recovered",
        "any_overturned",
    )


_QUEUE_ARGS = ("claim_sk", "p", "sim_denied_amount", "sim_denial_review_date", "sim_denial_category")


def work_queue(spark: SparkSession, d: str) -> DataFrame:
    """The queue as it stood on 1999-03-01: every denial reviewed up to that day, the expired ones marked."""
    rows = queue_rows(spark, d).where("sim_denial_review_date <= date'1999-03-01'")
    q = wq.work_queue(rows, *_QUEUE_ARGS, ECONOMICS, as_of="date'1999-03-01'")
    return q.drop("recovered", "any_overturned", "recommended_action")


def work_queue_arrival(spark: SparkSession, d: str) -> DataFrame:
    """The backtest queue: every denial triaged the day it posts."""
    q = wq.work_queue(queue_rows(spark, d), *_QUEUE_ARGS, ECONOMICS)
    return q.select("claim_sk", "sim_expected_net_recovery", "tier", "queue_position", "sim_days_to_deadline", "as_of")


def queue_guarantee(spark: SparkSession, d: str) -> DataFrame:
    """Tier counts of the arrival queue and how many tier boundaries are broken (0)."""
    q = wq.work_queue(queue_rows(spark, d), *_QUEUE_ARGS, ECONOMICS)
    broken = wq.outranked_tiers(q).agg(F.expr("count(1) as n"))
    return wq.empty_tiers(q).withColumn("broken_boundaries", broken.scalar())


def queue_page(spark: SparkSession, d: str) -> DataFrame:
    """Second page of the MANDATORY_REVIEW tier."""
    q = wq.work_queue(queue_rows(spark, d), *_QUEUE_ARGS, ECONOMICS)
    return wq.page(q, limit=25, offset=25, tier="mandatory_review").select("claim_sk", "tier", "queue_position")


def month_queues(spark: SparkSession, d: str) -> DataFrame:
    rows = wq.monthly_queue_rows(queue_rows(spark, d), *_QUEUE_ARGS, ECONOMICS)
    return wq.deadline_pressure(rows, "claim_sk")


def month_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Open claims and tiers per month-start snapshot."""
    rows = wq.monthly_queue_rows(queue_rows(spark, d), *_QUEUE_ARGS, ECONOMICS)
    return rows.groupBy("as_of", "tier").agg(F.expr("count(1) as open_claims"))


def recovery_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Mean recovered share among won appeals, per denial type and overall."""
    won = claims(spark, d).where("any_overturned")
    value = "cast(recovered_amt as double) / nullif(cast(sim_denied_amount as double), 0D)"
    per = won.groupBy("sim_denial_type").agg(F.expr(f"avg({value}) as ratio"), F.expr("count(1) as n"))
    whole = won.agg(F.expr(f"avg({value}) as ratio"), F.expr("count(1) as n")).selectExpr("'ALL' as sim_denial_type", "*")
    return rounded(per.unionByName(whole), 9)


RULES = {
    "enr_score": wq.score_sql("p", "sim_denied_amount", ECONOMICS),
    "largest_denial_first": "cast(sim_denied_amount as double)",
    "constant": "0D",
}


def rule_compare(spark: SparkSession, d: str) -> DataFrame:
    rows = queue_rows(spark, d).where("any_overturned is not null")
    queue = wq.work_queue(rows, *_QUEUE_ARGS, ECONOMICS).selectExpr("claim_sk", "cast(-queue_position as double) as tiered")
    both = rows.join(queue, "claim_sk")
    return rounded(
        wq.compare_rules(both, "claim_sk", {**RULES, "enr_tiered_queue": "tiered"}, "recovered", 0.10), 6
    )


RULE_PAIRS = [("enr_score", "largest_denial_first"), ("enr_tiered_queue", "largest_denial_first"), ("enr_tiered_queue", "enr_score"), ("enr_score", "enr_score")]


def rule_differences(spark: SparkSession, d: str) -> DataFrame:
    """Does the score, and does the tiered queue, recover more than the largest denials first? Paired 95 % intervals of 200 resamples."""
    rows = pin(queue_rows(spark, d).where("any_overturned is not null"))
    queue = wq.work_queue(rows, *_QUEUE_ARGS, ECONOMICS).selectExpr("claim_sk", "cast(-queue_position as double) as tiered")
    rules = {n: RULES[n] for n in ("enr_score", "largest_denial_first")} | {"enr_tiered_queue": "tiered"}
    return rounded(paired.rule_differences(rows.join(queue, "claim_sk"), "claim_sk", rules, RULE_PAIRS, "recovered", 0.10), 6)


# how a request may be put: the caller's own estimate, the claim, its category alone (a claim that no run has scored), neither
ASKED = {
    "estimate": ("claim_sk", "sim_denial_category", "own"),
    "claim": ("claim_sk", "sim_denial_category", "cast(null as double)"),
    "category": ("-1 - claim_sk", "sim_denial_category", "cast(null as double)"),
    "neither": ("-1 - claim_sk", "cast(null as string)", "cast(null as double)"),
}


def probability_source(spark: SparkSession, d: str) -> DataFrame:
    """Every denied claim's overturn probability and where it comes from, for each way a request may be put."""
    c = claims(spark, d).where("sim_denial_flag")
    ways = ", ".join(f"struct('{asked}' as asked, {key} as known, {category} as category, {given} as given)" for asked, (key, category, given) in ASKED.items())
    requests = c.withColumn("own", F.expr("cast(sim_coding_complexity_score as double) / 50D")).selectExpr("claim_sk", f"inline(array({ways}))")
    shipped = queue_rows(spark, d).selectExpr("claim_sk as known", "p as p_shipped")
    rates = serving.category_overturn_rates(views.denial_root_cause(c)).selectExpr(
        "sim_denial_category as category", "overturn_rate as p_category"
    )
    out = wq.resolve_probability(requests, shipped, rates, "known", "category", "given")
    return rounded(out.drop("given", "known"), 9)


def headline(spark: SparkSession, d: str) -> DataFrame:


    queue = wq.score_claims(queue_rows(spark, d), *_QUEUE_ARGS, ECONOMICS)
    row = serving.headline(views.denial_root_cause(claims(spark, d)), queue, dq_scorecard(spark, d))
    return rounded(row, 4)


def imputation(spark: SparkSession, d: str) -> DataFrame:
    """How many declared facts each claim supplies and which are imputed."""
    rows = claims(spark, d).selectExpr(
        "claim_sk as request_id", "sim_days_to_adjudication", "sim_days_to_payment", "sim_denial_category", "line_count"
    )
    report = serving.imputation_report(
        rows, ["sim_days_to_adjudication", "sim_days_to_payment", "sim_denial_category", "line_count", "sim_payer_id"]
    )
    return report.groupBy("supplied_count", "imputed_count", F.expr("array_join(imputed_features, ',') as imputed")).agg(
        F.expr("count(1) as requests")
    )


# ---------------------------------------------------------------- probes

PROBED = (
    "sim_documentation_score", "sim_coding_complexity_score", "line_count", "sim_auth_missing", "sim_payer_id",
    "sim_days_service_to_submission",
)
FORBIDDEN = ("sim_denial_type", "sim_denied_amount", "sim_days_to_payment", "sim_appeal_levels")


def mi_dependency(spark: SparkSession, d: str) -> DataFrame:
    rows = claims(spark, d, payer=True).select("claim_sk", *PROBED, *FORBIDDEN)
    return rounded(leakage.dependency(rows, PROBED, FORBIDDEN), 9)


def feature_auc(spark: SparkSession, d: str) -> DataFrame:
    rows = claims(spark, d, payer=True, drg=True).withColumn("y", F.expr("cast(sim_denial_flag as int)"))
    return rounded(
        leakage.feature_auc(
            rows, "claim_sk", "y", ["sim_documentation_score", "line_count", "sim_days_to_payment"],
            ["sim_payer_id", "drg_cd"],
        ),
        9,
    )


def null_auc(spark: SparkSession, d: str) -> DataFrame:
    rows = claims(spark, d).withColumn("y", F.expr("cast(sim_denial_flag as int)"))
    return rounded(
        leakage.null_indicator_auc(rows, "y", ["sim_denial_review_date", "sim_days_to_payment", "sim_adjudication_date"]), 9
    )


def identifiers(spark: SparkSession, d: str) -> DataFrame:
    """A key under another name is found; honest measures are not."""
    rows = claims(spark, d).selectExpr(
        "claim_sk", "claim_sk * 3 + 7 as hidden_key", "cast(billed_charge_amt as double) as billed", "line_count"
    )
    return rounded(leakage.identifier_findings(rows, ["hidden_key", "billed", "line_count"], "claim_sk"), 9)


def lineage(spark: SparkSession, d: str) -> DataFrame:
    """Which claim outputs move when one line column is altered."""


    lines = table(spark, d, "lineitem").selectExpr(
        "l_orderkey as k", "l_returnflag as flag", "cast(round(l_extendedprice * 100) as bigint) as cents", "l_suppkey as supp"
    )

    def build(df: DataFrame) -> DataFrame:
        return df.groupBy("k").agg(
            F.expr("count_if(flag = 'R') * 2 > count(1) as denied"), F.expr("sum(cents) as billed_cents"),
            F.expr("min(supp) as provider"), F.expr("sum(if(flag = 'R', cents, 0)) as denied_cents"),
        )

    return checks.perturbation_lineage(
        lines, "k", ["flag", "cents", "supp"], build,
        {"flag": "if(flag = 'R', 'N', 'R')", "cents": "cents + 1", "supp": "supp + 1"},
    )


# ---------------------------------------------------------------- models


def _folds(spark: SparkSession, d: str) -> DataFrame:
    """The matrix with fold labels, pinned because every model stage reads it."""
    known = submission_base(spark, d)
    return pin(splits.nested_split(submission_frame(known), TIME, dates=known.select(TIME)))


def _matrix(spark: SparkSession, d: str):
    """Folds, preprocessor fitted on the fit fold, and the feature vectors of all rows."""
    rows = _folds(spark, d)
    prep = modeling.fit_preprocessor(rows.where("fold = 'fit'"), SUBMISSION_FEATURES)
    return rows, prep, pin(prep.transform(rows).select("claim_sk", "fold", LABEL, "sim_denied_amount", "features"))


def _logistic(spark: SparkSession, d: str):
    _, prep, ready = _matrix(spark, d)
    return prep, ready, modeling.fit_logistic(ready.where("fold = 'fit'"), LABEL)


def score_all(spark: SparkSession, d: str) -> DataFrame:
    """Every claim with fold, raw and calibrated probability and the top-decile flag."""
    _, ready, model = _logistic(spark, d)
    raw = modeling.raw_scores(model, ready).drop("features")
    calibrator = modeling.fit_calibrator(raw.where("fold = 'calibrate'"), LABEL)
    return modeling.flag_top_quantile(modeling.calibrated(calibrator, raw), "score", "fold")


def model_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Logistic model against its baselines: metrics on the test fold."""
    rows, _, ready = _matrix(spark, d)
    model = modeling.fit_logistic(ready.where("fold = 'fit'"), LABEL)
    logistic = modeling.raw_scores(model, ready.where("fold = 'test'")).selectExpr(f"cast({LABEL} as int) as y", "score")
    fit, test = rows.where("fold = 'fit'"), rows.where("fold = 'test'")
    payer = modeling.group_rate_scores(fit, test, "sim_payer_id", LABEL).selectExpr(f"cast({LABEL} as int) as y", "score")
    base = modeling.base_rate_scores(fit, test, LABEL).selectExpr(f"cast({LABEL} as int) as y", "score")
    stacked = rel.union_labelled({"logistic": logistic, "payer_rule": payer, "base_rate": base}, "model")
    return evl.ranking_metrics(stacked, "y", "score", ["model"])


def gbt(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees on the same matrix: test-fold metrics."""
    _, _, ready = _matrix(spark, d)
    model = modeling.fit_boosted(ready.where("fold = 'fit'"), LABEL, key="claim_sk")
    scored_rows = modeling.raw_scores(model, ready.where("fold = 'test'")).selectExpr(f"cast({LABEL} as int) as y", "score")
    return evl.ranking_metrics(scored_rows, "y", "score")


def training_run(spark: SparkSession, d: str) -> DataFrame:
    """Logistic and boosted candidates with both calibrations and the baselines, on every held-out fold; the champion and the verdict."""
    rows, _, ready = _matrix(spark, d)
    fit, held = rows.where("fold = 'fit'"), rows.where("fold <> 'fit'")
    scores = {
        "payer_rule": modeling.group_rate_scores(fit, held, "sim_payer_id", LABEL),
        "base_rate": modeling.base_rate_scores(fit, held, LABEL),
    }
    candidates = {"boosted": lambda x: modeling.fit_boosted(x, LABEL, key="claim_sk"), "logistic": lambda x: modeling.fit_logistic(x, LABEL)}
    run = training.train(ready, LABEL, candidates, baselines={n: x.select("claim_sk", "fold", LABEL, "score") for n, x in scores.items()})
    return rounded(training.run_report(run), 9)


def score_requests(spark: SparkSession, d: str) -> DataFrame:
    """Every claim as a request that gives only what is known before documentation is complete, scored by a saved and reloaded model."""
    rows, prep, ready = _matrix(spark, d)
    model = modeling.fit_logistic(ready.where("fold = 'fit'"), LABEL)
    raw = modeling.raw_scores(model, ready.where("fold = 'calibrate'"))
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    scoring.ScoringModel(prep, model, modeling.fit_calibrator(raw, LABEL)).save(folder)
    asked = rows.selectExpr("claim_sk as request_id", "sim_payer_id", "sim_service_line_id", "sim_auth_missing", "if(sim_documentation_complete, sim_documentation_score, null) as sim_documentation_score")
    return scoring.ScoringModel.load(spark, folder).score(asked)


def global_drivers(spark: SparkSession, d: str) -> DataFrame:
    prep, ready, model = _logistic(spark, d)
    return modeling.global_importance(model, ready.where("fold = 'fit'"), prep.owners)


def linear_drivers(spark: SparkSession, d: str) -> DataFrame:
    """The five strongest features of each test claim."""
    prep, ready, model = _logistic(spark, d)
    return modeling.row_drivers(model, ready.where("fold = 'test'"), prep.owners, "claim_sk")


def driver_reasons(spark: SparkSession, d: str) -> DataFrame:
    return modeling.reasons_among_top(linear_drivers(spark, d), "claim_sk")


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """AUC interval, paired difference of two scores, and capture difference, 200 resamples."""
    rows = pin(scored(spark, d).select("claim_sk", "y", "score", "score_b", "amount"))  # read by every ranking
    draws = pin(evl.bootstrap_auc(rows, "y", "score", "claim_sk"))
    one = evl.interval(draws, "auc").withColumn(
        "point", evl.ranking_metrics(rows, "y", "score").select("roc_auc").scalar()
    )
    pair = evl.paired_auc_difference(rows, "y", "score", "score_b", "claim_sk", draws_a=draws)
    money = rows.withColumn("at_risk", F.expr("if(y = 1, cast(amount as double), 0D)"))
    share = [evl.dollars_captured(rows, "y", s, "amount", "claim_sk", 0.10).select("share") for s in ("score", "score_b")]
    capture = evl.paired_capture_difference(money, "score", "score_b", "at_risk", "claim_sk", 0.10).withColumn(
        "point", share[0].scalar() - share[1].scalar()
    )
    return rel.union_labelled({"auc": one, "auc_difference": pair, "capture_difference": capture}, "metric")


QUERIES = {
    f.__name__: f
    for f in (
        auc_ap_brier, slices, dollar_capture, calibration, calibration_error, threshold_cost, threshold_capacity,
        sensitivity, break_even, concentration, value_bands, risk_bands, group_rate, base_rate, work_queue,
        work_queue_arrival, queue_guarantee, queue_page, month_queues, month_snapshots, recovery_ratio, rule_compare, rule_differences,
        probability_source, headline, imputation, mi_dependency, feature_auc, null_auc, identifiers, lineage, score_all,
        model_metrics, gbt, training_run, score_requests, global_drivers, linear_drivers, driver_reasons, bootstrap_ci,
    )
}
