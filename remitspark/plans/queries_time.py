"""Prior-period rates, splits, event log, process mining and survival queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import rounded
from ..operators import events as ev
from ..operators import relational as rel
from ..operators import casemix, concordance as conc, splits, stats, survival
from ..operators.history import add_prior_rates
from . import views
from ..session import pin
from .features import SUBMISSION_FEATURES, submission_claims, triage_frame
from .roles import claims, event_log, table


def prior_rates(spark: SparkSession, d: str) -> DataFrame:
    """Payer, provider and service-line denial rates known 60 days before each claim."""
    rows = claims(spark, d, payer=True, drg=True).selectExpr(
        "claim_sk", "sim_submission_date", "cast(sim_denial_flag as int) as denied", "sim_payer_id", "prvdr_num",
        "sim_service_line_id",
    )
    # each entity's history reads the rows again, so the narrow rows are written once
    return add_prior_rates(
        pin(rows), "sim_submission_date", "denied",
        {"payer": "sim_payer_id", "provider": "prvdr_num", "line": "sim_service_line_id"},
    ).drop("sim_payer_id", "prvdr_num", "sim_service_line_id")


def triage_rates(spark: SparkSession, d: str) -> DataFrame:
    """Overturn rates at denial triage; claims nobody appealed add no history."""
    return triage_frame(claims(spark, d, payer=True)).select(
        "claim_sk", "appealed", "sim_denial_review_lag_days", "sim_payer_prior_overturn_rate", "sim_payer_prior_appeals",
        "sim_category_prior_overturn_rate", "sim_category_prior_appeals", "sim_overall_prior_overturn_rate",
    )


def asof_balance(spark: SparkSession, d: str) -> DataFrame:
    """Latest shipped total of the supplier up to 30 days before each order's submission."""
    per_day = table(spark, d, "lineitem").groupBy(
        F.expr("l_suppkey as provider_key"), F.expr("datediff(cast(l_shipdate as date), date'1970-01-01') as day")
    ).agg(F.expr("count(1) as shipped"), F.expr("sum(cast(l_quantity as bigint)) as quantity"))
    left = claims(spark, d).selectExpr(
        "claim_sk", "provider_key", "datediff(sim_submission_date, date'1970-01-01') as asked_day"
    )
    return rel.asof_backward(left, per_day, "provider_key", "asked_day", "day", ["shipped", "quantity"], 30)


def submission_features(spark: SparkSession, d: str) -> DataFrame:
    """The declared submission-time matrix, summarised per column."""
    df = submission_claims(spark, d)
    numeric = [*SUBMISSION_FEATURES.numeric]
    items = ", ".join(f"struct('{c}' as feature, cast({c} as double) as v)" for c in numeric)
    return rounded(
        df.selectExpr(f"inline(array({items}))").groupBy("feature").agg(
            F.expr("count(v) as present"), F.expr("min(v) as lo"), F.expr("max(v) as hi")
        ),
        6,
    )


def pit_invariance(spark: SparkSession, d: str) -> DataFrame:
    """Past rows must not move when future outcomes are flipped: (past_rows, changed_rows)."""
    rows = claims(spark, d, payer=True).selectExpr(
        "claim_sk", "sim_submission_date", "cast(sim_denial_flag as int) as denied", "sim_payer_id"
    )
    cut = "date'1999-01-01'"
    past = f"sim_submission_date < {cut}"

    rows = pin(rows)
    flipped = rows.withColumn("denied", F.expr(f"if(sim_submission_date >= {cut}, 1 - denied, denied)"))

    def features(df: DataFrame) -> DataFrame:
        return add_prior_rates(df, "sim_submission_date", "denied", {"payer": "sim_payer_id"}).where(past)

    changed = rel.bag_difference(features(rows), features(flipped)).agg(F.expr("count(1) as n"))
    return rows.where(past).agg(F.expr("count(1) as past_rows")).withColumn("changed_rows", changed.scalar())


def temporal_split(spark: SparkSession, d: str) -> DataFrame:
    rows = claims(spark, d).select("claim_sk", "sim_submission_date", "sim_denial_flag")
    split = splits.nested_split(rows, "sim_submission_date")
    return splits.split_evidence(split.selectExpr("*", "cast(sim_denial_flag as int) as y"), "sim_submission_date", "y")


def forward_folds(spark: SparkSession, d: str) -> DataFrame:
    rows = claims(spark, d).select("claim_sk", "sim_submission_date")
    return splits.forward_folds(rows, "sim_submission_date").groupBy("fold_no", "cut_date", "role").agg(
        F.expr("count(1) as fold_rows"), F.expr("min(sim_submission_date) as first_date"),
        F.expr("max(sim_submission_date) as last_date"),
    )


def trespass(spark: SparkSession, d: str) -> DataFrame:
    """A split by claim number is not temporal; the probe says how far."""
    rows = claims(spark, d).selectExpr("sim_submission_date", "if(claim_sk % 5 = 0, 'test', 'train') as fold")
    return splits.temporal_trespass(rows, "sim_submission_date")


# ---------------------------------------------------------------- events


def pit_events(spark: SparkSession, d: str) -> DataFrame:
    """Minutes and hours before each case's first purchase."""
    return ev.totals_before_boundary(event_log(spark, d), "case_id", "ts", "event_type", "purchase", "minutes")


def event_log_build(spark: SparkSession, d: str) -> DataFrame:
    """Claim timelines turned into a numbered, time-stamped event log with a closing event."""
    return claim_log(spark, d).selectExpr(
        "claim_sk", "event_type", "event_date", "event_seq", "cast(event_ts as string) as event_ts"
    )


# Event type -> rank within a day and date of a claim; the recovery is posted for claims with an appeal that was overturned.
CLAIM_TIMELINE = {
    "CODING_COMPLETE": (1, "service_date"),
    "CLAIM_SUBMITTED": (2, "sim_submission_date"),
    "ADJUDICATED": (3, "sim_adjudication_date"),
    "DENIAL_REVIEWED": (4, "sim_denial_review_date"),
    "PAYMENT_POSTED": (5, "sim_payment_date"),
}
RECOVERY = {"APPEAL_RECOVERY_POSTED": (6, "sim_denial_review_date")}
CLOSING = ("CLAIM_CLOSED", 9, 3)


def claim_log(spark: SparkSession, d: str) -> DataFrame:
    c = claims(spark, d)
    recovered = c.where("any_overturned").select("claim_sk", F.inline(ev.timeline_rows(RECOVERY)))
    return ev.timeline_to_events(c, "claim_sk", CLAIM_TIMELINE, extra=recovered, closing=CLOSING)


def event_order(spark: SparkSession, d: str) -> DataFrame:
    """Order checks of the event stream: non-increasing neighbours and gaps in numbering."""
    log = ev.number_events(event_log(spark, d), "case_id", ["event_id"], "seq")
    late = ev.not_increasing(log, "case_id", "seq", "ts").agg(F.expr("count(1) as n"))
    gaps = ev.sequence_gaps(log, "case_id", "seq").agg(F.expr("count(1) as n"))
    return (
        log.agg(F.expr("count(1) as events"), F.expr("count(distinct case_id) as cases"))
        .withColumn("not_increasing", late.scalar())
        .withColumn("gap_cases", gaps.scalar())
    )


def variants(spark: SparkSession, d: str) -> DataFrame:
    return ev.path_variants(event_log(spark, d), "case_id", ["ts", "event_id"], "event_type")


def rework(spark: SparkSession, d: str) -> DataFrame:
    return ev.rework_funnel(
        event_log(spark, d), "case_id", "event_type",
        {"rework": ["error", "purchase"], "error": ["error"], "purchase": ["purchase"]},
    )


def bottleneck(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.bottlenecks(event_log(spark, d), "event_type", "minutes"), 6)


def automation(spark: SparkSession, d: str) -> DataFrame:
    return ev.automation_split(event_log(spark, d), "event_type", "view")


def activity_shares(spark: SparkSession, d: str) -> DataFrame:
    return ev.activity_shares(event_log(spark, d), "event_type")


ACTIVITIES = ("click", "error", "purchase", "signup", "view")


def cost_pivot(spark: SparkSession, d: str) -> DataFrame:
    pivoted = ev.minutes_by_activity(event_log(spark, d), "case_id", "event_type", "minutes", ACTIVITIES)
    return ev.operating_costs(pivoted, {"error": "36.00", "signup": "24.00"}, {"purchase": "1.25"})


# ---------------------------------------------------------------- survival and tests


SURVIVAL_DATES = ("sim_submission_date", "sim_payment_date", "sim_adjudication_date")


def _survival(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The survival frame with some more columns; claims are derived once, for the snapshot date and for the rows."""
    c = pin(claims(spark, d, payer="sim_payer_id" in columns).select(*SURVIVAL_DATES, *columns))
    return survival.survival_frame(c, *SURVIVAL_DATES[:2], SURVIVAL_DATES[2:])


def km(spark: SparkSession, d: str) -> DataFrame:
    return rounded(survival.kaplan_meier(_survival(spark, d)), 9)


def km_by_payer(spark: SparkSession, d: str) -> DataFrame:
    curve = survival.kaplan_meier(_survival(spark, d, "sim_payer_id"), groups=["sim_payer_id"])
    return rounded(survival.paid_by(curve, [30, 60, 90, 120], ["sim_payer_id"]), 9)


def chi2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.chi_square(claims(spark, d, payer=True), "sim_payer_id", "sim_denial_flag"), 6)


def chi2_two_by_two(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.chi_square(claims(spark, d), "sim_auth_missing", "sim_denial_flag"), 6)


def crosstab(spark: SparkSession, d: str) -> DataFrame:
    return stats.crosstab(claims(spark, d, payer=True), "sim_payer_id", "sim_denial_type")


def kruskal(spark: SparkSession, d: str) -> DataFrame:
    paid = claims(spark, d, payer=True).where("sim_days_to_payment is not null")
    return rounded(stats.kruskal_wallis(paid, "sim_payer_id", "sim_days_to_payment"), 6)


def payment_days(spark: SparkSession, d: str) -> DataFrame:
    return stats.group_summary(claims(spark, d, payer=True), "sim_payer_id", "sim_days_to_payment")


def describe_denied(spark: SparkSession, d: str) -> DataFrame:
    rows = claims(spark, d).where("sim_denial_flag")
    return rounded(stats.describe(rows, "sim_denied_amount"), 4)


CASE_FLAGS = ("sim_auth_missing", "sim_eligibility_failed", "doc_incomplete")
CASE_FACTORS = ("sim_payer_id", "sim_service_line_id")


def _case_rows(spark: SparkSession, d: str) -> DataFrame:
    return pin(claims(spark, d, payer=True, drg=True).selectExpr(
        "prvdr_num", "cast(sim_denial_flag as int) as y", "cast(sim_auth_missing as int) as sim_auth_missing",
        "cast(sim_eligibility_failed as int) as sim_eligibility_failed",
        "cast(not sim_documentation_complete as int) as doc_incomplete", *CASE_FACTORS,
    ))


def oe_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Observed against expected denials per provider, expected from a logistic case-mix model without a provider term."""
    c = _case_rows(spark, d)
    model = casemix.fit_case_mix(c, "y", CASE_FLAGS, CASE_FACTORS)
    known = c.withColumn("p", model.probability()).where("p is not null")
    return rounded(stats.observed_expected(known, "prvdr_num", "y", "p"), 6)


def case_mix_model(spark: SparkSession, d: str) -> DataFrame:
    """The case-mix model: coefficients with errors, and each term's score equation (observed and expected denials)."""
    c = _case_rows(spark, d)
    model = casemix.fit_case_mix(c, "y", CASE_FLAGS, CASE_FACTORS)
    errors = model.covariance.diagonal() ** 0.5
    rows = [(t, float(b), float(e), float(model.pseudo_r2)) for t, b, e in zip(model.terms, model.coefficients, errors)]
    fitted = spark.createDataFrame(rows, "term string, coef double, se double, pseudo_r2 double")
    return rounded(fitted.join(casemix.score_equations(c, "y", CASE_FLAGS, CASE_FACTORS, model), "term"), 6)


def segmented_trend(spark: SparkSession, d: str) -> DataFrame:
    """Segmented monthly denial-rate trend with Newey-West errors."""
    monthly = views.executive_monthly(claims(spark, d, payer=True))
    frame = stats.segmented_frame(monthly, "sim_submission_year_month", "sim_denial_rate")
    return rounded(stats.segmented_regression(frame), 6)


def logit_or(spark: SparkSession, d: str) -> DataFrame:
    c = claims(spark, d, payer=True, drg=True)
    return rounded(
        stats.adjusted_logit(
            c, "sim_denial_flag", ["sim_auth_missing", "sim_coding_specificity_deficit", "sim_documentation_complete"],
            ["sim_payer_id", "sim_service_line_id"],
        ),
        5,
    )


COX = ("sim_auth_missing", "sim_documentation_complete", "line_count")


def _cox_rows(spark: SparkSession, d: str) -> DataFrame:
    """Claims of equal time, outcome, payer and covariates as one row: what the fits and rankings read does not grow with the claims."""
    rows = _survival(spark, d, "sim_payer_id", "sim_auth_missing", "sim_documentation_complete", "line_count").selectExpr(
        "dur", "event", "sim_payer_id", "cast(sim_auth_missing as int) as sim_auth_missing",
        "cast(sim_documentation_complete as int) as sim_documentation_complete", "line_count",
    )
    return pin(survival.merged_rows(rows, ["dur", "event", "sim_payer_id", *COX], "claims"))


def cox(spark: SparkSession, d: str) -> DataFrame:
    """Naive and payer-stratified Cox fits, with the concordance of each fit's risk score."""
    rows = _cox_rows(spark, d)
    fits = {}
    for name, strata in (("naive", None), ("stratified", "sim_payer_id")):
        fit = pin(survival.cox_regression(rows, "dur", "event", COX, strata=strata, weight="claims"))
        risk = " + ".join(f"({r['coef']!r}D * {r['covariate']})" for r in fit.collect())  # one row a covariate
        index = conc.concordance(rows.withColumn("risk", F.expr(risk)), "dur", "event", "risk", weight="claims")
        fits[name] = fit.withColumn("concordance", index.select("concordance").scalar())
    return rel.union_labelled(fits, "fit")


RISK_SCORES = {
    "flags": "2 * cast(sim_auth_missing as int) + cast(not sim_documentation_complete as int)",
    "lines": "-line_count",
    "billed": "-cast(billed_charge_amt as double)",
}


def concordance(spark: SparkSession, d: str) -> DataFrame:
    """Harrell's concordance of three risk scores with the time to payment: few values, some, and one for each claim."""
    base = _survival(spark, d, "sim_auth_missing", "sim_documentation_complete", "line_count", "billed_charge_amt")
    rows = pin(base.selectExpr("dur", "event", *[f"{sql} as {name}" for name, sql in RISK_SCORES.items()]))
    return rounded(rel.union_labelled({name: conc.concordance(rows, "dur", "event", name) for name in RISK_SCORES}, "risk_score"), 9)


def ph_check(spark: SparkSession, d: str) -> DataFrame:
    rows = _cox_rows(spark, d)
    fit = survival.cox_regression(rows, "dur", "event", COX, weight="claims")
    coefs = {r["covariate"]: r["coef"] for r in fit.collect()}
    return survival.schoenfeld_check(rows, "dur", "event", COX, [coefs[c] for c in COX], weight="claims")


QUERIES = {
    f.__name__: f
    for f in (
        prior_rates, triage_rates, asof_balance, submission_features, pit_invariance, temporal_split, forward_folds,
        trespass, pit_events, event_log_build, event_order, variants, rework, bottleneck, automation, activity_shares,
        cost_pivot, km, km_by_payer, chi2, chi2_two_by_two, crosstab, kruskal, payment_days, describe_denied, oe_funnel,
        case_mix_model, segmented_trend, logit_or, cox, concordance, ph_check,
    )
}
