"""Feature frames: facts known at submission, facts known at denial triage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.events import totals_before_boundary
from ..operators.history import add_prior_rates
from ..operators.modeling import FeatureSpec
from ..operators.relational import aggregate_then_join, project
from ..session import pin
from .roles import claims

# Embargo and smoothing of the prior-period rates.
EMBARGO_DAYS = 60
APPEAL_EMBARGO_DAYS = 180
SMOOTHING = 20.0
LABEL = "sim_denial_flag"
TIME = "sim_submission_date"

# The 39 declared submission-time inputs.
CLAIM_FEATURES = FeatureSpec(
    numeric=(
        "sim_documentation_score", "sim_coding_complexity_score", "sim_days_service_to_submission",
        "sim_filing_limit_days", "billed_charge_amt", "length_of_stay_days", "diagnosis_count", "log_billed_charge_amt",
        "patient_age_years", "sim_filing_headroom_days", "sim_filing_use_ratio", "sim_coding_lag_days",
        "sim_auth_decision_lead_days", "sim_pre_submission_touch_minutes", "sim_coding_to_submission_hours",
        "sim_overall_prior_denial_rate", "sim_payer_prior_denial_rate", "sim_payer_prior_claims",
        "sim_provider_prior_denial_rate", "sim_provider_prior_claims", "sim_service_line_prior_denial_rate",
        "sim_service_line_prior_claims",
    ),
    boolean=(
        "sim_auth_required", "sim_auth_obtained", "sim_auth_missing", "sim_auth_obtained_late", "sim_eligibility_checked",
        "sim_eligibility_failed", "sim_secondary_payer_present", "sim_documentation_complete",
        "sim_coder_query_outstanding", "sim_coding_specificity_deficit", "sim_duplicate_submission_flag",
        "sim_late_filing_flag",
    ),
    categorical=("sim_payer_id", "sim_service_line_id", "drg_cd", "provider_state_cd", "sim_submission_month"),
)
# Inputs the derived claims cannot fill (no such facts in the order tables).
NOT_DERIVED = (
    "patient_age_years", "sim_auth_decision_lead_days", "sim_pre_submission_touch_minutes",
    "sim_coding_to_submission_hours", "sim_eligibility_checked", "sim_secondary_payer_present",
    "sim_coder_query_outstanding",
)


def without(spec: FeatureSpec, names: Sequence[str]) -> FeatureSpec:
    """The declaration less some inputs."""
    return FeatureSpec(
        *[tuple(c for c in part if c not in names) for part in (spec.numeric, spec.boolean, spec.categorical)]
    )


SUBMISSION_FEATURES = without(CLAIM_FEATURES, NOT_DERIVED)
PASSTHROUGH = ("claim_sk", TIME, LABEL, "sim_denied_amount")

# engineered column -> (SQL, columns it needs)
ENGINEERED = {
    "log_billed_charge_amt": ("log1p(cast(billed_charge_amt as double))", ("billed_charge_amt",)),
    "patient_age_years": (
        "round(cast(datediff(admission_date, birth_date) as decimal(18,4)) / 365.25, 2)", ("admission_date", "birth_date"),
    ),
    "sim_filing_headroom_days": (
        "sim_filing_limit_days - sim_days_service_to_submission", ("sim_filing_limit_days", "sim_days_service_to_submission"),
    ),
    "sim_filing_use_ratio": (
        "sim_days_service_to_submission / nullif(sim_filing_limit_days, 0)",
        ("sim_filing_limit_days", "sim_days_service_to_submission"),
    ),
    "sim_coding_lag_days": (f"datediff({TIME}, sim_coded_date)", ("sim_coded_date",)),
    "sim_auth_decision_lead_days": (f"datediff({TIME}, sim_auth_decision_date)", ("sim_auth_decision_date",)),
    "sim_submission_month": (f"cast(month({TIME}) as string)", (TIME,)),
}


def submission_source(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Claim-grain facts known at submission, from the star schema.

    ``tables``: adjudication, authorization, documentation, claims, providers, drgs,
    beneficiaries, calendar, diagnoses, events. Diagnoses and events are reduced to one row per
    claim first; events later than the claim's own submission event are never summed.
    """
    t = tables
    admissions = t["calendar"].selectExpr("date_key as admission_date_key", "full_date as admission_date")
    effort = totals_before_boundary(
        t["events"], "claim_sk", "sim_event_ts", "sim_event_type", "CLAIM_SUBMITTED", "sim_touch_minutes"
    ).withColumnsRenamed(
        {"touch_minutes": "sim_pre_submission_touch_minutes", "elapsed_hours": "sim_coding_to_submission_hours"}
    )
    df = t["adjudication"]
    for name, key in (("authorization", "claim_sk"), ("documentation", "claim_sk"), ("claims", "claim_sk"),
                      ("providers", "provider_key"), ("drgs", "drg_key"), ("beneficiaries", "bene_key")):
        df = df.join(t[name], key)
    df = df.join(admissions, "admission_date_key", "left")
    df = aggregate_then_join(df, t["diagnoses"], "claim_sk", {"diagnosis_count": "count(1)"})
    return df.join(effort, "claim_sk", "left")


def submission_frame(df: DataFrame, spec: FeatureSpec = SUBMISSION_FEATURES) -> DataFrame:
    """Passthrough columns and exactly the declared inputs, engineered and prior-period ones included."""
    engineered = df.selectExpr(
        "*",
        *[f"{sql} as {name}" for name, (sql, needs) in ENGINEERED.items() if set(needs) <= set(df.columns)],
        f"cast({LABEL} as int) as _outcome",
    )
    rated = add_prior_rates(
        engineered,
        TIME,
        "_outcome",
        {"sim_payer": "sim_payer_id", "sim_provider": "prvdr_num", "sim_service_line": "sim_service_line_id"},
        EMBARGO_DAYS,
        SMOOTHING,
        book="sim_overall_prior_denial_rate",
        names=("{}_prior_denial_rate", "{}_prior_claims", None),
    )
    return project(rated, [*PASSTHROUGH, *spec.names])


def triage_frame(df: DataFrame) -> DataFrame:
    """Denied claims with denial facts and prior overturn rates (null outcome = no history).

    The appeal embargo is longer than the posting cycle because an appeal is decided later.
    """
    billed = "nullif(cast(billed_charge_amt as double), 0D)"
    denied = df.where(LABEL).selectExpr(
        "*",
        "log1p(cast(sim_denied_amount as double)) as sim_log_denied_amount",
        f"cast(sim_denied_amount as double) / {billed} as sim_denied_share_of_billed",
        f"cast(sim_allowed_amount as double) / {billed} as sim_allowed_share_of_billed",
        "datediff(sim_denial_review_date, sim_adjudication_date) as sim_denial_review_lag_days",
        "any_overturned is not null as appealed",
        "cast(any_overturned as int) as _overturned",
    )
    return add_prior_rates(
        denied,
        TIME,
        "_overturned",
        {"sim_payer": "sim_payer_id", "sim_category": "sim_denial_category"},
        APPEAL_EMBARGO_DAYS,
        SMOOTHING,
        book="sim_overall_prior_overturn_rate",
        names=("{}_prior_overturn_rate", "{}_prior_appeals", None),
    ).drop("_overturned")


def submission_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived claims are written once, with the columns that the frame is made of; the book, three entity histories and the folds all read them."""
    needed = {*PASSTHROUGH, *SUBMISSION_FEATURES.names, "prvdr_num", *[c for _, needs in ENGINEERED.values() for c in needs]}
    df = claims(spark, sf_dir, payer=True, provider=True, drg=True)
    return pin(df.select(*[c for c in df.columns if c in needed]))


def submission_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return submission_frame(submission_base(spark, sf_dir))
