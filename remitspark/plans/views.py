"""The enriched base and the eight KPI views.

Every view takes the enriched base (one row per claim, appeal totals already attached at claim
grain) and is one aggregation over it; rates are exact decimals rounded half up.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures as m
from ..functions.inline import values_frame
from ..functions.measures import grouped
from ..operators import relational as rel
from ..operators.ordering import ntile_of, with_position
from .roles import with_claim_flags

# Label, sort key and upper day of each aging bucket.
AGING_BUCKETS = [("0-30", 1, 30), ("31-60", 2, 60), ("61-90", 3, 90), ("91-120", 4, 120), ("120+", 5, None)]
# Monitored features and their kind.
MONITORED = {
    "auth_required_rate": "pre_submission_feature",
    "auth_missing_rate": "pre_submission_feature",
    "eligibility_failed_rate": "pre_submission_feature",
    "documentation_complete_rate": "pre_submission_feature",
    "coding_specificity_deficit_rate": "pre_submission_feature",
    "duplicate_submission_rate": "pre_submission_feature",
    "avg_documentation_score": "pre_submission_feature",
    "avg_coding_complexity_score": "pre_submission_feature",
    "denial_rate": "outcome_rate",
}
PRIORITY_AGE_CAP_DAYS = 365
LOW_VOLUME_CLAIMS = 10


# Claim-grain aggregates of the appeal table.
APPEAL_TOTALS = {
    "sim_appeal_levels": "count(1)",
    "any_overturned": "bool_or(sim_appeal_outcome = 'OVERTURNED')",
    "recovered_amt": "sum(sim_appeal_recovered_amount)",
}
_APPEALED = "sim_appeal_levels is not null"
_OVERTURNED = "coalesce(any_overturned, false)"


def enriched_claims(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per claim from the star schema.

    Required: ``claims`` (fact), ``providers``, ``drgs``, ``discharge_statuses``, ``calendar``,
    ``adjudication``, ``payers``, ``service_lines``. Optional: ``authorization``,
    ``documentation``, ``costs``, ``facilities``, ``codes``, ``diagnoses``, ``appeals``. Inner
    joins follow the dimensions and the one-to-one outcome; display and one-to-one extras are
    left joins; the many-per-claim tables are reduced to claim grain first.
    """
    t = tables
    fact = t["claims"]
    calendar = t["calendar"].select("date_key", "full_date")
    df = fact.join(t["providers"], "provider_key").join(t["drgs"], "drg_key")
    if "discharge_statuses" in t:
        df = df.join(t["discharge_statuses"], "discharge_status_key")
    for role in ("admission", "discharge"):
        side = calendar.select(
            F.col("date_key").alias(f"{role}_date_key"), F.col("full_date").alias(f"{role}_date")
        )
        df = df.join(side, f"{role}_date_key")
    df = df.join(t["adjudication"], "claim_sk")
    df = df.join(t["payers"], "sim_payer_id").join(t["service_lines"], "sim_service_line_id")
    for extra in ("authorization", "documentation", "costs"):
        if extra in t:
            df = df.join(t[extra], "claim_sk", "left")
    if "facilities" in t:
        df = df.join(t["facilities"], "prvdr_num", "left")
    if "codes" in t:
        df = rel.describe_codes(
            df,
            t["codes"],
            "code",
            "long_desc",
            {"prncpal_dgns_cd": "prncpal_dgns_desc", "admtg_dgns_cd": "admtg_dgns_desc"},
        )
    if "diagnoses" in t:
        df = rel.aggregate_then_join(df, t["diagnoses"], "claim_sk", {"diagnosis_count": "count(1)"})
    if "appeals" in t:
        df = rel.aggregate_then_join(df, t["appeals"], "claim_sk", APPEAL_TOTALS)
    return with_claim_flags(df.withColumn("sim_submission_year_month", F.date_format("sim_submission_date", "yyyy-MM")))


def as_of_date(claims: DataFrame) -> DataFrame:
    """One row: the latest adjudication, payment or review date, nulls ignored."""
    return grouped(
        claims,
        [],
        as_of_date="greatest(max(sim_adjudication_date), max(sim_payment_date), max(sim_denial_review_date))",
    )


def executive_monthly(e: DataFrame) -> DataFrame:
    return grouped(
        e,
        ["sim_submission_year_month"],
        sim_month_start="min(sim_submission_date)",
        sim_claims_submitted="count(1)",
        sim_denied_claims="count_if(sim_denial_flag)",
        sim_clean_claims="count_if(sim_clean_claim_flag)",
        sim_first_pass_paid_claims="count_if(sim_first_pass_paid_flag)",
        sim_denial_rate=m.rate_where("sim_denial_flag"),
        sim_clean_claim_rate=m.rate_where("sim_clean_claim_flag"),
        sim_first_pass_paid_rate=m.rate_where("sim_first_pass_paid_flag"),
        sim_late_filing_rate=m.rate_where("sim_late_filing_flag"),
        billed_charge_amt=m.money_sum("billed_charge_amt"),
        medicare_source_paid_amt=m.money_sum("medicare_source_paid_amt"),
        sim_allowed_amt=m.money_sum("sim_allowed_amount"),
        sim_paid_amt=m.money_sum("sim_paid_amount"),
        sim_denied_amt=m.money_sum("sim_denied_amount"),
        sim_net_collection_rate=m.ratio("sum(sim_paid_amount)", "sum(sim_allowed_amount)"),
        sim_avg_days_to_payment=m.mean_of("sim_days_to_payment"),
        sim_avg_days_to_adjudication=m.mean_of("sim_days_to_adjudication"),
        sim_claims_appealed=f"count_if({_APPEALED})",
        sim_claims_overturned=f"count_if({_OVERTURNED})",
        sim_appeal_overturn_rate=m.rate_among(_OVERTURNED, _APPEALED),
        sim_appeal_recovered_amt=m.money_sum_or_zero("recovered_amt"),
        sim_cost_to_collect=m.money_sum(_COST),
        sim_cost_to_collect_ratio=m.ratio(f"sum({_COST})", "sum(sim_paid_amount)"),
    )


_COST = "cast(sim_total_cost_to_collect as decimal(18,2))"
_REWORK = "cast(sim_denial_rework_cost as decimal(18,2))"


def denial_root_cause(e: DataFrame, carc_labels: DataFrame | None = None) -> DataFrame:
    """Category x code group x driver; the share is taken over the small grouped result."""
    out = grouped(
        e.where("sim_denial_flag"),
        ["sim_denial_category", "sim_denial_carc_group", "sim_denial_driver_mechanism"],
        sim_denial_count="count(1)",
        sim_full_denials="count_if(sim_denial_type = 'FULL')",
        sim_partial_denials="count_if(sim_denial_type = 'PARTIAL')",
        sim_denied_amt=m.money_sum("sim_denied_amount"),
        sim_avg_denied_amt=m.mean_of("sim_denied_amount", 2),
        sim_rework_cost=m.money_sum(_REWORK),
        sim_claims_appealed=f"count_if({_APPEALED})",
        sim_appeal_rate=m.rate_where(_APPEALED),
        sim_claims_overturned=f"count_if({_OVERTURNED})",
        sim_overturn_rate_of_appealed=m.rate_among(_OVERTURNED, _APPEALED),
        sim_recovered_amt=m.money_sum_or_zero("recovered_amt"),
    ).selectExpr(
        "*", f"{m.count_ratio('sim_denial_count', 'sum(sim_denial_count) over ()')} as sim_share_of_denials"
    )
    if carc_labels is not None:
        side = carc_labels.selectExpr("carc_code as sim_denial_carc_group", "category_label as carc_category_label")
        out = out.join(side, "sim_denial_carc_group", "left")
    return out


def aging_spine(spark: SparkSession) -> DataFrame:
    return values_frame(
        spark, [(label, sort) for label, sort, _ in AGING_BUCKETS], "sim_aging_bucket string, bucket_sort int"
    )


def aging_sort(days: str) -> str:
    """SQL text: sort key of the bucket a number of days falls in; negative days are in the first."""
    whens = " ".join(f"when {days} <= {upper} then {sort}" for _, sort, upper in AGING_BUCKETS if upper is not None)
    return f"case {whens} else {AGING_BUCKETS[-1][1]} end"


def ar_aging(e: DataFrame) -> DataFrame:
    """Open claims per age bucket. Grouped before the spine join, so five rows meet five rows."""
    open_claims = (
        e.where("sim_ar_open_flag")
        .withColumn("_as_of", as_of_date(e).scalar())
        .selectExpr("*", "datediff(_as_of, sim_submission_date) as _days")
        .selectExpr("*", f"{aging_sort('_days')} as bucket_sort")
    )
    by_bucket = grouped(
        open_claims,
        ["bucket_sort"],
        _n="count(1)",
        _denied="count_if(sim_denial_flag)",
        _other="count_if(not sim_denial_flag)",
        _balance=m.money_sum("sim_ar_balance_amt"),
        _billed=m.money_sum("billed_charge_amt"),
        sim_avg_days_outstanding=m.mean_of("_days"),
        sim_min_days_outstanding="min(_days)",
        sim_max_days_outstanding="max(_days)",
    )
    return rel.spine_join(aging_spine(e.sparkSession), by_bucket, "bucket_sort").selectExpr(
        "sim_aging_bucket",
        "bucket_sort",
        "coalesce(_n, 0) as sim_open_claims",
        "coalesce(_denied, 0) as sim_denied_open_claims",
        "coalesce(_other, 0) as sim_nondenied_open_claims",
        "coalesce(_balance, 0) as sim_ar_balance_amt",
        "coalesce(_billed, 0) as sim_source_billed_at_risk_amt",
        "sim_avg_days_outstanding",
        "sim_min_days_outstanding",
        "sim_max_days_outstanding",
    )


def payer_performance(e: DataFrame) -> DataFrame:
    """Payer KPIs. Days are integers, so the exact median's state holds one entry per day at most."""
    return grouped(
        e,
        ["sim_payer_id", "sim_payer_name"],
        sim_payer_mix_share_config="max(sim_payer_mix_share)",
        sim_timely_filing_days="max(sim_timely_filing_days)",
        sim_claims="count(1)",
        sim_denied_claims="count_if(sim_denial_flag)",
        sim_denial_rate=m.rate_where("sim_denial_flag"),
        sim_clean_claim_rate=m.rate_where("sim_clean_claim_flag"),
        sim_late_filing_rate=m.rate_where("sim_late_filing_flag"),
        sim_source_billed_amt=m.money_sum("billed_charge_amt"),
        sim_allowed_amt=m.money_sum("sim_allowed_amount"),
        sim_paid_amt=m.money_sum("sim_paid_amount"),
        sim_net_collection_rate=m.ratio("sum(sim_paid_amount)", "sum(sim_allowed_amount)"),
        sim_paid_to_billed_ratio=m.ratio("sum(sim_paid_amount)", "sum(billed_charge_amt)"),
        sim_avg_days_to_payment=m.mean_of("sim_days_to_payment"),
        sim_median_days_to_payment="round(percentile(sim_days_to_payment, 0.5), 1)",
        sim_avg_days_to_adjudication=m.mean_of("sim_days_to_adjudication"),
        sim_claims_appealed=f"count_if({_APPEALED})",
        sim_appeal_overturn_rate=m.rate_among(_OVERTURNED, _APPEALED),
        sim_appeal_recovered_amt=m.money_sum_or_zero("recovered_amt"),
        sim_cost_to_collect=m.money_sum(_COST),
    ).selectExpr("*", f"{m.count_ratio('sim_claims', 'sum(sim_claims) over ()')} as sim_realized_claim_share")


def provider_quality(e: DataFrame) -> DataFrame:
    display = [c for c in ("sim_facility_ccn", "sim_facility_name", "sim_facility_state") if c in e.columns]
    return grouped(
        e,
        ["prvdr_num"],
        provider_state_cd="max(provider_state_cd)",
        **{c.replace("sim_", "sim_display_", 1): f"max({c})" for c in display},
        sim_provider_claims="count(1)",
        sim_clean_claims="count_if(sim_clean_claim_flag)",
        sim_first_pass_paid_claims="count_if(sim_first_pass_paid_flag)",
        sim_denied_claims="count_if(sim_denial_flag)",
        sim_clean_claim_rate=m.rate_where("sim_clean_claim_flag"),
        sim_first_pass_paid_rate=m.rate_where("sim_first_pass_paid_flag"),
        sim_denial_rate=m.rate_where("sim_denial_flag"),
        sim_late_filing_rate=m.rate_where("sim_late_filing_flag"),
        sim_rework_rate=m.rate_where("sim_denial_rework_cost > 0"),
        source_billed_amt=m.money_sum("billed_charge_amt"),
        sim_paid_amt=m.money_sum("sim_paid_amount"),
        sim_rework_cost=m.money_sum(_REWORK),
        low_volume_flag=f"count(1) < {LOW_VOLUME_CLAIMS}",
    )


ACTION_TYPE = """case
    when sim_denial_flag and coalesce(sim_appeal_levels, 0) = 0 then 'DENIAL_REWORK'
    when sim_denial_flag and sim_appeal_levels > 0 and not any_overturned then 'APPEAL_REVIEW'
    when sim_denial_flag then 'DENIAL_RESOLVED_MONITOR'
    else 'AR_FOLLOWUP' end"""


def age_weighted_score(dollars: str, age_days: str, cap: int = PRIORITY_AGE_CAP_DAYS) -> str:
    """SQL text: dollars * (1 + clipped age / cap), rounded to cents in exact arithmetic."""
    return f"round({dollars} * cast({cap} + least(greatest({age_days}, 0), {cap}) as decimal(10,0)) / {cap}, 2)"


def heuristic_queue(e: DataFrame, tiles: int = 4) -> DataFrame:
    """Actionable claims ranked by dollars weighted by age, with a quartile tier."""
    age = "datediff(_as_of, sim_submission_date)"
    stake = "if(sim_denial_flag, sim_denied_amount, sim_ar_balance_amt)"
    scored = (
        e.where("sim_denial_flag or sim_ar_open_flag")
        .withColumn("_as_of", as_of_date(e).scalar())
        .selectExpr(
            "claim_sk",
            "clm_id",
            "prvdr_num",
            *[c for c in ("sim_facility_name",) if c in e.columns],
            "sim_payer_id",
            f"{ACTION_TYPE} as sim_action_type",
            "sim_denial_flag",
            "sim_denial_category",
            "sim_denial_type",
            "sim_ar_open_flag",
            f"{age} as sim_age_days",
            f"round({stake}, 2) as sim_dollars_at_stake",
            f"{age_weighted_score(stake, age)} as sim_heuristic_priority_score",
            "coalesce(sim_appeal_levels, 0) as sim_appeal_levels",
            "true as is_heuristic_placeholder",
        )
    )
    placed = with_position(scored, [F.col("sim_heuristic_priority_score").desc(), "claim_sk"], "_pos", total="_n")
    return placed.withColumn("sim_priority_tier", F.expr(ntile_of("_pos", "_n", tiles))).drop("_pos", "_n")


def drift_monthly(e: DataFrame) -> DataFrame:
    """Nine monthly rates, computed in one aggregation and turned long."""
    rates = {
        "auth_required_rate": m.rate_where("sim_auth_required", 6),
        "auth_missing_rate": m.rate_where("sim_auth_missing", 6),
        "eligibility_failed_rate": m.rate_where("sim_eligibility_failed", 6),
        "documentation_complete_rate": m.rate_where("sim_documentation_complete", 6),
        "coding_specificity_deficit_rate": m.rate_where("sim_coding_specificity_deficit", 6),
        "duplicate_submission_rate": m.rate_where("sim_duplicate_submission_flag", 6),
        "avg_documentation_score": m.mean_of("sim_documentation_score", 6),
        "avg_coding_complexity_score": m.mean_of("sim_coding_complexity_score", 6),
        "denial_rate": m.rate_where("sim_denial_flag", 6),
    }
    wide = grouped(
        e,
        ["sim_submission_year_month"],
        sim_n_claims="count(1)",
        **{name: f"cast({sql} as decimal(18,6))" for name, sql in rates.items()},
    )
    kinds = ", ".join(f"'{name}', '{kind}'" for name, kind in MONITORED.items())
    return wide.unpivot(
        ["sim_submission_year_month", "sim_n_claims"], list(rates), "feature_name", "sim_metric_value"
    ).selectExpr(
        "sim_submission_year_month",
        "feature_name",
        f"map({kinds})[feature_name] as metric_kind",
        "sim_n_claims",
        "sim_metric_value",
        "true as is_drift_scaffold",
    )
