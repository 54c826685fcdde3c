"""Answers served from the KPI tables: roll-ups, lookups, reason codes, chart layers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import measures as m
from ..functions.codes import REASON_CODES
from ..functions.inline import literal

# Risk band cut points and names.
RISK_BANDS = ((0.06, "low"), (0.13, "moderate"), (0.26, "elevated"), (None, "high"))
SUMMED = (
    "sim_claims_submitted", "sim_denied_claims", "sim_clean_claims", "sim_first_pass_paid_claims",
    "billed_charge_amt", "medicare_source_paid_amt", "sim_allowed_amt", "sim_paid_amt", "sim_denied_amt",
    "sim_appeal_recovered_amt", "sim_cost_to_collect", "sim_claims_appealed", "sim_claims_overturned",
)


def executive_rollup(monthly: DataFrame) -> DataFrame:
    """Book KPIs from the monthly view: numerators and denominators are summed, then divided.

    The mean days to payment weighs each month that has one by its claims.
    """
    weight = "case when sim_avg_days_to_payment is not null then sim_claims_submitted end"
    sums = monthly.agg(
        F.expr("min(sim_submission_year_month) as sim_period_from"),
        F.expr("max(sim_submission_year_month) as sim_period_to"),
        *[F.expr(f"coalesce(sum({c}), 0) as {c}") for c in SUMMED],
        F.expr(f"sum(cast(sim_avg_days_to_payment as decimal(18,4)) * {weight}) as _days"),
        F.expr(f"sum({weight}) as _weight"),
    )

    def share(a: str, b: str) -> str:
        return f"coalesce({m.ratio(f'cast({a} as decimal(24,4))', f'cast({b} as decimal(24,4))', 6)}, 0)"

    return sums.selectExpr(
        "sim_period_from",
        "sim_period_to",
        "sim_claims_submitted",
        "sim_denied_claims",
        f"{share('sim_denied_claims', 'sim_claims_submitted')} as sim_denial_rate",
        f"{share('sim_clean_claims', 'sim_claims_submitted')} as sim_clean_claim_rate",
        f"{share('sim_first_pass_paid_claims', 'sim_claims_submitted')} as sim_first_pass_paid_rate",
        f"{share('sim_paid_amt', 'sim_allowed_amt')} as sim_net_collection_rate",
        "round(billed_charge_amt, 2) as source_billed_charge_amt",
        "round(sim_allowed_amt, 2) as sim_allowed_amt",
        "round(sim_paid_amt, 2) as sim_paid_amt",
        "round(sim_denied_amt, 2) as sim_denied_amt",
        "round(sim_cost_to_collect, 2) as sim_cost_to_collect",
        f"coalesce({m.ratio('cast(_days as decimal(24,4))', 'cast(_weight as decimal(20,0))', 2)}, 0) as sim_avg_days_to_payment",
        "sim_claims_appealed",
        f"{share('sim_claims_overturned', 'sim_claims_appealed')} as sim_appeal_overturn_rate",
    )


def control_totals(monthly: DataFrame) -> DataFrame:
    """The sums the roll-up must agree with."""
    return monthly.agg(
        F.expr("coalesce(sum(sim_claims_submitted), 0) as sim_sum_claims_submitted"),
        F.expr("coalesce(sum(sim_denied_claims), 0) as sim_sum_denied_claims"),
        F.expr("count(1) as sim_months"),
    )


def category_rollup(root_cause: DataFrame) -> DataFrame:
    """Cross-tab to category grain with appeal and overturn rates from summed counts."""
    return m.grouped(
        root_cause,
        ["sim_denial_category"],
        denials="sum(sim_denial_count)",
        denied_amt="sum(sim_denied_amt)",
        appealed="sum(sim_claims_appealed)",
        overturned="sum(sim_claims_overturned)",
        recovered_amt="sum(sim_recovered_amt)",
    ).selectExpr(
        "*",
        f"{m.count_ratio('appealed', 'denials')} as appeal_rate",
        f"{m.count_ratio('overturned', 'appealed')} as overturn_rate",
    )


def category_overturn_rates(root_cause: DataFrame) -> DataFrame:
    """(category, appealed, overturned, overturn_rate) for categories with appeals."""
    return (
        m.grouped(root_cause, ["sim_denial_category"], appealed="sum(sim_claims_appealed)", overturned="sum(sim_claims_overturned)")
        .where("appealed > 0")
        .selectExpr("*", "overturned / appealed as overturn_rate")
    )


def book_overturn_rates(rates: DataFrame) -> DataFrame:
    """Two different book figures, each under its own name: the plain mean of the category rates,
    and the rate over all appealed claims."""
    return rates.agg(
        F.expr("coalesce(avg(overturn_rate), 0D) as mean_of_category_rates"),
        F.expr("coalesce(sum(overturned) / nullif(sum(appealed), 0), 0D) as pooled_rate"),
    )


def appeal_selection(denied: DataFrame, category: str, amount: str, appealed: str, won: str) -> DataFrame:
    """Who is appealed, per category: volumes, rates, mean amount, overturn rate where there is support."""
    return m.grouped(
        denied,
        [category],
        denials="count(1)",
        appealed_claims=f"count_if({appealed})",
        appeal_rate=f"count_if({appealed}) / count(1)",
        mean_denied_amount=f"cast(sum({amount}) as double) / count({amount})",
        overturn_rate_given_appealed=f"count_if({appealed} and {won}) / nullif(count_if({appealed}), 0)",
        no_training_support=f"count_if({appealed}) = 0",
    )


def headline(root_cause: DataFrame, queue: DataFrame, scorecard: DataFrame) -> DataFrame:
    """Headline figures of the summary tables, one row."""
    a = root_cause.agg(
        F.expr("sum(sim_recovered_amt) as recovered_amt"),
        F.expr("sum(sim_denied_amt) as denied_amt"),
        F.expr("sum(sim_claims_appealed) as appeals_filed"),
        F.expr("sum(sim_claims_overturned) as appeals_overturned"),
    )
    b = queue.agg(
        F.expr("sum(sim_recoverable_amt) as dollars_at_stake"),
        F.expr("sum(if(sim_expected_net_recovery > 0, sim_expected_net_recovery, 0D)) as net_recovery"),
    )
    c = scorecard.agg(
        F.expr("count_if(pass_flag) as checks_passing"),
        F.expr("count_if(not pass_flag and severity = 'critical') as critical_failing"),
    )
    row = a.selectExpr("*", "recovered_amt / nullif(denied_amt, 0) as recovered_share")
    for side in (b, c):
        row = row.select("*", *[side.select(n).scalar().alias(n) for n in side.columns])
    return row


def monitored_series(monitoring: DataFrame, feature: str) -> DataFrame:
    """(month, value, n) of one monitored feature; unparseable months are left out."""
    return (
        monitoring.where(F.col("feature_name") == feature)
        .selectExpr(
            "try_to_date(concat(sim_submission_year_month, '-01'), 'yyyy-MM-dd') as month",
            "sim_metric_value as value",
            "sim_n_claims as n",
        )
        .where("month is not null")
    )


MONITORING_COLUMNS = ("sim_submission_year_month", "feature_name", "sim_metric_value", "sim_n_claims")


def usable_monitoring(frame: DataFrame | None, required: Sequence[str] = MONITORING_COLUMNS) -> tuple[DataFrame | None, str]:
    """Rows with all required fields, or nothing and the reason."""
    if frame is None:
        return None, "no monitoring data"
    missing = [c for c in required if c not in frame.columns]
    if missing:
        return None, f"missing columns: {', '.join(missing)}"
    return frame.dropna(subset=list(required)), ""


def thin_months(monthly: DataFrame, month: str, count: str, ratio: float = 0.25) -> DataFrame:
    """Bands of consecutive months with less than ``ratio`` of the median volume: (start, end).

    Works on one row per month; a gap of more than 62 days starts a new band, and each band is
    extended by 31 days.
    """
    median = monthly.agg(F.expr(f"percentile({count}, 0.5) as m"))
    thin = monthly.withColumn("_m", median.scalar()).where(f"_m > 0 and {count} < _m * {ratio} and {month} is not null")
    runs = thin.selectExpr(
        f"cast({month} as date) as d",
        f"if(datediff(cast({month} as date), lag(cast({month} as date)) over (order by {month})) <= 62, 0, 1) as fresh",
    ).selectExpr("d", "sum(fresh) over (order by d) as run")
    return runs.groupBy("run").agg(F.expr("min(d) as start"), F.expr("date_add(max(d), 31) as end")).drop("run")


def top_concentration(df: DataFrame, keys: Sequence[str], k: int = 8) -> DataFrame:
    """The k largest groups (null keys are a group) with their share of all rows."""
    counts = df.groupBy(*keys).agg(F.expr("count(1) as n"))
    total = counts.agg(F.expr("sum(n) as t"))
    return (
        counts.withColumn("_t", total.scalar())
        .selectExpr(*keys, "n", f"{m.count_ratio('n', '_t', 6)} as share")
        .orderBy(F.col("n").desc(), *[F.col(c).asc_nulls_first() for c in keys])
        .limit(k)
    )


def top_rated(providers: DataFrame, volume: str, rate: str, key: str, min_volume: int, k: int = 50) -> DataFrame:
    """The k highest rates among rows with enough volume."""
    return providers.where(F.col(volume) >= min_volume).orderBy(
        F.col(rate).desc_nulls_last(), F.col(volume).desc(), key
    ).limit(k)


def nlargest(df: DataFrame, column: str, k: int, key: str) -> DataFrame:
    return df.orderBy(F.col(column).desc_nulls_last(), key).limit(k)


def lookup_claim(claims: DataFrame, identifier: str, minted: str | None = None) -> DataFrame:
    """One claim by its natural id, else by its numeric surrogate.

    Where natural ids are minted from the surrogate as ``minted`` and its zero-padded digits, the surrogate is known from the id: the
    equality on it goes through the aggregation to the scans, which skip all row groups without it.
    """
    number = identifier if identifier.isdigit() else "null"
    if minted is not None:
        digits = identifier.removeprefix(minted) if identifier.startswith(minted) else identifier
        claims = claims.where(f"claim_sk = {int(digits)}" if digits.isdigit() and len(digits) < 19 else "false")
    return (
        claims.where(f"clm_id = {literal(identifier)} or claim_sk = cast({number} as bigint)")
        .withColumn("_prio", F.expr(f"if(clm_id = {literal(identifier)}, 0, 1)"))
        .orderBy("_prio", "claim_sk")
        .limit(1)
        .drop("_prio")
    )


DISPLAY_COLUMNS = ("sim_facility_ccn", "sim_facility_name", "sim_facility_state", "sim_facility_type")


def claim_record(row: DataFrame, display: Sequence[str] = DISPLAY_COLUMNS) -> DataFrame:
    """(claim, facility_display) as JSON text, display-only columns kept apart."""
    shown = [c for c in row.columns if c in display]
    rest = [c for c in row.columns if c not in display]
    opts = {"ignoreNullFields": "false"}
    facility = F.to_json(F.struct(*shown), opts) if shown else F.lit("{}")
    return row.select(F.to_json(F.struct(*rest), opts).alias("claim"), facility.alias("facility_display"))


def risk_band(score: str) -> str:
    """SQL text of the band a probability falls in."""
    whens = " ".join(f"when {score} < {edge}D then '{name}'" for edge, name in RISK_BANDS if edge is not None)
    return f"case when {score} is null then null {whens} else '{RISK_BANDS[-1][1]}' end"


# Risk facts in reporting order and the value that raises risk.
RISK_FACTS = (
    ("sim_auth_missing", True),
    ("sim_auth_obtained_late", True),
    ("sim_eligibility_failed", True),
    ("sim_documentation_complete", False),
    ("sim_coder_query_outstanding", True),
    ("sim_coding_specificity_deficit", True),
    ("sim_duplicate_submission_flag", True),
    ("sim_late_filing_flag", True),
)


def reason_codes(df: DataFrame, limit: int = 3, out: str = "reasons") -> DataFrame:
    """The first ``limit`` risk-raising facts present on a row, as an array of (code, feature, action)."""
    items = [
        f"if({c} is not null and {'' if risky else 'not '}{c}, struct({literal(REASON_CODES[c][0])} as code, "
        f"{literal(c)} as feature, {literal(REASON_CODES[c][1])} as action), null)"
        for c, risky in RISK_FACTS
        if c in df.columns
    ]
    return df.withColumn(out, F.expr(f"slice(array_compact(array({', '.join(items)})), 1, {limit})"))


def reason_frequency(df: DataFrame, key: str, reasons: str = "reasons", max_rank: int = 3, k: int = 12) -> DataFrame:
    """Distinct rows per reason code among the first ``max_rank`` reasons, the k most frequent."""
    rows = df.select(key, F.posexplode(reasons).alias("_r", "_x")).where(F.col("_r") < max_rank)
    return (
        rows.selectExpr(key, "_x.code as code")
        .distinct()
        .groupBy("code")
        .agg(F.expr("count(1) as claims"))
        .orderBy(F.col("claims").desc(), "code")
        .limit(k)
    )


def imputation_report(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Supplied and imputed feature counts and the names of the imputed ones, per row."""
    unknown = sorted(set(df.columns) - set(features) - {"request_id"})
    if unknown:
        raise ValueError(f"not declared features: {unknown}")
    present = [f for f in features if f in df.columns]
    absent = [f for f in features if f not in df.columns]
    items = [f"if({c} is null, '{c}', null)" for c in present] + [f"'{c}'" for c in absent]
    names = f"array_sort(array_compact(array({', '.join(items)})))"
    return df.selectExpr("*", f"{names} as imputed_features").selectExpr(
        "*", f"{len(features)} - size(imputed_features) as supplied_count", "size(imputed_features) as imputed_count"
    )


def two_measure_long(df: DataFrame, key: str, measures: Sequence[str]) -> DataFrame:
    """Long form of measures for a chart: (key, measure, amount)."""
    return df.unpivot([key], list(measures), "measure", "amount")


def auth_status_sql() -> str:
    """SQL text of the four-way authorization status, in priority order."""
    return (
        "case when not sim_auth_required then 'not_required' when sim_auth_missing then 'required_missing' "
        "when sim_auth_obtained_late then 'obtained_late' else 'obtained_ontime' end"
    )


def json_metric(df: DataFrame, column: str, path: str, out: str) -> DataFrame:
    """One number out of a JSON text column."""
    return df.withColumn(out, F.expr(f"cast(get_json_object({column}, {literal(path)}) as double)"))


def metrics_json(df: DataFrame, columns: Mapping[str, str], out: str = "sim_metrics_json") -> DataFrame:
    """Pack named expressions into one JSON text column."""
    body = ", ".join(f"'{k}', {v}" for k, v in columns.items())
    return df.withColumn(out, F.expr(f"to_json(named_struct({body}))"))
