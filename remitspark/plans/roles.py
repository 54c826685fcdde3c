"""Claim roles derived from order, line, customer, supplier and part tables.

One pass over the line table builds everything that is one row per claim: billed and allowed
amounts, denial, payment, appeal, authorization, documentation and cost columns. Money is summed
in integer units of 0.0001 so results are exact; it becomes a decimal at claim grain. Dimension
joins are added only when asked for, so a view pays for the joins it uses.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.inline import values_frame
from ..functions.measures import grouped
from ..operators.events import strongest_contributor
from ..operators.relational import range_bucket

MONEY = "decimal(18,4)"

# Fixed role values: payer name, share of the book by design, filing window in days.
PAYERS = [
    ("AUTOMOBILE", "Payer Automobile", 0.20, 365),
    ("BUILDING", "Payer Building", 0.20, 180),
    ("FURNITURE", "Payer Furniture", 0.20, 120),
    ("HOUSEHOLD", "Payer Household", 0.20, 365),
    ("MACHINERY", "Payer Machinery", 0.20, 180),
]
# Fixed role values: service line, lowest and highest DRG number; the rest is UNKNOWN.
SERVICE_LINES = [("CARDIAC", 1, 12), ("ORTHO", 13, 24), ("RESPIRATORY", 25, 35), ("NEURO", 36, 44)]
# Fixed role values: minutes and dollars of the cost columns.
REWORK_COST_PER_LINE = 25
APPEAL_COST_PER_LINE = 118
BASE_COST_PER_LINE = 6
DEFAULT_FILING_DAYS = 180


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def payer_dim(spark: SparkSession) -> DataFrame:
    return values_frame(
        spark,
        PAYERS,
        "sim_payer_id string, sim_payer_name string, sim_payer_mix_share double, sim_timely_filing_days int",
    )


def service_line_ranges(spark: SparkSession) -> DataFrame:
    return values_frame(spark, SERVICE_LINES, "service_line string, lo int, hi int")


def money(units: str) -> str:
    """Integer units of 0.0001 to an exact decimal (SQL text)."""
    return f"cast(cast({units} as decimal(18,0)) * cast(0.0001 as decimal(5,4)) as {MONEY})"


def padded(prefix: str, number: str, width: int) -> str:
    """SQL text of a zero-padded identifier; longer numbers stay whole."""
    text = f"cast({number} as string)"
    return f"concat('{prefix}', lpad({text}, greatest({width}, length({text})), '0'))"


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in whole numbers, without what :func:`line_roles` derives from them."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as claim_sk",
        "l_linenumber as line_num",
        "l_partkey as part_key",
        "l_suppkey as provider_key",
        "cast(l_quantity as bigint) as quantity",
        "cast(round(l_extendedprice * 100) as bigint) as cents",
        "cast(round(l_discount * 100) as bigint) as discount_pct",
        "cast(round(l_tax * 100) as bigint) as tax_pct",
        "cast(l_shipdate as date) as ship_date",
        "l_returnflag = 'R' as is_denied",
        "l_returnflag = 'A' as is_appeal",
        "l_linestatus = 'F' as is_final",
    )


def line_roles(lines: DataFrame) -> DataFrame:
    """Billed and allowed amounts of ``line_facts`` as integer units."""
    return lines.withColumns(
        {"billed_u": F.expr("cents * 100"), "allowed_u": F.expr("cents * (100 - discount_pct)")}
    ).drop("cents")


def claim_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line grain with integer money and the flags the claim roles need."""
    return line_roles(line_facts(spark, sf_dir))


# Claim grain: every line measure, in one aggregation.
LINE_MEASURES = {
    "line_count": "count(1)",
    "denied_lines": "count_if(is_denied)",
    "appeal_lines": "count_if(is_appeal)",
    "overturned_lines": "count_if(is_appeal and is_final)",
    "provider_key": "min(provider_key)",
    "part_key": "min(part_key)",
    "billed_u": "sum(billed_u)",
    "allowed_u": "sum(allowed_u)",
    "denied_u": "coalesce(sum(case when is_denied then allowed_u end), 0)",
    "paid_u": "coalesce(sum(case when not is_denied and is_final then allowed_u end), 0)",
    "recovered_u": "coalesce(sum(case when is_appeal and is_final then allowed_u end), 0)",
    "first_ship": "min(ship_date)",
    "last_ship": "max(ship_date)",
    "payment_date": "max(case when is_final then ship_date end)",
    "last_denied_ship": "max(case when is_denied then ship_date end)",
    "distinct_lines": "cast(size(collect_set(line_num)) as bigint)",
    "max_quantity": "max(quantity)",
    "min_quantity": "min(quantity)",
    "sum_quantity": "sum(quantity)",
    "min_tax": "min(tax_pct)",
    "max_tax": "max(tax_pct)",
    "min_discount": "min(discount_pct)",
    "sum_discount": "sum(discount_pct)",
}

# Line numbers that are bits of one long: their distinct count stays a hash aggregate, a set for each claim makes Spark sort.
_BITS = "line_num between 0 and 62"


def claim_measures(lines: DataFrame, more: Mapping[str, str] | None = None, distinct: Mapping[str, str] | None = None) -> DataFrame:
    """``LINE_MEASURES`` by claim; line numbers that are no bits are counted apart, exactly, and added.

    ``more`` adds measures or replaces some; ``distinct`` counts the different line numbers of the lines for which a condition holds.
    """
    distinct = {"distinct_lines": "true", **(distinct or {})}
    bits = {
        n: f"coalesce(cast(bit_count(bit_or(if({_BITS} and {when}, shiftleft(1L, cast(line_num as int)), null))) as bigint), 0L)" for n, when in distinct.items()
    }
    sets = {f"_{n}": f"cast(size(collect_set(if({when}, line_num, null))) as bigint)" for n, when in distinct.items()}
    per_claim = grouped(lines, ["claim_sk"], **{**LINE_MEASURES, **(more or {}), **bits})
    beyond = grouped(lines.where(f"not ({_BITS})"), ["claim_sk"], **sets)
    joined = per_claim.join(beyond, "claim_sk", "left")
    return joined.withColumns({n: F.expr(f"{n} + coalesce(_{n}, 0L)") for n in distinct}).drop(*sets)


_DENIED = "denied_lines * 2 > line_count"
_APPEALED = f"({_DENIED} and appeal_lines > 0)"
_AUTH = "max_quantity >= 40"
_REWORK = f"case when {_DENIED} then denied_lines * {REWORK_COST_PER_LINE} else 0 end"
_APPEAL_COST = f"case when {_APPEALED} then appeal_lines * {APPEAL_COST_PER_LINE} else 0 end"
_DRIVER = strongest_contributor(
    {
        "authorization": f"case when {_AUTH} and min_tax = 0 then 4 when {_AUTH} and max_tax >= 8 then 2 else 0 end",
        "coding": "if(min_quantity <= 5, 2, 0)",
        "documentation": "if(min_discount > 0, 0, 3)",
        "duplicate": "if(distinct_lines < line_count, 3, 0)",
    }
)

CLAIM_COLUMNS = {
    "claim_sk": "claim_sk",
    "clm_id": padded("CLM", "claim_sk", 10),
    "bene_key": "bene_key",
    "provider_key": "provider_key",
    "part_key": "part_key",
    "line_count": "line_count",
    "denied_lines": "denied_lines",
    "prvdr_num": padded("P", "provider_key", 6),
    "sim_submission_date": "submitted",
    "sim_submission_year_month": "date_format(submitted, 'yyyy-MM')",
    "service_date": "last_ship",
    "sim_days_service_to_submission": "if(last_ship <= submitted, datediff(submitted, last_ship), 0)",
    "sim_coded_date": "least(last_ship, submitted)",
    "length_of_stay_days": "datediff(last_ship, first_ship) + 1",
    "sim_adjudication_date": "if(first_ship >= submitted, first_ship, null)",
    "sim_days_to_adjudication": "if(first_ship >= submitted, datediff(first_ship, submitted), null)",
    "sim_payment_date": "payment_date",
    "sim_days_to_payment": "if(payment_date >= submitted, datediff(payment_date, submitted), null)",
    "sim_denial_review_date": f"if({_DENIED}, last_denied_ship, null)",
    "billed_charge_amt": money("billed_u"),
    "sim_allowed_amount": money("allowed_u"),
    "sim_paid_amount": money("paid_u"),
    "medicare_source_paid_amt": money("paid_u"),
    "sim_denied_amount": money("denied_u"),
    "sim_denial_flag": _DENIED,
    "sim_denial_type": f"case when not ({_DENIED}) then 'NONE' when denied_lines = line_count then 'FULL' else 'PARTIAL' end",
    "sim_denial_category": f"if({_DENIED}, priority, null)",
    "sim_denial_carc_group": f"if({_DENIED}, substring(priority, 1, 1), null)",
    "sim_denial_driver_mechanism": f"if({_DENIED}, {_DRIVER}, null)",
    "sim_auth_required": _AUTH,
    "sim_auth_missing": f"{_AUTH} and min_tax = 0",
    "sim_auth_obtained_late": f"{_AUTH} and min_tax <> 0 and max_tax >= 8",
    "sim_auth_obtained": f"{_AUTH} and min_tax <> 0",
    "sim_documentation_complete": "min_discount > 0",
    "sim_documentation_score": "cast(cast(sum_discount as decimal(18,0)) / line_count as decimal(10,4))",
    "sim_coding_complexity_score": "cast(cast(sum_quantity as decimal(18,0)) / line_count as decimal(10,4))",
    "sim_coding_specificity_deficit": "min_quantity <= 5",
    "sim_duplicate_submission_flag": "distinct_lines < line_count",
    "diagnosis_count": "line_count",
    "sim_denial_rework_cost": _REWORK,
    "sim_appeal_cost": _APPEAL_COST,
    "sim_total_cost_to_collect": f"line_count * {BASE_COST_PER_LINE} + {_REWORK} + {_APPEAL_COST}",
    "sim_appeal_levels": f"if({_APPEALED}, appeal_lines, null)",
    "any_overturned": f"if({_APPEALED}, overturned_lines > 0, null)",
    "recovered_amt": f"if({_APPEALED}, {money('recovered_u')}, null)",
}


def claims(
    spark: SparkSession,
    sf_dir: str,
    payer: bool = False,
    provider: bool = False,
    drg: bool = False,
) -> DataFrame:
    """One row per claim with outcome, timeline, money and pre-submission columns.

    ``payer``/``provider``/``drg`` add the joins (and columns) of that dimension.
    """
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as claim_sk",
        "o_custkey as bene_key",
        "cast(o_orderdate as date) as submitted",
        "o_orderpriority as priority",
    )
    df = claim_measures(claim_lines(spark, sf_dir)).join(orders, "claim_sk")
    if payer:
        customers = table(spark, sf_dir, "customer").selectExpr(
            "c_custkey as bene_key",
            "coalesce(c_mktsegment, 'UNKNOWN') as sim_payer_id",
            "c_acctbal < 0 as sim_eligibility_failed",
        )
        df = df.join(customers, "bene_key", "left").join(payer_dim(spark), "sim_payer_id", "left")
    if provider:
        suppliers = table(spark, sf_dir, "supplier").selectExpr(
            "s_suppkey as provider_key", "s_nationkey as _nation", "s_name as sim_facility_name"
        )
        nations = table(spark, sf_dir, "nation").selectExpr("n_nationkey as _nation", "n_name as provider_state_cd")
        df = df.join(suppliers, "provider_key", "left").join(nations, "_nation", "left")
    if drg:
        parts = table(spark, sf_dir, "part").selectExpr(
            "p_partkey as part_key",
            "p_size as drg_num",
            "lpad(cast(p_size as string), 3, '0') as drg_cd",
            "p_type as prncpal_dgns_cd",
            "p_brand as admtg_dgns_cd",
        )
        df = range_bucket(
            df.join(parts, "part_key", "left"),
            "drg_num",
            service_line_ranges(spark),
            "lo",
            "hi",
            "service_line",
            "sim_service_line_id",
        )
    limit = f"coalesce(sim_timely_filing_days, {DEFAULT_FILING_DAYS})" if payer else f"{DEFAULT_FILING_DAYS}"
    extra = [c for c in EXTRA_COLUMNS if c in df.columns]
    if not payer:
        df = df.withColumn("sim_eligibility_failed", F.expr("cast(null as boolean)"))
    return with_claim_flags(
        df.selectExpr(
            *[f"{sql} as {name}" for name, sql in CLAIM_COLUMNS.items()],
            *extra,
            *([] if payer else ["sim_eligibility_failed"]),
            f"{limit} as sim_filing_limit_days",
            f"{CLAIM_COLUMNS['sim_days_service_to_submission']} > {limit} as sim_late_filing_flag",
        )
    )


EXTRA_COLUMNS = (
    "sim_payer_id",
    "sim_payer_name",
    "sim_payer_mix_share",
    "sim_timely_filing_days",
    "sim_eligibility_failed",
    "provider_state_cd",
    "sim_facility_name",
    "drg_num",
    "drg_cd",
    "prncpal_dgns_cd",
    "admtg_dgns_cd",
    "sim_service_line_id",
)


def with_claim_flags(df: DataFrame) -> DataFrame:
    """Clean-claim, first-pass-paid and open-balance columns of the enriched base."""
    return df.selectExpr(
        "*",
        "not sim_denial_flag and not sim_late_filing_flag and not coalesce(sim_eligibility_failed, false) "
        "and not coalesce(sim_duplicate_submission_flag, false) as sim_clean_claim_flag",
        "sim_payment_date is not null and not sim_denial_flag as sim_first_pass_paid_flag",
        "sim_payment_date is null as sim_ar_open_flag",
        f"cast(greatest(sim_allowed_amount - sim_paid_amount, 0) as {MONEY}) as sim_ar_balance_amt",
    )


APPEAL_COLUMNS = {
    "sim_appeal_level": "line_num",
    "sim_appeal_outcome": "if(is_final, 'OVERTURNED', 'UPHELD')",
    "sim_appeal_recovered_amount": f"if(is_final, {money('allowed_u')}, cast(0 as {MONEY}))",
}


def appeals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(claim, level) appeals of denied claims, as their own many-per-claim table."""
    lines = claim_lines(spark, sf_dir)
    denied = grouped(lines, ["claim_sk"], d="count_if(is_denied) * 2 > count(1)").where("d").select("claim_sk")
    return (
        lines.where("is_appeal")
        .join(denied, "claim_sk", "left_semi")
        .selectExpr("claim_sk", *[f"{sql} as {name}" for name, sql in APPEAL_COLUMNS.items()])
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workflow events: one case per user and day."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat(user_id, '-', date_format(ts, 'yyyyMMdd')) as case_id",
        "event_id",
        "ts",
        "event_type",
        "cast(value as decimal(12,2)) as minutes",
    )
