"""Staging, contracts, star schema, integrity and serving queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import carc_labels
from ..functions.inline import values_frame
from ..operators import checks, contracts, crosswalk, serving, splits, star
from ..operators import relational as rel
from ..session import pin
from ..sources.delimited import reject_report
from . import views
from .roles import appeals, claims, payer_dim, service_line_ranges, table

LINE_CONTRACT = contracts.Contract(
    "lineitem",
    required=("l_orderkey", "l_linenumber", "l_shipdate"),
    unique_key=("l_orderkey", "l_linenumber"),
    date_order=(("o_orderdate", "l_shipdate"),),
    non_negative=("l_extendedprice",),
)
CUSTOMER_CONTRACT = contracts.Contract(
    "customer", required=("c_custkey", "c_acctbal"), unique_key=("c_custkey",), non_negative=("c_acctbal",)
)


def _lines_with_orders(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").selectExpr("o_orderkey as l_orderkey", "o_orderdate")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice").join(
        orders, "l_orderkey", "left"
    )


def contracts_quarantine(spark: SparkSession, d: str) -> DataFrame:
    lines, customers = table(spark, d, "lineitem").count(), table(spark, d, "customer").count()
    return contracts.quarantine(_lines_with_orders(spark, d), LINE_CONTRACT, lines).unionByName(
        contracts.quarantine(table(spark, d, "customer"), CUSTOMER_CONTRACT, customers)
    )


def contract_report(spark: SparkSession, d: str) -> DataFrame:
    lines, customers = table(spark, d, "lineitem").count(), table(spark, d, "customer").count()
    return contracts.contract_report(_lines_with_orders(spark, d), LINE_CONTRACT, lines).unionByName(
        contracts.contract_report(table(spark, d, "customer"), CUSTOMER_CONTRACT, customers)
    )


def fk_violations(spark: SparkSession, d: str) -> DataFrame:
    t = {n: table(spark, d, n) for n in ("orders", "customer", "lineitem", "supplier", "part", "nation", "region", "labels", "documents")}
    pairs = [
        ("orders->customer", "orders", "o_custkey", "customer", "c_custkey"),
        ("lineitem->orders", "lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("lineitem->supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
        ("lineitem->part", "lineitem", "l_partkey", "part", "p_partkey"),
        ("customer->nation", "customer", "c_nationkey", "nation", "n_nationkey"),
        ("supplier->nation", "supplier", "s_nationkey", "nation", "n_nationkey"),
        ("nation->region", "nation", "n_regionkey", "region", "r_regionkey"),
        ("labels->documents", "labels", "doc_id", "documents", "doc_id"),
        ("orders->lineitem (coverage)", "orders", "o_orderkey", "lineitem", "l_orderkey"),
    ]
    return checks.foreign_key_violations([checks.ForeignKey(n, t[c], ck, t[p], pk) for n, c, ck, p, pk in pairs])


def typed_stage_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Events as a text file would hold them, parsed back by column-name rules."""
    text = table(spark, d, "events").selectExpr(
        "date_format(ts, 'dd-MMM-yyyy') as EVENT_DT",
        "cast(ts as string) as LOAD_DT",
        "cast(value as string) as VALUE_AMT",
        "get_json_object(props, '$.k') as PROPS_CNT",
        "props as RAW_QTY",
        "event_type as TYPE_CD",
    )
    return reject_report(text)


def null_profile(spark: SparkSession, d: str) -> DataFrame:
    return checks.null_profile(claims(spark, d).select(*_PROFILED))


_PROFILED = (
    "claim_sk", "sim_adjudication_date", "sim_payment_date", "sim_denial_review_date", "sim_denial_category",
    "sim_appeal_levels", "sim_days_to_payment",
)


def manifest_drift(spark: SparkSession, d: str) -> DataFrame:
    """Profile of late claims against the profile of all claims."""
    rows = claims(spark, d).select(*_PROFILED, "sim_submission_date")
    recent = splits.two_folds(rows, "sim_submission_date")[1].drop("sim_submission_date", "claim_sk")
    return checks.profile_drift(checks.null_profile(recent), checks.null_profile(rows.drop("sim_submission_date")))


def calendar_dim(spark: SparkSession, d: str) -> DataFrame:
    return star.calendar_dim(
        [(table(spark, d, "orders"), ["o_orderdate"]), (table(spark, d, "lineitem"), ["l_shipdate"])]
    )


def surrogate_dim(spark: SparkSession, d: str) -> DataFrame:
    return star.surrogate_dim(table(spark, d, "part"), "p_name", "part_name_key", ["p_brand"], ["p_partkey"])


def header_fact(spark: SparkSession, d: str) -> DataFrame:
    customers = star.surrogate_dim(table(spark, d, "customer"), "c_name", "bene_key")
    headers = (
        table(spark, d, "orders")
        .join(table(spark, d, "customer").selectExpr("c_custkey as o_custkey", "c_name"), "o_custkey", "left")
        .selectExpr("o_orderkey", "c_name", "o_orderdate", "o_totalprice")
    )
    return star.header_fact(
        headers, [(customers, "c_name", "bene_key")], [("o_orderdate", "from_date_key")], ["o_totalprice"]
    ).select("o_orderkey", "bene_key", "from_date_key", "o_totalprice")


def slot_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """Lines laid out as 25 (code, flag) slots per order, turned back into rows; a 26th line and on keep their rows.

    The lines of an order are numbered first, so repeated line numbers lose nothing.
    """
    lines = table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "lpad(cast(l_partkey as string), 8, '0') as code", "l_returnflag as flag",
        "cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_returnflag) as int) as slot",
    )
    slots = [
        f"max(case when slot = {i} then {c} end) as {c.upper()}{i}" for c in ("code", "flag") for i in range(1, 26)
    ]
    lines = pin(lines)  # numbered once, read twice
    wide = lines.where("slot <= 25").groupBy("l_orderkey").agg(*[F.expr(s) for s in slots])
    rows = star.diagnosis_fact(wide, "l_orderkey", "CODE", "FLAG", 25)
    over = lines.where("slot > 25").selectExpr("l_orderkey", "slot as dgns_seq", "code as icd_dgns_cd", "flag as poa_ind_sw")
    return rows.unionByName(over)


def bag_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two builds of the lines' (supplier, flag, status): the line's own status against that of its order."""
    li = table(spark, d, "lineitem")
    orders = table(spark, d, "orders").selectExpr("o_orderkey as l_orderkey", "o_orderstatus as l_linestatus")
    columns = ["l_suppkey", "l_returnflag", "l_linestatus"]
    return rel.bag_difference(li.select(*columns), li.drop("l_linestatus").join(orders, "l_orderkey", "left").select(*columns))


def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return checks.table_fingerprint(table(spark, d, "lineitem"))


def keys_agree(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").selectExpr("l_orderkey as k").distinct()
    return checks.keys_agree(table(spark, d, "orders").selectExpr("o_orderkey as k"), lines, "k")


def dup_surplus(spark: SparkSession, d: str) -> DataFrame:
    return checks.duplicate_surplus(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def code_coverage(spark: SparkSession, d: str) -> DataFrame:
    codes = table(spark, d, "part").selectExpr("p_partkey as code")
    return rel.code_coverage(table(spark, d, "lineitem").selectExpr("l_partkey as code"), codes, "code")


def enrich_dimension(spark: SparkSession, d: str) -> DataFrame:
    dim = table(spark, d, "supplier").selectExpr("s_suppkey", "s_nationkey as code", "'SOURCE' as provenance")
    ref = table(spark, d, "nation").selectExpr("n_nationkey as code", "n_name")
    return rel.enrich_dimension(dim, ref, "code", "state_name", "n_name", "REFERENCE")


def hash_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers assigned a customer account of their nation and kind, falling back twice."""
    suppliers = table(spark, d, "supplier").selectExpr(
        "s_suppkey", "s_nationkey as state", "if(s_acctbal < 5000, 'MACHINERY', 'NONE') as kind"
    )
    pool = table(spark, d, "customer").selectExpr(
        "c_custkey", "c_nationkey as state", "c_mktsegment as kind"
    )
    return crosswalk.stratified_assignment(
        suppliers, pool, "s_suppkey", "c_custkey",
        [("state+kind", ["state", "kind"]), ("state", ["state"]), ("nationwide", [])],
    )


def modal_segment(spark: SparkSession, d: str) -> DataFrame:
    return rel.modal_value(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", "modal_segment")


def enriched_base(spark: SparkSession, d: str) -> DataFrame:
    """The star join: headers, dimensions (calendar twice), outcome, display codes, appeal bridge."""
    c = claims(spark, d, payer=True)
    parts = table(spark, d, "part")
    outcome = c.select(
        "claim_sk", "sim_payer_id", "sim_submission_date", "sim_payment_date", "sim_allowed_amount", "sim_paid_amount",
        "sim_denial_flag", "sim_late_filing_flag", "sim_eligibility_failed", "sim_duplicate_submission_flag",
        "provider_key", "part_key", "service_date",
    )
    lines = rel.range_bucket(
        parts.selectExpr("p_partkey as part_key", "p_size", "p_type as prncpal_dgns_cd", "p_brand as admtg_dgns_cd"),
        "p_size", service_line_ranges(spark), "lo", "hi", "service_line", "sim_service_line_id",
    )
    fact = outcome.join(lines, "part_key").selectExpr(
        "claim_sk", "provider_key", "part_key as drg_key", "prncpal_dgns_cd", "admtg_dgns_cd",
        "cast(date_format(sim_submission_date, 'yyyyMMdd') as int) as admission_date_key",
        "cast(date_format(service_date, 'yyyyMMdd') as int) as discharge_date_key",
        "sim_payer_id", "sim_service_line_id", "sim_submission_date", "sim_payment_date", "sim_allowed_amount",
        "sim_paid_amount", "sim_denial_flag", "sim_late_filing_flag", "sim_eligibility_failed",
        "sim_duplicate_submission_flag",
    )
    adjudication_columns = [
        "sim_payer_id", "sim_service_line_id", "sim_submission_date", "sim_payment_date", "sim_allowed_amount",
        "sim_paid_amount", "sim_denial_flag", "sim_late_filing_flag", "sim_eligibility_failed", "sim_duplicate_submission_flag",
    ]
    codes = values_frame(
        spark, [("ECONOMY", "economy goods"), ("Brand#2", "second brand"), ("Brand#17", "brand seventeen")],
        "code string, long_desc string",
    )
    tables = {
        "claims": fact.drop(*adjudication_columns),
        "providers": table(spark, d, "supplier").selectExpr("s_suppkey as provider_key", "s_name as prvdr_num"),
        "drgs": parts.selectExpr("p_partkey as drg_key", "lpad(cast(p_size as string), 3, '0') as drg_cd"),
        "calendar": star.calendar_dim(
            [(table(spark, d, "orders"), ["o_orderdate"]), (table(spark, d, "lineitem"), ["l_shipdate"])]
        ),
        "adjudication": fact.select("claim_sk", *adjudication_columns),
        "payers": payer_dim(spark).select("sim_payer_id", "sim_payer_name"),
        "service_lines": values_frame(
            spark, [(n, n.title()) for n in ("CARDIAC", "ORTHO", "RESPIRATORY", "NEURO", "UNKNOWN")],
            "sim_service_line_id string, sim_service_line_name string",
        ),
        "codes": codes,
        "appeals": appeals(spark, d),
    }
    return views.enriched_claims(tables).select(
        "claim_sk", "prvdr_num", "drg_cd", "admission_date", "discharge_date", "sim_payer_name", "sim_service_line_name",
        "prncpal_dgns_desc", "admtg_dgns_desc", "sim_appeal_levels", "any_overturned", "recovered_amt",
        "sim_clean_claim_flag", "sim_first_pass_paid_flag", "sim_ar_open_flag", "sim_ar_balance_amt",
        "sim_submission_year_month",
    )


def appeal_bridge(spark: SparkSession, d: str) -> DataFrame:
    base = claims(spark, d).where("sim_denial_flag").select("claim_sk", "sim_denial_type")
    return rel.aggregate_then_join(base, appeals(spark, d), "claim_sk", views.APPEAL_TOTALS)


def range_bucket(spark: SparkSession, d: str) -> DataFrame:
    rows = rel.range_bucket(
        table(spark, d, "part"), "p_size", service_line_ranges(spark), "lo", "hi", "service_line", "service_line_id"
    )
    return rows.groupBy("service_line_id").agg(
        F.expr("count(1) as parts"), F.expr("min(p_size) as lo"), F.expr("max(p_size) as hi")
    )


def outcome_checks(spark: SparkSession, d: str) -> DataFrame:
    """Row rules of the outcome layer, one scan of the claims."""
    return checks.violation_counts(claims(spark, d), OUTCOME_RULES)


OUTCOME_RULES = {
    "paid<=allowed": "sim_paid_amount > sim_allowed_amount",
    "allowed<=billed": "sim_allowed_amount > billed_charge_amt",
    "paid+denied<=allowed": "sim_paid_amount + sim_denied_amount > sim_allowed_amount",
    "denied has category": "sim_denial_flag and sim_denial_category is null",
    "category iff denied": "not sim_denial_flag and sim_denial_category is not null",
    "denied has amount": "sim_denial_flag and sim_denied_amount <= 0",
    "full denial unpaid": "sim_denial_type = 'FULL' and sim_paid_amount <> 0",
    "payment after submission": "sim_payment_date < sim_submission_date",
    "adjudication after submission": "sim_adjudication_date < sim_submission_date",
    "cost is sum of parts": "sim_total_cost_to_collect <> line_count * 6 + sim_denial_rework_cost + sim_appeal_cost",
    "appeal only when denied": "sim_appeal_levels is not null and not sim_denial_flag",
}


def dq_scorecard(spark: SparkSession, d: str) -> DataFrame:
    """Named checks: one aggregate per source table, then one derived metric and verdict."""
    c = claims(spark, d, payer=True)
    base = c.agg(
        F.expr("count(1) as n"),
        F.expr("count_if(sim_denial_flag and sim_denial_category is null) as no_category"),
        F.expr("count_if(sim_allowed_amount < 0 or sim_paid_amount < 0 or sim_denied_amount < 0) as negative"),
        F.expr("count_if(sim_paid_amount > sim_allowed_amount) as overpaid"),
        F.expr("count(billed_charge_amt) as billed"),
        F.expr("count_if(sim_payer_id is null) as no_payer"),
        F.expr("count(sim_payment_date) as with_payment"),
    )
    orders = table(spark, d, "orders")
    lines = table(spark, d, "lineitem")
    without_lines = rel.orphans(orders, lines, "o_orderkey", "l_orderkey").agg(F.expr("count(1) as v"))
    line_orphans = rel.orphans(lines, orders, "l_orderkey", "o_orderkey").agg(F.expr("count(1) as v"))
    quarantined = contracts.quarantine(table(spark, d, "customer"), CUSTOMER_CONTRACT).agg(F.expr("count(1) as v"))
    coverage = code_coverage(spark, d)
    facts = (
        base.withColumn("orders_n", orders.agg(F.count(F.lit(1))).scalar())
        .withColumn("uncovered", without_lines.scalar())
        .withColumn("orphans", line_orphans.scalar())
        .withColumn("quarantined", quarantined.scalar())
        .withColumn("coded", coverage.select("matched").scalar())
        .withColumn("codes", coverage.select("total").scalar())
    )
    rows = ", ".join(
        f"struct('{i}' as check_id, '{dim}' as dimension, cast({num} as bigint) as numerator, cast({den} as bigint) as denominator, "
        f"cast({thr} as double) as threshold_min, '{sev}' as severity)"
        for i, dim, num, den, thr, sev in SCORECARD_ROWS
    )
    return checks.scorecard(facts.selectExpr(f"inline(array({rows}))"))


# check, dimension, numerator, denominator (0 = absolute count), threshold, severity
SCORECARD_ROWS = [
    ("adjudication_coverage", "completeness", "n", "orders_n", "1.0", "critical"),
    ("line_orphans", "referential_integrity", "orphans", "0", "0", "critical"),
    ("orders_without_lines", "referential_integrity", "uncovered", "0", "0", "warning"),
    ("denial_category_consistency", "validity", "no_category", "0", "0", "critical"),
    ("money_nonnegative", "validity", "negative", "0", "0", "critical"),
    ("paid_le_allowed", "validity", "overpaid", "0", "0", "critical"),
    ("billed_present", "completeness", "billed", "n", "1.0", "warning"),
    ("quarantine_rows", "validity", "quarantined", "0", "0", "warning"),
    ("unknown_payer_routed", "completeness_info", "no_payer", "n", "null", "info"),
    ("payment_present", "completeness_info", "with_payment", "n", "null", "info"),
    ("code_description_coverage", "reference_enrichment", "coded", "codes", "null", "info"),
]


def view_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Each view against its base: (check_name, violations, passed)."""
    e = claims(spark, d, payer=True, provider=True)
    base = e.agg(
        F.expr("count(1) as n"),
        F.expr("count_if(sim_denial_flag) as denied"),
        F.expr("count_if(sim_ar_open_flag) as opened"),
        F.expr("count_if(sim_denial_flag or sim_ar_open_flag) as actionable"),
        F.expr("round(sum(billed_charge_amt)) as billed"),
        F.expr("count(distinct claim_sk) as different"),
    )
    monthly = views.executive_monthly(e).agg(
        F.expr("sum(sim_claims_submitted) as m_n"), F.expr("sum(sim_denied_claims) as m_denied"),
        F.expr("round(sum(billed_charge_amt)) as m_billed"),
    )
    root = views.denial_root_cause(e).agg(
        F.expr("sum(sim_denial_count) as r_n"), F.expr("sum(sim_full_denials + sim_partial_denials) as r_types")
    )
    aging = views.ar_aging(e).agg(
        F.expr("sum(sim_open_claims) as a_n"), F.expr("count(1) as a_rows"),
        F.expr("count_if(sim_open_claims <> sim_denied_open_claims + sim_nondenied_open_claims) as a_bad"),
    )
    payer = views.payer_performance(e).agg(F.expr("sum(sim_claims) as p_n"), F.expr("count(1) as p_rows"))
    provider = views.provider_quality(e).agg(
        F.expr("sum(sim_provider_claims) as q_n"), F.expr("count(1) - count(distinct prvdr_num) as q_bad")
    )
    drift = views.drift_monthly(e).agg(
        F.expr("sum(if(feature_name = 'denial_rate', sim_n_claims, 0)) as d_n"),
        F.expr("count_if(is_drift_scaffold is not true) as d_unlabelled"),
        F.expr("count_if(metric_kind = 'outcome_rate' and feature_name <> 'denial_rate') as d_kind"),
    )
    row = base
    for side in (monthly, root, aging, payer, provider, drift):
        row = rel.attach_scalars(row, side)
    items = ", ".join(f"struct('{n}' as check_name, cast({sql} as bigint) as violations)" for n, sql in VIEW_CHECKS.items())
    return row.selectExpr(f"inline(array({items}))").selectExpr("*", "violations = 0 as passed")


VIEW_CHECKS = {
    "enriched:distinct_claim_sk==rowcount": "if(different = n, 0, 1)",
    "executive:sum_claims==fact": "if(m_n = n, 0, 1)",
    "executive:sum_denied==denied": "if(m_denied = denied, 0, 1)",
    "executive:sum_billed==fact_billed": "if(m_billed = billed, 0, 1)",
    "denial_root_cause:sum_denials==denied": "if(r_n = denied, 0, 1)",
    "denial_root_cause:full+partial==denials": "if(r_types = r_n, 0, 1)",
    "ar_aging:sum_open==unpaid": "if(a_n = opened, 0, 1)",
    "ar_aging:five_buckets": "if(a_rows = 5, 0, 1)",
    "ar_aging:denied+nondenied==open": "a_bad",
    "payer:sum_claims==fact": "if(p_n = n, 0, 1)",
    "payer:rowcount==distinct_payers": "if(p_rows = 5, 0, 1)",
    "provider:sum_claims==fact": "if(q_n = n, 0, 1)",
    "provider:one_row_per_provider": "q_bad",
    "monitoring:denial_rate_n==fact": "if(d_n = n, 0, 1)",
    "monitoring:all_labelled": "d_unlabelled",
    "monitoring:outcome_kind_is_only_denial_rate": "d_kind",
}


# ---------------------------------------------------------------- serving


def exec_rollup(spark: SparkSession, d: str) -> DataFrame:
    return serving.executive_rollup(views.executive_monthly(claims(spark, d, payer=True)))


def control_totals(spark: SparkSession, d: str) -> DataFrame:
    return serving.control_totals(views.executive_monthly(claims(spark, d, payer=True)))


def category_rollup(spark: SparkSession, d: str) -> DataFrame:
    return serving.category_rollup(views.denial_root_cause(claims(spark, d), carc_labels(spark)))


def overturn_rates(spark: SparkSession, d: str) -> DataFrame:
    rates = serving.book_overturn_rates(serving.category_overturn_rates(views.denial_root_cause(claims(spark, d))))
    return rates.selectExpr(*[f"round({c}, 9) as {c}" for c in rates.columns])


def appeal_selection(spark: SparkSession, d: str) -> DataFrame:
    return serving.appeal_selection(
        claims(spark, d).where("sim_denial_flag"), "sim_denial_category", "sim_denied_amount",
        "(sim_appeal_levels is not null)", "any_overturned",
    )


def thin_months(spark: SparkSession, d: str) -> DataFrame:
    monthly = claims(spark, d).groupBy(F.expr("trunc(sim_submission_date, 'month') as month_start")).agg(
        F.expr("count(1) as n")
    )
    return serving.thin_months(monthly, "month_start", "n", 0.95)


def monitored_series(spark: SparkSession, d: str) -> DataFrame:
    return serving.monitored_series(views.drift_monthly(claims(spark, d, payer=True)), "auth_missing_rate")


def top_codes(spark: SparkSession, d: str) -> DataFrame:
    rows = claims(spark, d, drg=True)
    return serving.top_concentration(rows, ["drg_cd", "sim_denial_category"], 8)


def top_providers(spark: SparkSession, d: str) -> DataFrame:
    q = views.provider_quality(claims(spark, d, payer=True, provider=True))
    return serving.top_rated(q, "sim_provider_claims", "sim_denial_rate", "prvdr_num", 10, 50).select(
        "prvdr_num", "sim_provider_claims", "sim_denial_rate"
    )


def reasons_top(spark: SparkSession, d: str) -> DataFrame:
    rows = serving.reason_codes(claims(spark, d, payer=True))
    return serving.reason_frequency(rows, "claim_sk")


def claim_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One claim record as served: the claim and its display block as JSON text."""
    rows = claims(spark, d, payer=True, provider=True).select(
        "claim_sk", "clm_id", "sim_payer_id", "sim_denial_type", "line_count", "sim_facility_name"
    )
    return serving.claim_record(serving.lookup_claim(rows, "CLM0000000042", minted="CLM"))


def auth_status(spark: SparkSession, d: str) -> DataFrame:
    rows = claims(spark, d).selectExpr("sim_denial_flag", f"{serving.auth_status_sql()} as auth_status")
    return rows.groupBy("auth_status").agg(
        F.expr("count(1) as claims"), F.expr("count_if(sim_denial_flag) as denied"),
        F.expr("round(cast(count_if(sim_denial_flag) as decimal(20,0)) / cast(count(1) as decimal(20,0)), 4) as rate"),
    )


def direction_checks(spark: SparkSession, d: str) -> DataFrame:
    return checks.directional_checks(
        claims(spark, d, payer=True),
        "cast(sim_denial_flag as int)",
        {
            "auth_missing raises": ("sim_auth_missing", "not sim_auth_required", 0.0),
            "documentation lowers": ("not sim_documentation_complete", "sim_documentation_complete", 0.0),
            "small claims are denied more": ("line_count <= 2", "line_count > 5", 0.05),
        },
    )


def band_checks(spark: SparkSession, d: str) -> DataFrame:
    return checks.band_checks(
        claims(spark, d),
        {
            "denial_rate": ("count_if(sim_denial_flag) / count(1)", 0.1, 0.3),
            "open_rate": ("count_if(sim_ar_open_flag) / count(1)", 0.05, 0.2),
            "appeal_rate_of_denied": ("count(sim_appeal_levels) / count_if(sim_denial_flag)", 0.3, 0.6),
            "overturn_rate": ("count_if(any_overturned) / count(any_overturned)", 0.9, 1.0),
        },
    )


def run_report(spark: SparkSession, d: str) -> DataFrame:
    return checks.run_report(
        claims(spark, d),
        {
            "claims": "count(1)", "lines": "sum(line_count)", "denied": "count_if(sim_denial_flag)",
            "providers": "count(distinct prvdr_num)", "first_submission": "min(sim_submission_date)",
            "last_submission": "max(sim_submission_date)", "billed": "sum(billed_charge_amt)",
        },
    )


def figure_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Served figures against control totals computed from the claims themselves."""
    c = claims(spark, d, payer=True)
    roll = exec_rollup(spark, d)
    root = views.denial_root_cause(c)
    one = lambda df, sql: df.agg(F.expr(f"{sql} as v"))
    return checks.reconcile(
        [
            ("rollup claims", roll.select("sim_claims_submitted"), one(c, "count(1)"), 0.0),
            ("rollup denied", roll.select("sim_denied_claims"), one(c, "count_if(sim_denial_flag)"), 0.0),
            ("rollup billed", roll.select("source_billed_charge_amt"), one(c, "sum(billed_charge_amt)"), 1.0),
            ("root cause denied amount", one(root, "sum(sim_denied_amt)"), one(c.where("sim_denial_flag"), "sum(sim_denied_amount)"), 1.0),
            ("root cause shares", one(root, "sum(sim_share_of_denials)"), one(c, "1"), 0.01),
            ("model metrics", None, one(c, "count(1)"), 0.0),
        ],
        spark,
    )


def measures_long(spark: SparkSession, d: str) -> DataFrame:
    root = serving.category_rollup(views.denial_root_cause(claims(spark, d)))
    return serving.two_measure_long(root, "sim_denial_category", ["denied_amt", "recovered_amt"])


QUERIES = {
    f.__name__: f
    for f in (
        contracts_quarantine, contract_report, fk_violations, typed_stage_rejects, null_profile, manifest_drift,
        calendar_dim, surrogate_dim, header_fact, slot_unpivot, bag_diff, fingerprint, keys_agree, dup_surplus,
        code_coverage, enrich_dimension, hash_crosswalk, modal_segment, enriched_base, appeal_bridge, range_bucket,
        outcome_checks, dq_scorecard, view_reconcile, exec_rollup, control_totals, category_rollup, overturn_rates,
        appeal_selection, thin_months, monitored_series, top_codes, top_providers, reasons_top, claim_lookup,
        auth_status, direction_checks, band_checks, run_report, figure_reconcile, measures_long,
    )
}
