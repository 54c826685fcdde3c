"""Reference SQL of the staging, contract, star, integrity and serving queries."""

from __future__ import annotations

from ..functions.codes import REASON_CODES
from .oracle_base import CUT, dollars4, rate, share_where, with_claims
from .oracle_views import EXEC_BODY, ROOT_BODY
from .roles import SERVICE_LINES

def hash_long(key: str, seed: int = 1337) -> str:
    return f"cast(('0x' || substr(md5('{seed}|' || cast({key} as varchar)), 1, 12)) as bigint)"


_QUARANTINE = """
lo as (select l_orderkey, l_linenumber, l_shipdate, l_extendedprice, o_orderdate from lineitem left join orders on o_orderkey = l_orderkey),
q as (
  select 'lineitem' as table_name, 'date_order' as contract, l_orderkey || '|' || l_linenumber as entity_key,
    'o_orderdate > l_shipdate' as reason from lo where cast(o_orderdate as date) > cast(l_shipdate as date)
  union all
  select 'lineitem', 'non_negative_money', l_orderkey || '|' || l_linenumber, 'l_extendedprice < 0' from lo where l_extendedprice < 0
  union all
  select 'lineitem', 'key_uniqueness', l_orderkey || '|' || l_linenumber, 'duplicate l_orderkey+l_linenumber'
  from (select *, count(*) over (partition by l_orderkey, l_linenumber) as n from lo) where n > 1
  union all
  select 'customer', 'non_negative_money', cast(c_custkey as varchar), 'c_acctbal < 0' from customer where c_acctbal < 0
  union all
  select 'customer', 'key_uniqueness', cast(c_custkey as varchar), 'duplicate c_custkey'
  from (select *, count(*) over (partition by c_custkey) as n from customer) where n > 1)"""

_FKS = [
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

_PROFILE = [
    ("claim_sk", "claim_sk", "bigint"), ("sim_adjudication_date", "adjudicated", "date"),
    ("sim_payment_date", "payment_date", "date"), ("sim_denial_review_date", "review_date", "date"),
    ("sim_denial_category", "category", "string"), ("sim_appeal_levels", "appeal_levels", "bigint"),
    ("sim_days_to_payment", "days_pay", "int"),
]


def _profile(source: str, keep: list) -> str:
    return " union all ".join(
        f"select '{n}' as column_name, '{t}' as data_type, count(*) as row_count, count(*) filter (where {c} is null) as nulls, "
        f"{rate(f'count(*) filter (where {c} is null)', 'count(*)', 6)} as null_rate from {source}"
        for n, c, t in keep
    )


_OUTCOME = {
    "paid<=allowed": "paid_u > allowed_u",
    "allowed<=billed": "allowed_u > billed_u",
    "paid+denied<=allowed": "paid_u + denied_u > allowed_u",
    "denied has category": "denied and category is null",
    "category iff denied": "not denied and category is not null",
    "denied has amount": "denied and denied_u <= 0",
    "full denial unpaid": "denial_type = ''FULL'' and paid_u <> 0",
    "payment after submission": "payment_date < submitted",
    "adjudication after submission": "adjudicated < submitted",
    "cost is sum of parts": "total_cost <> line_count * 6 + rework_cost + appeal_cost",
    "appeal only when denied": "appeal_levels is not null and not denied",
}
_OUTCOME = {k: v.replace("''", "'") for k, v in _OUTCOME.items()}

_ROLL = f"""
select min(sim_submission_year_month) as sim_period_from, max(sim_submission_year_month) as sim_period_to,
  cast(sum(sim_claims_submitted) as bigint) as sim_claims_submitted, cast(sum(sim_denied_claims) as bigint) as sim_denied_claims,
  {rate('sum(sim_denied_claims)', 'sum(sim_claims_submitted)', 6)} as sim_denial_rate,
  {rate('sum(sim_clean_claims)', 'sum(sim_claims_submitted)', 6)} as sim_clean_claim_rate,
  {rate('sum(sim_first_pass_paid_claims)', 'sum(sim_claims_submitted)', 6)} as sim_first_pass_paid_rate,
  {rate('sum(cast(round(sim_paid_amt * 100) as hugeint))', 'sum(cast(round(sim_allowed_amt * 100) as hugeint))', 6)} as sim_net_collection_rate,
  cast(sum(cast(round(billed_charge_amt * 100) as hugeint)) as double) / 100 as source_billed_charge_amt,
  cast(sum(cast(round(sim_allowed_amt * 100) as hugeint)) as double) / 100 as sim_allowed_amt,
  cast(sum(cast(round(sim_paid_amt * 100) as hugeint)) as double) / 100 as sim_paid_amt,
  cast(sum(cast(round(sim_denied_amt * 100) as hugeint)) as double) / 100 as sim_denied_amt,
  sum(sim_cost_to_collect) as sim_cost_to_collect,
  {rate('sum(cast(round(sim_avg_days_to_payment * 10) as hugeint) * sim_claims_submitted)', '(10 * sum(sim_claims_submitted) filter (where sim_avg_days_to_payment is not null))', 2)} as sim_avg_days_to_payment,
  cast(sum(sim_claims_appealed) as bigint) as sim_claims_appealed,
  {rate('sum(sim_claims_overturned)', 'sum(sim_claims_appealed)', 6)} as sim_appeal_overturn_rate
from monthly"""

_REASONS = " union all ".join(
    f"select claim_sk, {i} as ord, '{REASON_CODES[name][0]}' as code from claims where {cond}"
    for i, (name, cond) in enumerate(
        [
            ("sim_auth_missing", "auth_missing"), ("sim_auth_obtained_late", "auth_late"),
            ("sim_eligibility_failed", "elig_failed"), ("sim_documentation_complete", "not doc_complete"),
            ("sim_coding_specificity_deficit", "deficit"), ("sim_duplicate_submission_flag", "dup"),
            ("sim_late_filing_flag", "late"),
        ]
    )
)


_PART_CASE = " ".join(f"when p_size between {lo} and {hi} then '{name}'" for name, lo, hi in SERVICE_LINES)
_TITLE_CASE = " ".join(f"when p_size between {lo} and {hi} then '{name.title()}'" for name, lo, hi in SERVICE_LINES)

_N = "(select count(*) from claims)"
_DENIED_N = "(select count(*) from claims where denied)"
_VIEW_CONTROLS = {
    "enriched:distinct_claim_sk==rowcount": f"(select count(distinct claim_sk) from claims) = {_N}",
    "executive:sum_claims==fact": f"(select sum(sim_claims_submitted) from monthly) = {_N}",
    "executive:sum_denied==denied": f"(select sum(sim_denied_claims) from monthly) = {_DENIED_N}",
    "executive:sum_billed==fact_billed": "(select round(sum(billed_charge_amt)) from monthly) = (select round(sum(billed_u) / 10000) from claims)",
    "denial_root_cause:sum_denials==denied": f"(select sum(sim_denial_count) from root) = {_DENIED_N}",
    "denial_root_cause:full+partial==denials": "(select sum(sim_full_denials + sim_partial_denials) from root) = (select sum(sim_denial_count) from root)",
    "ar_aging:sum_open==unpaid": "(select n from aging) = (select count(*) from claims where ar_open)",
    "ar_aging:five_buckets": "(select count(distinct payer) from payers) = 5",
    "ar_aging:denied+nondenied==open": "(select n = dn + nd from aging)",
    "payer:sum_claims==fact": f"(select sum(n) from payers) = {_N}",
    "payer:rowcount==distinct_payers": "(select count(*) from payers) = (select count(*) from payer_dim)",
    "provider:sum_claims==fact": f"(select sum(n) from providers) = {_N}",
    "provider:one_row_per_provider": "(select count(*) = count(distinct prvdr_num) from providers)",
    "monitoring:denial_rate_n==fact": f"(select sum(n) from months) = {_N}",
    "monitoring:all_labelled": f"{_N} > 0",
    "monitoring:outcome_kind_is_only_denial_rate": f"{_N} > 0",
}

SQL = {
    "contracts_quarantine": f"with {_QUARANTINE.strip()} select * from q",
    "contract_report": f"""with {_QUARANTINE.strip()},
spine(table_name, contract, reason) as (values
  ('lineitem', 'key_uniqueness', 'duplicate l_orderkey+l_linenumber'), ('lineitem', 'date_order', 'o_orderdate > l_shipdate'),
  ('lineitem', 'non_negative_money', 'l_extendedprice < 0'), ('customer', 'key_uniqueness', 'duplicate c_custkey'),
  ('customer', 'non_negative_money', 'c_acctbal < 0'), ('lineitem', 'required_columns', ''), ('customer', 'required_columns', ''))
select s.table_name, s.contract, s.reason, count(q.entity_key) as violations, count(q.entity_key) = 0 as passed
from spine s left join q using (table_name, contract, reason) group by 1, 2, 3""",
    "fk_violations": " union all ".join(
        f"select '{n}' as check_name, count(*) as violations, count(*) = 0 as passed from {c} where {ck} is not null "
        f"and not exists (select 1 from {p} where {p}.{pk} = {c}.{ck})"
        for n, c, ck, p, pk in _FKS
    ),
    "typed_stage_rejects": """
with t as (select cast(value as varchar) as v, json_extract_string(props, '$.k') as k, props from events)
select 'EVENT_DT' as column_name, 'date' as kind, count(*) as present, 0 as rejected from t
union all select 'LOAD_DT', 'date', count(*), count(*) from t
union all select 'VALUE_AMT', 'money', count(v), count(*) filter (where v is not null and try_cast(v as double) is null) from t
union all select 'PROPS_CNT', 'int', count(k), count(*) filter (where k is not null and try_cast(k as bigint) is null) from t
union all select 'RAW_QTY', 'int', count(props), count(*) filter (where props is not null and try_cast(props as bigint) is null) from t""",
    "null_profile": with_claims(_profile("claims", _PROFILE)),
    "manifest_drift": with_claims(
        """
select column_name, 'null_rate_changed' as deviation, a.null_rate as committed_value, b.null_rate as candidate_value
from pa a join pb b using (column_name) where abs(a.null_rate - b.null_rate) > 0.005
union all select column_name, 'column_removed', null_rate, null from pa where column_name not in (select column_name from pb)
union all select '*', 'row_count_changed', cast((select max(row_count) from pa) as double), cast((select max(row_count) from pb) as double)
where (select max(row_count) from pa) <> (select max(row_count) from pb)""",
        "late_claims as (select * from claims where submitted > {CUT})",
        f"pa as ({_profile('claims', _PROFILE)})",
        f"pb as ({_profile('late_claims', _PROFILE[1:])})",
    ),
    "calendar_dim": """
with d as (select distinct cast(o_orderdate as date) as full_date from orders union select distinct cast(l_shipdate as date) from lineitem
  union select null)
select coalesce(year(full_date) * 10000 + month(full_date) * 100 + day(full_date), 0) as date_key, full_date, year(full_date) as year,
  quarter(full_date) as quarter, month(full_date) as month, monthname(full_date) as month_name, day(full_date) as day,
  isodow(full_date) - 1 as day_of_week, dayname(full_date) as day_name, isodow(full_date) - 1 >= 5 as is_weekend from d""",
    "surrogate_dim": """
select 0 as part_name_key, 'UNKNOWN' as p_name, null as p_brand, 'DERIVED' as provenance
union all select row_number() over (order by p_name), p_name, arg_min(p_brand, p_partkey), 'SOURCE' from part group by p_name""",
    "header_fact": """
with dim as (select c_name, row_number() over (order by c_name) as bene_key from customer)
select o_orderkey, coalesce(dim.bene_key, 0) as bene_key,
  year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) as from_date_key, o_totalprice
from orders left join customer on c_custkey = o_custkey left join dim using (c_name)""",
    "slot_unpivot": """
select l_orderkey, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_returnflag) as integer) as dgns_seq,
  lpad(cast(l_partkey as varchar), 8, '0') as icd_dgns_cd, l_returnflag as poa_ind_sw from lineitem""",
    "bag_diff": """
select l_suppkey, l_returnflag, l_linestatus, cast(sum(n) as bigint) as excess from (
  select l_suppkey, l_returnflag, l_linestatus, 1 as n from lineitem
  union all select l_suppkey, l_returnflag, o_orderstatus, -1 from lineitem left join orders on o_orderkey = l_orderkey
) group by 1, 2, 3 having sum(n) <> 0""",
    "keys_agree": """
select (select count(*) from orders) as rows_a, count(*) as rows_b, (select cast(sum(o_orderkey) as double) from orders) as sum_a,
  cast(sum(k) as double) as sum_b, (select count(*) from orders) = count(*) and (select sum(o_orderkey) from orders) = sum(k) as passed
from (select distinct l_orderkey as k from lineitem)""",
    "dup_surplus": """
select cast(sum(n) as bigint) as row_count, count(*) as distinct_keys, cast(sum(n - 1) as bigint) as surplus
from (select count(*) as n from lineitem group by l_orderkey, l_linenumber)""",
    "code_coverage": """
select count(p_partkey) as matched, count(*) as total,
  cast(count(p_partkey) as double) / count(*) as coverage from lineitem left join part on p_partkey = l_partkey""",
    "enrich_dimension": """
select s_nationkey as code, s_suppkey, 'SOURCE' as provenance, case when n_name is not null then 'REFERENCE' else 'SOURCE' end as state_name_provenance,
  n_name as state_name from supplier left join nation n on n_nationkey = s_nationkey""",
    "hash_crosswalk": f"""
with e as (select s_suppkey, s_nationkey as state, case when s_acctbal < 5000 then 'MACHINERY' else 'NONE' end as kind,
    {hash_long('s_suppkey')} as draw from supplier),
pool as (select c_custkey, c_nationkey as state, c_mktsegment as kind from customer),
p1 as (select *, row_number() over (partition by state, kind order by c_custkey) as rk, count(*) over (partition by state, kind) as sz from pool),
p2 as (select *, row_number() over (partition by state order by c_custkey) as rk, count(*) over (partition by state) as sz from pool),
p3 as (select *, row_number() over (order by c_custkey) as rk, count(*) over () as sz from pool)
select e.s_suppkey, e.state, e.kind, coalesce(p1.c_custkey, p2.c_custkey, p3.c_custkey) as assigned,
  case when p1.c_custkey is not null then 'state+kind' when p2.c_custkey is not null then 'state' else 'nationwide' end as match_rule
from e left join p1 on p1.state = e.state and p1.kind = e.kind and p1.rk = e.draw % p1.sz + 1
  left join p2 on p2.state = e.state and p2.rk = e.draw % p2.sz + 1
  left join p3 on p3.rk = e.draw % p3.sz + 1""",
    "modal_segment": """
select c_nationkey, modal_segment from (
  select c_nationkey, c_mktsegment as modal_segment, row_number() over (partition by c_nationkey order by count(*) desc, c_mktsegment) as r
  from customer group by 1, 2) where r = 1""",
    "enriched_base": with_claims(
        f"""
select claim_sk, facility as prvdr_num, lpad(cast(p_size as varchar), 3, '0') as drg_cd, submitted as admission_date,
  service_date as discharge_date, payer_name as sim_payer_name, case {_TITLE_CASE} else 'Unknown' end as sim_service_line_name,
  case p_type when 'ECONOMY' then 'economy goods' end as prncpal_dgns_desc,
  case p_brand when 'Brand#2' then 'second brand' when 'Brand#17' then 'brand seventeen' end as admtg_dgns_desc,
  appeal_levels as sim_appeal_levels, overturned as any_overturned, {dollars4('recovered_u')} as recovered_amt,
  clean as sim_clean_claim_flag, first_pass as sim_first_pass_paid_flag, ar_open as sim_ar_open_flag,
  {dollars4('balance_u')} as sim_ar_balance_amt, ym as sim_submission_year_month from claims"""
    ),
    "appeal_bridge": with_claims(
        f"""select claim_sk, denial_type as sim_denial_type, appeal_levels as sim_appeal_levels, overturned as any_overturned,
  {dollars4('recovered_u')} as recovered_amt from claims where denied"""
    ),
    "range_bucket": f"""
select case {_PART_CASE} else 'UNKNOWN' end as service_line_id, count(*) as parts, min(p_size) as lo, max(p_size) as hi from part group by 1""",
    "outcome_checks": with_claims(
        " union all ".join(
            f"select '{n}' as check_name, count(*) filter (where {c}) as violations, count(*) filter (where {c}) = 0 as passed from claims"
            for n, c in _OUTCOME.items()
        )
    ),
    "dq_scorecard": with_claims(
        f"""
select check_id, dimension, numerator, denominator, threshold_min, severity,
  case when denominator = 0 then cast(numerator as double) else {rate('numerator', 'denominator', 6)} end as metric_value,
  case when severity = 'info' then null when denominator = 0 then numerator = threshold_min
    else {rate('numerator', 'denominator', 6)} >= threshold_min end as pass_flag
from rows""",
        """f as (select count(*) as n, (select count(*) from orders) as orders_n,
    (select count(*) from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)) as uncovered,
    (select count(*) from lineitem where not exists (select 1 from orders where l_orderkey = o_orderkey)) as orphans,
    (select count(*) from customer where c_acctbal < 0) as quarantined,
    (select count(*) from lineitem join part on p_partkey = l_partkey) as coded,
    (select count(*) from lineitem) as codes, count(*) filter (where denied and category is null) as no_category,
    count(*) filter (where allowed_u < 0 or paid_u < 0 or denied_u < 0) as negative,
    count(*) filter (where paid_u > allowed_u) as overpaid, count(billed_u) as billed,
    count(*) filter (where payer is null) as no_payer, count(payment_date) as with_payment from claims)""",
        """rows as (
  select 'adjudication_coverage' as check_id, 'completeness' as dimension, n as numerator, orders_n as denominator, 1.0::double as threshold_min, 'critical' as severity from f
  union all select 'line_orphans', 'referential_integrity', orphans, 0, 0, 'critical' from f
  union all select 'orders_without_lines', 'referential_integrity', uncovered, 0, 0, 'warning' from f
  union all select 'denial_category_consistency', 'validity', no_category, 0, 0, 'critical' from f
  union all select 'money_nonnegative', 'validity', negative, 0, 0, 'critical' from f
  union all select 'paid_le_allowed', 'validity', overpaid, 0, 0, 'critical' from f
  union all select 'billed_present', 'completeness', billed, n, 1.0, 'warning' from f
  union all select 'quarantine_rows', 'validity', quarantined, 0, 0, 'warning' from f
  union all select 'unknown_payer_routed', 'completeness_info', no_payer, n, null, 'info' from f
  union all select 'payment_present', 'completeness_info', with_payment, n, null, 'info' from f
  union all select 'code_description_coverage', 'reference_enrichment', coded, codes, null, 'info' from f)""",
    ),
    "view_reconcile": with_claims(
        " union all ".join(
            f"select '{n}' as check_name, case when {c} then 0 else 1 end as violations, {c} as passed"
            for n, c in _VIEW_CONTROLS.items()
        ),
        f"monthly as ({EXEC_BODY})",
        f"root as ({ROOT_BODY})",
        "aging as (select count(*) as n, count(*) filter (where denied) as dn, count(*) filter (where not denied) as nd from claims where ar_open)",
        "payers as (select payer, count(*) as n from claims group by payer)",
        "providers as (select prvdr_num, count(*) as n from claims group by prvdr_num)",
        "months as (select ym, count(*) as n from claims group by ym)",
    ),
    "exec_rollup": with_claims(_ROLL, f"monthly as ({EXEC_BODY})"),
    "control_totals": with_claims(
        """select count(*) as sim_sum_claims_submitted, count(*) filter (where denied) as sim_sum_denied_claims,
  count(distinct ym) as sim_months from claims"""
    ),
    "category_rollup": with_claims(
        f"""select sim_denial_category, cast(sum(sim_denial_count) as bigint) as denials,
  cast(sum(cast(round(sim_denied_amt * 100) as hugeint)) as double) / 100 as denied_amt,
  cast(sum(sim_claims_appealed) as bigint) as appealed, cast(sum(sim_claims_overturned) as bigint) as overturned,
  cast(sum(cast(round(sim_recovered_amt * 100) as hugeint)) as double) / 100 as recovered_amt,
  {rate('sum(sim_claims_appealed)', 'sum(sim_denial_count)')} as appeal_rate,
  {rate('sum(sim_claims_overturned)', 'sum(sim_claims_appealed)')} as overturn_rate from root group by 1""",
        f"root as ({ROOT_BODY})",
    ),
    "overturn_rates": with_claims(
        """select round(avg(r), 9) as mean_of_category_rates, round(cast(sum(o) as double) / sum(a), 9) as pooled_rate from (
  select category, count(appeal_levels) as a, count(*) filter (where overturned) as o,
    cast(count(*) filter (where overturned) as double) / count(appeal_levels) as r from claims where denied group by 1 having a > 0)"""
    ),
    "appeal_selection": with_claims(
        """select category as sim_denial_category, count(*) as denials, count(appeal_levels) as appealed_claims,
  cast(count(appeal_levels) as double) / count(*) as appeal_rate, cast(sum(denied_u) as double) / 10000 / count(denied_u) as mean_denied_amount,
  cast(count(*) filter (where overturned) as double) / nullif(count(appeal_levels), 0) as overturn_rate_given_appealed,
  count(appeal_levels) = 0 as no_training_support from claims where denied group by 1"""
    ),
    "thin_months": with_claims(
        """select min(m) as start, max(m) + 31 as "end" from (
  select m, sum(fresh) over (order by m) as run from (
    select m, case when m - lag(m) over (order by m) <= 62 then 0 else 1 end as fresh from monthly
    where n < 0.95 * (select quantile_cont(n, 0.5) from monthly))) group by run""",
        "monthly as (select cast(date_trunc('month', submitted) as date) as m, count(*) as n from claims group by 1)",
    ),
    "monitored_series": with_claims(
        f"""select cast(ym || '-01' as date) as month, {share_where('auth_missing', 6)} as value, count(*) as n from claims group by ym"""
    ),
    "top_codes": with_claims(
        f"""select lpad(cast(p_size as varchar), 3, '0') as drg_cd, category as sim_denial_category, count(*) as n,
  {rate('count(*)', '(select count(*) from claims)', 6)} as share from claims group by 1, 2
order by n desc, drg_cd nulls first, sim_denial_category nulls first limit 8"""
    ),
    "top_providers": with_claims(
        f"""select prvdr_num, count(*) as sim_provider_claims, {share_where('denied')} as sim_denial_rate from claims
group by 1 having count(*) >= 10 order by sim_denial_rate desc, sim_provider_claims desc, prvdr_num limit 50"""
    ),
    "reasons_top": with_claims(
        """select code, count(distinct claim_sk) as claims from (
  select *, row_number() over (partition by claim_sk order by ord) as r from reasons) where r <= 3
group by 1 order by claims desc, code limit 12""",
        f"reasons as ({_REASONS})",
    ),
    "claim_lookup": with_claims(
        """select '{"claim_sk":' || claim_sk || ',"clm_id":"' || clm_id || '","sim_payer_id":"' || payer || '","sim_denial_type":"' || denial_type
  || '","line_count":' || line_count || '}' as claim, '{"sim_facility_name":"' || facility || '"}' as facility_display
from claims where clm_id = 'CLM0000000042'"""
    ),
    "auth_status": with_claims(
        f"""select case when not auth_required then 'not_required' when auth_missing then 'required_missing'
    when auth_late then 'obtained_late' else 'obtained_ontime' end as auth_status, count(*) as claims,
  count(*) filter (where denied) as denied, {share_where('denied')} as rate from claims group by 1"""
    ),
    "direction_checks": with_claims(
        """select check_name, hi as high_rate, lo as low_rate, hi - lo as lift, hi - lo >= margin as passed from (
  select 'auth_missing raises' as check_name, avg(denied::int) filter (where auth_missing) as hi,
    avg(denied::int) filter (where not auth_required) as lo, 0.0 as margin from claims
  union all select 'documentation lowers', avg(denied::int) filter (where not doc_complete), avg(denied::int) filter (where doc_complete), 0.0 from claims
  union all select 'small claims are denied more', avg(denied::int) filter (where line_count <= 2), avg(denied::int) filter (where line_count > 5), 0.05 from claims)"""
    ),
    "band_checks": with_claims(
        """select *, value between low and high as passed from (
  select 'denial_rate' as check_name, cast(count(*) filter (where denied) as double) / count(*) as value, 0.1::double as low, 0.3::double as high from claims
  union all select 'open_rate', cast(count(*) filter (where ar_open) as double) / count(*), 0.05, 0.2 from claims
  union all select 'appeal_rate_of_denied', cast(count(appeal_levels) as double) / count(*) filter (where denied), 0.3, 0.6 from claims
  union all select 'overturn_rate', cast(count(*) filter (where overturned) as double) / count(overturned), 0.9, 1.0 from claims)"""
    ),
    "run_report": with_claims(
        f"""select count(*) as claims, cast(sum(line_count) as bigint) as lines, count(*) filter (where denied) as denied,
  count(distinct prvdr_num) as providers, min(submitted) as first_submission, max(submitted) as last_submission,
  {dollars4('sum(billed_u)')} as billed from claims"""
    ),
    "measures_long": with_claims(
        """select sim_denial_category, 'denied_amt' as measure, cast(sum(cast(round(sim_denied_amt * 100) as hugeint)) as double) / 100 as amount from root group by 1
union all select sim_denial_category, 'recovered_amt', cast(sum(cast(round(sim_recovered_amt * 100) as hugeint)) as double) / 100 from root group by 1""",
        f"root as ({ROOT_BODY})",
    ),
}

SQL = {name: text.replace("{CUT}", CUT) for name, text in SQL.items()}
