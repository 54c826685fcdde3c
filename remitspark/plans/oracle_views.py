"""Reference SQL of the KPI views."""

from __future__ import annotations

from .oracle_base import AS_OF, among, dollars, mean, rate, share_where, units_ratio, with_claims
from .views import AGING_BUCKETS

EXEC_BODY = f"""
select ym as sim_submission_year_month, min(submitted) as sim_month_start, count(*) as sim_claims_submitted,
  count(*) filter (where denied) as sim_denied_claims, count(*) filter (where clean) as sim_clean_claims,
  count(*) filter (where first_pass) as sim_first_pass_paid_claims,
  {share_where('denied')} as sim_denial_rate, {share_where('clean')} as sim_clean_claim_rate,
  {share_where('first_pass')} as sim_first_pass_paid_rate, {share_where('late')} as sim_late_filing_rate,
  {dollars('sum(billed_u)')} as billed_charge_amt, {dollars('sum(paid_u)')} as medicare_source_paid_amt,
  {dollars('sum(allowed_u)')} as sim_allowed_amt, {dollars('sum(paid_u)')} as sim_paid_amt,
  {dollars('sum(denied_u)')} as sim_denied_amt,
  {units_ratio('sum(paid_u)', 'sum(allowed_u)')} as sim_net_collection_rate,
  {mean('days_pay')} as sim_avg_days_to_payment, {mean('days_adj')} as sim_avg_days_to_adjudication,
  count(*) filter (where appeal_levels is not null) as sim_claims_appealed,
  count(*) filter (where overturned) as sim_claims_overturned,
  {among('overturned', 'appeal_levels is not null')} as sim_appeal_overturn_rate,
  {dollars('coalesce(sum(recovered_u), 0)')} as sim_appeal_recovered_amt,
  cast(sum(total_cost) as double) as sim_cost_to_collect,
  {rate('sum(total_cost) * 10000', 'sum(paid_u)')} as sim_cost_to_collect_ratio
from claims group by ym"""

ROOT_BODY = f"""
select category as sim_denial_category, carc as sim_denial_carc_group, driver as sim_denial_driver_mechanism,
  count(*) as sim_denial_count, count(*) filter (where denial_type = 'FULL') as sim_full_denials,
  count(*) filter (where denial_type = 'PARTIAL') as sim_partial_denials,
  {dollars('sum(denied_u)')} as sim_denied_amt, {rate('sum(denied_u)', 'count(*) * 10000', 2)} as sim_avg_denied_amt,
  cast(sum(rework_cost) as double) as sim_rework_cost,
  count(*) filter (where appeal_levels is not null) as sim_claims_appealed,
  {share_where('appeal_levels is not null')} as sim_appeal_rate,
  count(*) filter (where overturned) as sim_claims_overturned,
  {among('overturned', 'appeal_levels is not null')} as sim_overturn_rate_of_appealed,
  {dollars('coalesce(sum(recovered_u), 0)')} as sim_recovered_amt,
  {rate('count(*)', '(select count(*) from claims where denied)')} as sim_share_of_denials
from claims where denied group by category, carc, driver"""

_SPINE = ", ".join(f"('{label}', {sort})" for label, sort, _ in AGING_BUCKETS)
_SORT = " ".join(f"when days <= {upper} then {sort}" for _, sort, upper in AGING_BUCKETS if upper)

_QUEUE = f"""
actionable as (
  select c.*, (as_of.d - c.submitted) as age, case when denied then denied_u else balance_u end as stake_u
  from claims c, as_of where denied or ar_open),
scored as (
  select *, (2 * cast(stake_u as hugeint) * (365 + least(greatest(age, 0), 365)) + 36500) // 73000 as score_cents
  from actionable)"""

SQL = {
    "exec_monthly": with_claims(EXEC_BODY),
    "root_cause": with_claims(ROOT_BODY),
    "root_cause_labelled": with_claims(
        f"""select r.*, l.label as carc_category_label from ({ROOT_BODY}) r left join (
  select substr(o_orderpriority, 1, 1) as code, min(case when length(o_orderpriority) > 2
    then upper(substr(o_orderpriority, 3, 1)) || lower(substr(o_orderpriority, 4)) end) as label from orders group by 1) l on l.code = r.sim_denial_carc_group"""
    ),
    "ar_aging": with_claims(
        f"""
select spine.label as sim_aging_bucket, spine.sort as bucket_sort, count(b.claim_sk) as sim_open_claims,
  count(b.claim_sk) filter (where b.denied) as sim_denied_open_claims,
  count(b.claim_sk) filter (where not b.denied) as sim_nondenied_open_claims,
  {dollars('coalesce(sum(b.balance_u), 0)')} as sim_ar_balance_amt,
  {dollars('coalesce(sum(b.billed_u), 0)')} as sim_source_billed_at_risk_amt,
  {rate('sum(b.days)', 'count(b.days)', 1)} as sim_avg_days_outstanding,
  min(b.days) as sim_min_days_outstanding, max(b.days) as sim_max_days_outstanding
from spine left join bucketed b on b.sort = spine.sort group by spine.label, spine.sort""",
        AS_OF,
        "open_claims as (select c.*, as_of.d - c.submitted as days from claims c, as_of where ar_open)",
        f"bucketed as (select *, case {_SORT} else {AGING_BUCKETS[-1][1]} end as sort from open_claims)",
        f"spine(label, sort) as (values {_SPINE})",
    ),
    "payer_perf": with_claims(
        f"""
select payer as sim_payer_id, payer_name as sim_payer_name, max(cast(mix_share as double)) as sim_payer_mix_share_config,
  max(filing_days) as sim_timely_filing_days, count(*) as sim_claims,
  {rate('count(*)', '(select count(*) from claims)')} as sim_realized_claim_share,
  count(*) filter (where denied) as sim_denied_claims, {share_where('denied')} as sim_denial_rate,
  {share_where('clean')} as sim_clean_claim_rate, {share_where('late')} as sim_late_filing_rate,
  {dollars('sum(billed_u)')} as sim_source_billed_amt, {dollars('sum(allowed_u)')} as sim_allowed_amt,
  {dollars('sum(paid_u)')} as sim_paid_amt, {units_ratio('sum(paid_u)', 'sum(allowed_u)')} as sim_net_collection_rate,
  {units_ratio('sum(paid_u)', 'sum(billed_u)')} as sim_paid_to_billed_ratio,
  {mean('days_pay')} as sim_avg_days_to_payment, quantile_cont(days_pay, 0.5) as sim_median_days_to_payment,
  {mean('days_adj')} as sim_avg_days_to_adjudication,
  count(*) filter (where appeal_levels is not null) as sim_claims_appealed,
  {among('overturned', 'appeal_levels is not null')} as sim_appeal_overturn_rate,
  {dollars('coalesce(sum(recovered_u), 0)')} as sim_appeal_recovered_amt,
  cast(sum(total_cost) as double) as sim_cost_to_collect
from claims group by payer, payer_name"""
    ),
    "provider_quality": with_claims(
        f"""
select prvdr_num, max(provider_state_cd) as provider_state_cd, max(facility) as sim_display_facility_name,
  count(*) as sim_provider_claims, count(*) filter (where clean) as sim_clean_claims,
  count(*) filter (where first_pass) as sim_first_pass_paid_claims,
  count(*) filter (where denied) as sim_denied_claims, {share_where('clean')} as sim_clean_claim_rate,
  {share_where('first_pass')} as sim_first_pass_paid_rate, {share_where('denied')} as sim_denial_rate,
  {share_where('late')} as sim_late_filing_rate, {share_where('rework_cost > 0')} as sim_rework_rate,
  {dollars('sum(billed_u)')} as source_billed_amt, {dollars('sum(paid_u)')} as sim_paid_amt,
  cast(sum(rework_cost) as double) as sim_rework_cost, count(*) < 10 as low_volume_flag
from claims group by prvdr_num"""
    ),
    "heuristic_queue": with_claims(
        """
select claim_sk, clm_id, prvdr_num, facility as sim_facility_name, payer as sim_payer_id,
  case when denied and coalesce(appeal_levels, 0) = 0 then 'DENIAL_REWORK'
    when denied and appeal_levels > 0 and not overturned then 'APPEAL_REVIEW'
    when denied then 'DENIAL_RESOLVED_MONITOR' else 'AR_FOLLOWUP' end as sim_action_type,
  denied as sim_denial_flag, category as sim_denial_category, denial_type as sim_denial_type,
  ar_open as sim_ar_open_flag, age as sim_age_days, cast((stake_u + 50) // 100 as double) / 100 as sim_dollars_at_stake,
  cast(score_cents as double) / 100 as sim_heuristic_priority_score,
  ntile(4) over (order by score_cents desc, claim_sk) as sim_priority_tier,
  coalesce(appeal_levels, 0) as sim_appeal_levels, true as is_heuristic_placeholder
from scored""",
        AS_OF,
        _QUEUE.strip(),
    ),
    "drift_monthly": with_claims(
        """
select ym as sim_submission_year_month, feature_name,
  case when feature_name = 'denial_rate' then 'outcome_rate' else 'pre_submission_feature' end as metric_kind,
  n as sim_n_claims, value as sim_metric_value, true as is_drift_scaffold
from (unpivot monthly on auth_required_rate, auth_missing_rate, eligibility_failed_rate, documentation_complete_rate,
  coding_specificity_deficit_rate, duplicate_submission_rate, avg_documentation_score, avg_coding_complexity_score,
  denial_rate into name feature_name value value)""",
        f"""scores as (
  select *, (20000 * cast(sum_discount as hugeint) + line_count) // (2 * line_count) as doc4,
    (20000 * cast(sum_quantity as hugeint) + line_count) // (2 * line_count) as cod4 from claims),
monthly as (select ym, count(*) as n, {share_where('auth_required', 6)} as auth_required_rate,
  {share_where('auth_missing', 6)} as auth_missing_rate, {share_where('elig_failed', 6)} as eligibility_failed_rate,
  {share_where('doc_complete', 6)} as documentation_complete_rate,
  {share_where('deficit', 6)} as coding_specificity_deficit_rate, {share_where('dup', 6)} as duplicate_submission_rate,
  {rate('sum(doc4)', 'count(*) * 10000', 6)} as avg_documentation_score,
  {rate('sum(cod4)', 'count(*) * 10000', 6)} as avg_coding_complexity_score,
  {share_where('denied', 6)} as denial_rate from scores group by ym)""",
    ),
}
