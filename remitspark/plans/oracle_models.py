"""Reference SQL of the evaluation, queue and probe queries."""

from __future__ import annotations

from ..operators.paired import POISSON, PRIME, resample_maps
from ..operators.workqueue import TIERS
from .oracle_base import CUT, dollars4, with_claims
from .oracle_data import SQL as DATA_SQL
from .oracle_data import hash_long
from .oracle_time import prior_rate_ctes
from .oracle_views import EXEC_BODY, ROOT_BODY

SCORED = """
doc as (select *, (20000 * cast(sum_discount as hugeint) + line_count) // (2 * line_count) as doc4,
    (20000 * cast(sum_quantity as hugeint) + line_count) // (2 * line_count) as cod4 from claims),
scored as (select *, cast(doc4 as double) / 10000 / 10 as score, denied::int as y, denied_u as amount_u from doc)"""

_S = SCORED.strip()

RULE_PAIRS = [("enr_score", "largest_denial_first"), ("enr_tiered_queue", "largest_denial_first"), ("enr_tiered_queue", "enr_score"), ("enr_score", "enr_score")]


def _ranking(groups: str) -> list[str]:
    part = f"partition by {groups} " if groups else ""
    cols = f"{groups}, " if groups else ""
    return [
        f"per as (select {cols}score, count(*) as n, sum(y) as pos from scored group by {cols}score)",
        f"""cum as (select *, coalesce(sum(n) over ({part}order by score desc rows between unbounded preceding and 1 preceding), 0) as n_above,
    coalesce(sum(pos) over ({part}order by score desc rows between unbounded preceding and 1 preceding), 0) as pos_above from per)""",
        f"""metrics as (select {cols}cast(sum(n) as bigint) as n, cast(sum(pos) as bigint) as positives, cast(sum(pos) as double) / sum(n) as base_rate,
    sum(n * score) / sum(n) as mean_predicted,
    sum(cast(n - pos as double) * (pos_above + pos / 2)) / (cast(sum(pos) as double) * sum(n - pos)) as roc_auc,
    sum(case when pos > 0 then pos * cast(pos_above + pos as double) / (n_above + n) else 0 end) / sum(pos) as pr_auc,
    sum(pos * (score - 1) * (score - 1) + (n - pos) * score * score) / sum(n) as brier from cum {f'group by {groups}' if groups else ''})""",
    ]


_GRID = [
    "grid as (select distinct unnest(quantile_cont(score, list_transform(range(200), lambda i: i / 199.0::double))) as threshold from scored)",
    """choice as (select threshold, count(*) as flagged, cast(sum(y) as bigint) as caught, cast(sum(case when y = 1 then amount_u else 0 end) as double) / 10000 as dollars,
    (select count(*) from scored) as n, (select sum(y) from scored) as p from grid join scored on score >= threshold group by threshold)""",
]


def _chosen(multiplier: str, extra: str = "") -> str:
    return f"""select {extra}round(threshold, 6) as threshold, round(benefit, 6) as net_benefit, flagged, round(cast(flagged as double) / n, 6) as flagged_share,
  caught, round(cast(caught as double) / greatest(1, p), 6) as recall, round(cast(caught as double) / greatest(1, flagged), 6) as precision
from (select *, row_number() over ({'partition by multiplier ' if extra else ''}order by benefit desc, threshold) as r
  from (select *, {multiplier} * dollars - 25 * flagged as benefit from choice{', multipliers' if extra else ''})) where r = 1"""


_ECON = "p * amount * 0.8::double - 45.0::double"


def _queue(days: str) -> str:
    whens = " ".join(f"when '{t}' then {i}" for i, t in enumerate(TIERS))
    return f"""tiered as (select *, {_ECON} as enr, {days} as days_left from qrows),
named as (select *, case when days_left < 0 then 'EXPIRED' when days_left <= 14 then 'DEADLINE_CRITICAL'
    when category in ('1-URGENT', '5-LOW') then 'MANDATORY_REVIEW' when enr <= 0 then 'BELOW_COST' else 'VALUE' end as tier from tiered),
ranked as (select *, case tier {whens} end as tier_rank from named)"""


_QROWS = """qrows as (select claim_sk, cast(doc4 as double) / 10000 / 200 as p, cast(denied_u as double) / 10000 as amount, review_date, category,
    cast(recovered_u as double) / 10000 as recovered, overturned from doc where denied)"""
_POSITION = "row_number() over (order by tier_rank, case when tier = 'DEADLINE_CRITICAL' then cast(days_left as double) else -enr end, claim_sk)"

_ARRIVAL = [_S, _QROWS, _queue("120"), f"queue as (select *, {_POSITION} as pos from ranked)"]
_SNAPS = [
    _S,
    _QROWS.replace("qrows as", "base as"),
    """bounds as (select min(review_date) as lo, max(review_date) as hi from base),
snaps as (select cast(unnest(generate_series(cast(date_trunc('month', lo) as timestamp), cast(hi as timestamp), interval 1 month)) as date) as as_of from bounds),
qrows as (select b.*, as_of from base b join snaps on review_date <= as_of and as_of <= review_date + 120 where as_of >= (select lo from bounds))""",
    _queue("(review_date + 120) - as_of"),
]


def _top(source: str, score: str, key: str, fraction: float) -> str:
    return (
        f"select *, row_number() over (order by {score} desc, {hash_long(key)}, {key}) <= greatest(1, round_even(count(*) over () * {fraction}, 0)) as in_top from {source}"
    )


def _level(column: str, bins: int, numeric: bool) -> str:
    """Row-wise level: 1 + edges below the value, or the value itself."""
    if not numeric:
        return f"coalesce(cast({column} as varchar), '~')"
    edges = f"(select list_distinct(quantile_cont({column}, list_transform(range(1, {bins}), lambda i: i / {bins}.0::double))) from levels)"
    few = f"(select count(distinct {column}) <= {bins} from levels)"
    return f"case when {column} is null then '~' when {few} then cast({column} as varchar) else cast(len(list_filter({edges}, lambda e: e < {column})) as varchar) end"


_PROBES = {
    "sim_documentation_score": ("cast(doc4 as double) / 10000", True),
    "sim_coding_complexity_score": ("cast(cod4 as double) / 10000", True),
    "line_count": ("cast(line_count as double)", True),
    "sim_auth_missing": ("auth_missing", False),
    "sim_payer_id": ("payer", False),
    "sim_days_service_to_submission": ("cast(service_days as double)", True),
}
_TRUTH = {
    "sim_denial_type": ("denial_type", False),
    "sim_denied_amount": ("cast(denied_u as double) / 10000", True),
    "sim_days_to_payment": ("cast(days_pay as double)", True),
    "sim_appeal_levels": ("appeal_levels", False),
}
_PAIRS = " union all ".join(
    f"select '{a}' as feature, '{b}' as forbidden, f_{a} as x, t_{b} as f, count(*) as n from coded group by 3, 4"
    for a in _PROBES
    for b in _TRUTH
)


def _entropy(keys: str, name: str) -> str:
    return (
        f"{name} as (select feature, forbidden, ln(sum(n)) - sum(n * ln(n)) / sum(n) as h from "
        f"(select feature, forbidden, {keys}, cast(sum(n) as double) as n from joint group by all) group by 1, 2)"
    )


def _single_auc(name: str, score: str, source: str) -> str:
    return f"select '{name}' as feature, {score} as score, y from {source}"


_ENCODED = " union all ".join(
    f"""select '{name}' as feature,
  coalesce(cast(sum(y) over (partition by lv) - sum(y) over (partition by lv, fold) as double)
      / nullif(count(*) over (partition by lv) - count(*) over (partition by lv, fold), 0),
    cast(sum(y) over () - sum(y) over (partition by fold) as double) / nullif(count(*) over () - count(*) over (partition by fold), 0)) as score, y
from (select y, fold, coalesce(cast({col} as varchar), '~') as lv from folded)"""
    for name, col in (("sim_payer_id", "payer"), ("drg_cd", "p_size"))
)
_AUC_TAIL = [
    "per as (select feature, score, count(*) as n, sum(y) as pos from longs group by 1, 2)",
    "cum as (select *, coalesce(sum(pos) over (partition by feature order by score desc rows between unbounded preceding and 1 preceding), 0) as pa from per)",
    "a as (select feature, sum(cast(n - pos as double) * (pa + pos / 2)) / (cast(sum(pos) as double) * sum(n - pos)) as auc from cum group by 1)",
]
_AUC_OUT = "select feature, round(coalesce(greatest(auc, 1 - auc), 0.5), 9) as auc from a"

_SUB = {
    "sim_documentation_score": "cast(doc4 as double) / 10000",
    "sim_coding_complexity_score": "cast(cod4 as double) / 10000",
    "sim_days_service_to_submission": "service_days",
    "sim_filing_limit_days": "limit_days",
    "billed_charge_amt": "cast(billed_u as double) / 10000",
    "length_of_stay_days": "stay_days",
    "diagnosis_count": "line_count",
    "log_billed_charge_amt": "ln(1 + cast(billed_u as double) / 10000)",
    "sim_filing_headroom_days": "limit_days - service_days",
    "sim_filing_use_ratio": "cast(service_days as double) / limit_days",
    "sim_coding_lag_days": "service_days",
    "sim_overall_prior_denial_rate": "book",
    **{f"sim_{n}_prior_{m}": f"{n}_{m}" for n in ("payer", "provider", "service_line") for m in ("denial_rate", "claims")},
}
_FEATURE_ROWS = " union all ".join(
    f"select '{n}' as feature, count({c}) as present, round(min(cast({c} as double)), 6) as lo, round(max(cast({c} as double)), 6) as hi from final"
    for n, c in _SUB.items()
)
_CENTS = "cast(sum(cast(round({c} * {m}) as hugeint)) as double) / {m}"


def _exact_sum(column: str, scale: int = 100) -> str:
    return _CENTS.format(c=column, m=scale)


SQL = {
    "submission_features": with_claims(
        _FEATURE_ROWS,
        "rows as (select *, denied::int as y, (20000 * cast(sum_discount as hugeint) + line_count) // (2 * line_count) as doc4, "
        "(20000 * cast(sum_quantity as hugeint) + line_count) // (2 * line_count) as cod4 from claims)",
        *prior_rate_ctes(
            "rows", "y", 60, {"payer": "payer", "provider": "prvdr_num", "service_line": "service_line"},
            "doc4, cod4, service_days, limit_days, billed_u, stay_days, line_count", "book", ("{}_denial_rate", "{}_claims"),
        ),
    ),
    "headline": with_claims(
        f"""select {_exact_sum('sim_recovered_amt')} as recovered_amt, {_exact_sum('sim_denied_amt')} as denied_amt,
  cast(sum(sim_claims_appealed) as bigint) as appeals_filed, cast(sum(sim_claims_overturned) as bigint) as appeals_overturned,
  round(sum(sim_recovered_amt) / sum(sim_denied_amt), 4) as recovered_share,
  (select round(sum(amount), 4) from queue) as dollars_at_stake, (select round(sum(greatest(enr, 0)), 4) from queue) as net_recovery,
  (select count(*) filter (where pass_flag) from ({DATA_SQL['dq_scorecard']})) as checks_passing,
  (select count(*) filter (where not pass_flag and severity = 'critical') from ({DATA_SQL['dq_scorecard']})) as critical_failing from root""",
        f"root as ({ROOT_BODY})",
        *_ARRIVAL,
    ),
    "figure_reconcile": with_claims(
        f"""select *, case when control is null then 'MISSING_INPUT' when abs(figure - control) <= tol then 'PASS' else 'FAIL' end as status from (
  select 'rollup claims' as check_name, cast(sum(sim_claims_submitted) as double) as figure, (select cast(count(*) as double) from claims) as control, 0 as tol from monthly
  union all select 'rollup denied', sum(sim_denied_claims), (select count(*) from claims where denied), 0 from monthly
  union all select 'rollup billed', {_exact_sum('billed_charge_amt')}, (select {dollars4('sum(billed_u)')} from claims), 1 from monthly
  union all select 'root cause denied amount', {_exact_sum('sim_denied_amt')}, (select {dollars4('sum(denied_u)')} from claims where denied), 1 from root
  union all select 'root cause shares', {_exact_sum('sim_share_of_denials', 10000)}, 1, 0.01 from root
  union all select 'model metrics', null, null, 0) r""",
        f"monthly as ({EXEC_BODY})",
        f"root as ({ROOT_BODY})",
    ).replace("select *, case when control", "select check_name, figure, control, case when control"),
    "auc_ap_brier": with_claims(
        """select n, positives, round(base_rate, 9) as base_rate, round(mean_predicted, 9) as mean_predicted, round(roc_auc, 9) as roc_auc,
  round(pr_auc, 9) as pr_auc, round(brier, 9) as brier, round(pr_auc / base_rate, 9) as pr_auc_lift from metrics""",
        _S,
        *_ranking(""),
    ),
    "slices": with_claims(
        """select payer as slice, n, positives, round(base_rate, 9) as base_rate, round(mean_predicted, 9) as mean_predicted,
  case when positives >= 20 and positives < n then round(roc_auc, 9) end as roc_auc,
  case when positives >= 20 and positives < n then round(pr_auc, 9) end as pr_auc, round(brier, 9) as brier,
  not (positives >= 20 and positives < n) as too_thin_to_score from metrics""",
        _S,
        *_ranking("payer"),
    ),
    "dollar_capture": with_claims(
        f"""select count(*) as row_count, count(*) filter (where in_top) as worked,
  {dollars4('sum(case when in_top and y = 1 then amount_u else 0 end)')} as captured, {dollars4('sum(case when y = 1 then amount_u else 0 end)')} as total,
  ({dollars4('sum(case when in_top and y = 1 then amount_u else 0 end)')}) / ({dollars4('sum(case when y = 1 then amount_u else 0 end)')}) as share from t""",
        _S,
        f"t as ({_top('scored', 'score', 'claim_sk', 0.10)})",
    ),
    "calibration": with_claims(
        """select bin, count(*) as n, round(avg(score), 9) as mean_predicted, round(avg(y), 9) as observed_rate, round(avg(score) - avg(y), 9) as gap from b group by bin""",
        _S,
        """b as (select score, y, greatest((10 * (r - 1) + (n - 1) - 1) // (n - 1) - 1, 0) as bin
  from (select score, y, row_number() over (order by score, claim_sk) as r, count(*) over () as n from scored))""",
    ),
    "calibration_error": with_claims(
        """select round(sum(n * abs(gap)) / sum(n), 9) as ece from (select count(*) as n, avg(score) - avg(y) as gap from b group by bin)""",
        _S,
        """b as (select score, y, greatest((10 * (r - 1) + (n - 1) - 1) // (n - 1) - 1, 0) as bin
  from (select score, y, row_number() over (order by score, claim_sk) as r, count(*) over () as n from scored))""",
    ),
    "threshold_cost": with_claims(_chosen("0.125::double"), _S, *_GRID),
    "sensitivity": with_claims(
        _chosen("multiplier", "multiplier, "),
        _S,
        *_GRID,
        "multipliers as (select unnest([0.005, 0.01, 0.025, 0.055, 0.075, 0.125, 0.25, 0.5, 1.0]::double[]) as multiplier)",
    ),
    "threshold_capacity": with_claims(
        """select round(cut, 6) as threshold, round(0.125::double * dollars - 25 * flagged, 6) as net_benefit, flagged,
  round(cast(flagged as double) / n, 6) as flagged_share, caught, round(cast(caught as double) / p, 6) as recall,
  round(cast(caught as double) / greatest(1, flagged), 6) as precision
from (select any_value(cut) as cut, count(*) filter (where score >= cut) as flagged, count(*) filter (where score >= cut and y = 1) as caught,
  cast(coalesce(sum(amount_u) filter (where score >= cut and y = 1), 0) as double) / 10000 as dollars, count(*) as n, sum(y) as p
  from scored, (select quantile_cont(score, 0.9) as cut from scored where submitted <= {CUT}) where submitted > {CUT})""",
        _S,
    ),
    "break_even": with_claims(
        """select round(r, 6) as rate, round(a, 6) as mean_amount, round(25 / (r * a), 6) as break_even_multiplier
from (select avg(y) as r, cast(sum(amount_u) as double) / 10000 / count(*) as a from scored)""",
        _S,
    ),
    "concentration": with_claims(
        """select round(t, 6) as top_k, round(s, 6) as total, round(t / s, 6) as share from
  (select cast(sum(amount_u) as double) / 10000 as t from (select amount_u from scored order by amount_u desc limit 10)),
  (select cast(sum(amount_u) as double) / 10000 as s from scored)""",
        _S,
    ),
    "value_bands": with_claims(
        f"""select len(list_filter(e, lambda x: x < cast(allowed_u as double) / 10000)) as value_band, count(*) as n, {dollars4('sum(allowed_u)')} as allowed
from claims, (select quantile_cont(cast(allowed_u as double) / 10000, [0.25, 0.5, 0.75, 0.9]) as e from claims where submitted <= {CUT}) group by 1"""
    ),
    "risk_bands": with_claims(
        """select case when score / 2 < 0.06 then 'low' when score / 2 < 0.13 then 'moderate' when score / 2 < 0.26 then 'elevated' else 'high' end as band,
  count(*) as n, cast(sum(y) as bigint) as denied from scored group by 1""",
        _S,
    ),
    "group_rate": with_claims(
        """select claim_sk, c.payer as sim_payer_id, coalesce(r, (select avg(denied::int) from claims where submitted <= {CUT})) as score
from claims c left join (select payer, avg(denied::int) as r from claims where submitted <= {CUT} group by 1) g
  on g.payer = c.payer where submitted > {CUT}"""
    ),
    "base_rate": with_claims(
        """select (select avg(denied::int) from claims where submitted <= {CUT}) as score, count(*) as n from claims where submitted > {CUT}"""
    ),
    "work_queue": with_claims(
        f"""select claim_sk, p as sim_p_overturn, amount as sim_recoverable_amt, p * amount * 0.8::double as sim_expected_recovery_amt,
  enr as sim_expected_net_recovery, days_left as sim_days_to_deadline, category as sim_denial_category, review_date as sim_denial_review_date,
  tier, tier_rank, {_POSITION} as queue_position, date '1999-03-01' as as_of from ranked""",
        _S,
        _QROWS.replace("where denied", "where denied and review_date <= date '1999-03-01'"),
        _queue("(review_date + 120) - date '1999-03-01'"),
    ),
    "work_queue_arrival": with_claims(
        """select claim_sk, enr as sim_expected_net_recovery, tier, pos as queue_position, days_left as sim_days_to_deadline,
  (select max(review_date) from qrows) as as_of from queue""",
        *_ARRIVAL,
    ),
    "queue_guarantee": with_claims(
        "select t.tier, count(q.claim_sk) as n, 0 as broken_boundaries from t left join queue q on q.tier = t.tier group by 1",
        *_ARRIVAL,
        "t(tier) as (values " + ", ".join(f"('{t}')" for t in TIERS) + ")",
    ),
    "queue_page": with_claims(
        "select claim_sk, tier, pos as queue_position from queue where tier = 'MANDATORY_REVIEW' order by pos limit 25 offset 25",
        *_ARRIVAL,
    ),
    "month_queues": with_claims(
        "select tier, count(*) as appearances, count(distinct claim_sk) as claims from named group by 1", *_SNAPS
    ),
    "month_snapshots": with_claims("select as_of, tier, count(*) as open_claims from named group by 1, 2", *_SNAPS),
    "recovery_ratio": with_claims(
        """select coalesce(denial_type, 'ALL') as sim_denial_type, round(avg(cast(recovered_u as double) / nullif(cast(denied_u as double), 0)), 9) as ratio, count(*) as n
from claims where overturned group by grouping sets ((denial_type), ())"""
    ),
    "rule_compare": with_claims(
        """select rule, count(*) as queue_rows, count(*) filter (where in_top) as worked, round(coalesce(sum(recovered) filter (where in_top), 0), 6) as captured,
  round(sum(recovered), 6) as total, round(coalesce(sum(recovered) filter (where in_top), 0) / sum(recovered), 6) as share from picks group by 1""",
        _S,
        _QROWS.replace("where denied", "where denied and overturned is not null"),
        _queue("120"),
        f"queue as (select *, {_POSITION} as pos from ranked)",
        """rules as (select 'enr_score' as rule, enr as sc, claim_sk, recovered from queue union all select 'largest_denial_first', amount, claim_sk, recovered from queue
    union all select 'constant', 0, claim_sk, recovered from queue union all select 'enr_tiered_queue', -pos, claim_sk, recovered from queue)""",
        f"""picks as (select *, row_number() over (partition by rule order by sc desc, {hash_long('claim_sk')}, claim_sk)
    <= greatest(1, round_even(count(*) over (partition by rule) * 0.1, 0)) as in_top from rules)""",
    ),
    "rule_differences": with_claims(
        f"""select difference, round(max(d) filter (where b = -1), 6) as point, round(quantile_cont(d, 0.025) filter (where b >= 0), 6) as low,
  round(quantile_cont(d, 0.975) filter (where b >= 0), 6) as high, cast(count(d) filter (where b >= 0) as integer) as draws
from (select difference, x.b, x.share - y.share as d from pairs join shares x on x.rule = pairs.l join shares y on y.rule = pairs.r and y.b = x.b) group by 1""",
        _S,
        _QROWS.replace("where denied", "where denied and overturned is not null"),
        _queue("120"),
        f"queue as (select *, {_POSITION} as pos from ranked)",
        """rules as (select 'enr_score' as rule, enr as sc, claim_sk, recovered from queue union all select 'largest_denial_first', amount, claim_sk, recovered from queue
    union all select 'enr_tiered_queue', -pos, claim_sk, recovered from queue)""",
        f"""drawn as (select rule, sc, claim_sk, coalesce(recovered, 0) as money, m.b, {hash_long('claim_sk')} as tie,
    case when m.b < 0 then 1 else len(list_filter([{', '.join(map(str, POISSON))}], lambda t: (tie % {PRIME} * m.f + m.s) % {PRIME} >= t)) end as w
  from rules, (values (-1, 0, 0), {', '.join(f'({b}, {f}, {s})' for b, (f, s) in enumerate(resample_maps(200, 1337)))}) m(b, f, s))""",
        """placed as (select *, sum(w) over (partition by rule, b order by sc desc, tie, claim_sk) - w as before,
    greatest(1, round_even(sum(w) over (partition by rule, b) * 0.1, 0)) as cut from drawn)""",
        "shares as (select rule, b, sum(money * greatest(0, least(w, cut - before))) / sum(money * w) as share from placed group by 1, 2)",
        "pairs(difference, l, r) as (values " + ", ".join(f"('{a}_minus_{b}', '{a}', '{b}')" for a, b in RULE_PAIRS) + ")",
    ),
    "probability_source": with_claims(
        """select claim_sk, asked, cat as category, round(coalesce(given, shipped, r, (select avg(r) from rates)), 9) as probability,
  case when given is not null then 'caller' when shipped is not null then 'shipped_score' when r is not null then 'category_rule' else 'book_rate' end as probability_source
from (select claim_sk, asked, case when asked <> 'neither' then category end as cat, case when asked = 'estimate' then cast(cod4 as double) / 10000 / 50 end as given,
  case when asked in ('estimate', 'claim') then cast(doc4 as double) / 10000 / 200 end as shipped
  from doc, (values ('estimate'), ('claim'), ('category'), ('neither')) ways(asked) where denied) q left join rates on rates.category = q.cat""",
        _S,
        """rates as (select category, cast(count(*) filter (where overturned) as double) / count(appeal_levels) as r from claims where denied group by 1 having count(appeal_levels) > 0)""",
    ),
    "imputation": with_claims(
        """select 5 - len(l) as supplied_count, len(l) as imputed_count, array_to_string(l, ',') as imputed, count(*) as requests from (
  select list_sort(list_filter([case when days_adj is null then 'sim_days_to_adjudication' end, case when days_pay is null then 'sim_days_to_payment' end,
    case when category is null then 'sim_denial_category' end, case when line_count is null then 'line_count' end, 'sim_payer_id'], lambda x: x is not null)) as l from claims) group by all"""
    ),
    "mi_dependency": with_claims(
        """select feature, forbidden, round(case when hx.h <= 1e-12 then 0 else greatest(hx.h + hf.h - hxf.h, 0) / hx.h end, 9) as u
from hx join hf using (feature, forbidden) join hxf using (feature, forbidden)""",
        _S,
        "levels as (select " + ", ".join(f"{sql} as c_{n}" for n, (sql, _) in {**_PROBES, **_TRUTH}.items()) + " from doc)",
        "coded as (select "
        + ", ".join(f"{_level('c_' + n, 12, num)} as f_{n}" for n, (_, num) in _PROBES.items())
        + ", "
        + ", ".join(f"{_level('c_' + n, 64, num)} as t_{n}" for n, (_, num) in _TRUTH.items())
        + " from levels)",
        f"joint as ({_PAIRS})",
        _entropy("x", "hx"),
        _entropy("f", "hf"),
        _entropy("x, f", "hxf"),
    ),
    "feature_auc": with_claims(
        _AUC_OUT,
        _S,
        f"folded as (select *, {hash_long('claim_sk')} % 5 as fold from scored)",
        "longs as ("
        + " union all ".join(
            _single_auc(n, f"coalesce({c}, (select quantile_cont({c}, 0.5) from scored))", "scored")
            for n, c in (
                ("sim_documentation_score", "cast(doc4 as double) / 10000"), ("line_count", "cast(line_count as double)"),
                ("sim_days_to_payment", "cast(days_pay as double)"),
            )
        )
        + f" union all {_ENCODED})",
        *_AUC_TAIL,
    ),
    "null_auc": with_claims(
        _AUC_OUT,
        "longs as ("
        + " union all ".join(
            f"select '{n}' as feature, ({c} is null)::int as score, denied::int as y from claims"
            for n, c in (
                ("sim_denial_review_date", "review_date"), ("sim_days_to_payment", "days_pay"),
                ("sim_adjudication_date", "adjudicated"),
            )
        )
        + ")",
        *_AUC_TAIL,
    ),
    "identifiers": with_claims(
        """select 'hidden_key' as feature, round(corr(a, b), 9) as rho
from (select rank() over (order by claim_sk * 3 + 7) as a, rank() over (order by claim_sk) as b from claims)"""
    ),
    "lineage": """
with b as (select l_orderkey as k, count(*) filter (where l_returnflag = 'R') as r, count(*) as n from lineitem group by 1)
select 'flag' as input_column, 'denied' as column_name, count(*) filter (where (2 * r > n) <> (2 * (n - r) > n)) as changed_rows from b
union all select 'flag', 'denied_cents', count(*) from (select l_orderkey, sum(case when l_returnflag = 'R' then cast(round(l_extendedprice * 100) as bigint) else 0 end) as a,
  sum(case when l_returnflag = 'R' then 0 else cast(round(l_extendedprice * 100) as bigint) end) as c from lineitem group by 1) where a <> c
union all select 'cents', 'billed_cents', count(*) from b
union all select 'cents', 'denied_cents', count(*) filter (where r > 0) from b
union all select 'supp', 'provider', count(*) from b""",
}

SQL = {name: text.replace("{CUT}", CUT) for name, text in SQL.items()}
