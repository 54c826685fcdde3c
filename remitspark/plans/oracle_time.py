"""Reference SQL of the temporal, event and survival queries."""

from __future__ import annotations

from .oracle_base import rate, with_claims
from .oracle_views import SQL as VIEW_SQL

_DAY = "(submitted - date '1970-01-01')"


def _prior(key: str | None, outcome: str, embargo: int, source: str) -> str:
    """Running totals per key and day, looked up as of the embargoed day (not a range frame)."""
    keys, part = (f"{key} as k, ", f"partition by {key} ") if key else ("", "")
    group = f"{key}, submitted" if key else "submitted"
    return (
        f"select {keys}submitted as day, sum(sum({outcome})) over ({part}order by submitted) as s, "
        f"sum(count({outcome})) over ({part}order by submitted) as n from {source} "
        f"{f'where {key} is not null ' if key else ''}group by {group}"
    )


def prior_rate_ctes(source: str, outcome: str, embargo: int, entities: dict[str, str], select: str, book: str, names: tuple[str, str]) -> list[str]:
    ctes = [f"hist_book as ({_prior(None, outcome, embargo, source)})"]
    ctes += [f"hist_{n} as ({_prior(k, outcome, embargo, source)})" for n, k in entities.items()]
    joins = f"asof left join hist_book b on c.submitted - {embargo} >= b.day "
    cols = ["cast(b.s as double) / nullif(b.n, 0) as book_rate"]
    for n, k in entities.items():
        joins += f"asof left join hist_{n} h_{n} on h_{n}.k = c.{k} and c.submitted - {embargo} >= h_{n}.day "
        cols.append(f"coalesce(h_{n}.s, 0) as {n}_s, coalesce(h_{n}.n, 0) as {n}_n")
    ctes.append(f"looked as (select c.*, {', '.join(cols)} from {source} c {joins})")
    outs = ", ".join(
        f"(cast({n}_s as double) + 20 * book_rate) / ({n}_n + 20) as {names[0].format(n)}, cast({n}_n as bigint) as {names[1].format(n)}"
        for n in entities
    )
    return [*ctes, f"final as (select {select}, book_rate as {book}, {outs} from looked)"]


_CUT = "cuts as (select floor(quantile_cont(submitted - date '1970-01-01', 0.8)) as cut from claims)"
_INNER = (
    "inner_cut as (select floor(quantile_cont(submitted - date '1970-01-01', 0.8)) as c from claims, cuts "
    "where submitted - date '1970-01-01' <= cut)"
)
_STEP = (1.0 - 0.4) / 4
_QS = [0.4 + _STEP * i for i in range(4)]
_FOLDS = " union all ".join(
    f"select {i} as fold_no, floor(quantile_cont({_DAY}, {q!r})) as cut, "
    + (f"floor(quantile_cont({_DAY}, {_QS[i + 1]!r}))" if i < 3 else f"max({_DAY})")
    + " as upper from claims"
    for i, q in enumerate(_QS)
)

_EVENTS = """ev as (select user_id || '-' || strftime(ts, '%Y%m%d') as case_id, event_id, ts, event_type,
  cast(value as decimal(12,2)) as minutes from events)"""

_LOG = """
log0 as (
  select claim_sk, 'CODING_COMPLETE' as event_type, 1 as rank, service_date as event_date from claims
  union all select claim_sk, 'CLAIM_SUBMITTED', 2, submitted from claims
  union all select claim_sk, 'ADJUDICATED', 3, adjudicated from claims where adjudicated is not null
  union all select claim_sk, 'DENIAL_REVIEWED', 4, review_date from claims where review_date is not null
  union all select claim_sk, 'PAYMENT_POSTED', 5, payment_date from claims where payment_date is not null
  union all select claim_sk, 'APPEAL_RECOVERY_POSTED', 6, review_date from claims where overturned),
log1 as (select * from log0 union all select claim_sk, 'CLAIM_CLOSED', 9, max(event_date) + 3 from log0 group by claim_sk),
log as (select *, row_number() over (partition by claim_sk order by event_date, rank, event_type) as event_seq from log1)"""

_SURV = """
snap as (select greatest(max(payment_date), max(adjudicated)) as d from claims),
surv as (select * from (select payer, coalesce(payment_date, snap.d) - submitted as dur, (payment_date is not null)::int as event from claims, snap)
  where dur >= 0)"""


def _km(group: str) -> str:
    part = f"partition by {group} " if group else ""
    cols = f"{group}, " if group else ""
    return f"""per as (select {cols}dur as t, sum(event) as deaths, count(*) - sum(event) as censored from surv group by {cols}dur),
risk as (select *, sum(deaths + censored) over ({part}order by t desc) as at_risk from per),
curve as (select *, case when max((deaths = at_risk)::int) over ({part}order by t) = 1 then 0 else
  exp(sum(case when deaths < at_risk then ln(1 - cast(deaths as double) / at_risk) else 0 end) over ({part}order by t)) end as survival from risk)"""


_CHI_CTES = """
cells as (select a, b, count(*) as n from src where a is not null and b is not null group by a, b),
m as (select *, cast(sum(n) over (partition by a) as double) as ra, cast(sum(n) over (partition by b) as double) as rb,
  cast(sum(n) over () as double) as t from cells),
stat as (select {stat} as chi2, count(distinct a) as r, count(distinct b) as k, max(t) as n from m)"""

_CHI = """select round(chi2, 6) as chi2, (r - 1) * (k - 1) as dof, round(n, 6) as n,
  round(sqrt(greatest(0, chi2 / n - (k - 1) * (r - 1) / (n - 1)) / (least(k - (k - 1) * (k - 1) / (n - 1), r - (r - 1) * (r - 1) / (n - 1)) - 1)), 6) as cramers_v,
  round({p}, 6) as p_value
from stat"""

_PAYER_TERMS = [("sim_payer_id", "payer", ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))]
_LINE_TERMS = [("sim_service_line_id", "service_line", ("NEURO", "ORTHO", "RESPIRATORY", "UNKNOWN"))]
_FACTOR_TERMS = [(f"{n}={v}", f"({c} = '{v}')::int") for n, c, levels in (*_PAYER_TERMS, *_LINE_TERMS) for v in levels]
_CASE_TERMS = [
    ("intercept", "1"), ("sim_auth_missing", "auth_missing::int"), ("sim_eligibility_failed", "elig_failed::int"), ("doc_incomplete", "(not doc_complete)::int"), *_FACTOR_TERMS,
]
_LOGIT_TERMS = [
    ("intercept", "1"), ("sim_auth_missing", "auth_missing::int"), ("sim_coding_specificity_deficit", "deficit::int"),
    ("sim_documentation_complete", "doc_complete::int"), *_FACTOR_TERMS,
]


def _newton(terms: list[tuple[str, str]], steps: int = 12) -> list[str]:
    """Logistic regression of denied in SQL: Newton steps on covariate patterns, each solved by Gauss-Jordan elimination.

    nr has a row for each elimination step; fit is the last one, with the coefficients and the inverse information matrix.
    """
    p = len(terms)
    at = range(1, p + 1)
    ones = {i: ["1.0" if i == j else "0.0" for j in at] for i in at}
    matrix = ", ".join(
        "[" + ", ".join([*(f"sum(n * mu * (1 - mu) * x[{i}] * x[{j}])" for j in at), f"sum((y - n * mu) * x[{i}])", *ones[i]]) + "]" for i in at
    )
    x = ", ".join(f"cast({sql} as double)" for _, sql in terms)
    return [
        f"""pat as materialized (select [{x}] as x, cast(count(*) as double) as n, cast(sum(denied::int) as double) as y
  from claims where list_sum([{x}]) is not null and payer is not null and service_line is not null and elig_failed is not null group by 1)""",
        f"""nr as (select 0 as it, 0 as i, list_transform(range(0, {p}), lambda z: 0.0::double) as b, cast(null as double[][]) as m
union all
select case when i = {p + 1} then it + 1 else it end, case when i = {p + 1} then 0 else i + 1 end,
  case when i = {p + 1} then list_transform(range(1, {p + 1}), lambda j: b[j] + m[j][{p + 1}]) else b end,
  case when i = 0 then a when i <= {p} then list_transform(range(1, {p + 1}), lambda j: case when j = i
    then list_transform(m[i], lambda v: v / m[i][i]) else list_transform(range(1, {2 * p + 2}), lambda t: m[j][t] - m[j][i] * m[i][t] / m[i][i]) end) else m end
from (select any_value(it) as it, any_value(i) as i, any_value(b) as b, any_value(m) as m, [{matrix}] as a
  from (select nr.*, pat.*, 1 / (1 + exp(-list_dot_product(x, b))) as mu from nr, pat where it < {steps}))
where it is not null)""",
        f"fit as materialized (select b, m from nr where it = {steps - 1} and i = {p + 1})",
    ]


def _recursive(sql: str) -> str:
    return "with recursive" + sql[4:]


def _term_rows(terms: list[tuple[str, str]]) -> str:
    names = ", ".join(f"'{t}'" for t, _ in terms)
    return f"terms as (select unnest([{names}]) as term, unnest(range(1, {len(terms) + 1})) as k)"


#: Two-sided normal tail: erf by its series of positive terms.
_NORMAL_P = (
    "case when abs(z) > 9 then 0 else greatest(0, 1 - 2 / sqrt(pi()) * exp(-z * z / 2) * list_sum(list_transform(range(0, 300), "
    "lambda i: case when z = 0 then 0 else exp(i * ln(2) + (2 * i + 1) * ln(abs(z) / sqrt(2)) - (lgamma(2 * i + 2) - i * ln(2) - lgamma(i + 1))) end))) end"
)


def chi2_p(statistic: str, dof: str) -> str:
    """Upper tail of chi-square: the lower incomplete gamma function by its series of positive terms."""
    a, x = f"({dof} / 2.0::double)", f"({statistic} / 2.0::double)"
    return (
        f"case when {dof} < 1 then null when {statistic} <= 0 then 1 else greatest(0, 1 - list_sum(list_transform(range(0, 4000), "
        f"lambda i: exp(({a} + i) * ln({x}) - {x} - lgamma({a} + i + 1))))) end"
    )


def _segmented_trend(lags: int = 3) -> str:
    """Segmented least squares with Newey-West errors: normal equations by elimination, then the weighted lagged score products."""
    at = range(1, 5)
    matrix = ", ".join("[" + ", ".join([*(f"sum(x[{i}] * x[{j}])" for j in at), f"sum(x[{i}] * y)", *("1.0" if i == j else "0.0" for j in at)]) + "]" for i in at)
    products = ", ".join(f"sum(u[{i}] * {'u' if lag == 0 else f'l{lag}'}[{j}]) as g{lag}_{i}_{j}" for lag in range(lags + 1) for i in at for j in at)
    meat = {
        (i, j): " + ".join([f"g0_{i}_{j}", *(f"{1 - lag / (lags + 1)!r} * (coalesce(g{lag}_{i}_{j}, 0) + coalesce(g{lag}_{j}_{i}, 0))" for lag in range(1, lags + 1))]) for i in at for j in at
    }
    variance = " + ".join(f"m[k][{5 + i}] * ({meat[i, j]}) * m[k][{5 + j}]" for i in at for j in at)
    return f"""with recursive monthly as ({VIEW_SQL['exec_monthly']}),
numbered as (select cast(sim_denial_rate as double) as y, cast(row_number() over (order by sim_submission_year_month) - 1 as double) as t, count(*) over () // 2 as cut from monthly),
frame as materialized (select t, y, [1.0, t, case when t >= cut then 1.0 else 0.0 end, case when t >= cut then t - cut else 0.0 end]::double[] as x from numbered),
gj as (select 0 as i, [{matrix}]::double[][] as m from frame
union all
select i + 1, list_transform(range(1, 5), lambda j: case when j = i + 1 then list_transform(m[i + 1], lambda v: v / m[i + 1][i + 1])
  else list_transform(range(1, 10), lambda c: m[j][c] - m[j][i + 1] * m[i + 1][c] / m[i + 1][i + 1]) end) from gj where i < 4),
fit as materialized (select m from gj where i = 4),
scores as (select t, list_transform(x, lambda v: v * (y - list_dot_product(x, [m[1][5], m[2][5], m[3][5], m[4][5]]))) as u from frame, fit),
lagged as (select u, {', '.join(f'lag(u, {lag}) over (order by t) as l{lag}' for lag in range(1, lags + 1))} from scores),
sums as (select {products} from lagged),
terms as (select unnest(['intercept', 'time', 'level', 'time_since']) as term, unnest(range(1, 5)) as k),
found as (select term, m[k][5] as coef, sqrt({variance}) as se from terms, fit, sums)
select term, round(coef, 6) as coef, round(se, 6) as se, round(z, 6) as z, round({_NORMAL_P}, 6) as p_value from (select *, coef / se as z from found)"""


_KRUSKAL_H = "((12.0::double / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)))"

SQL = {
    "prior_rates": with_claims(
        "select * from final",
        "rows as (select *, denied::int as y from claims)",
        *prior_rate_ctes(
            "rows", "y", 60, {"payer": "payer", "provider": "prvdr_num", "line": "service_line"},
            "claim_sk, submitted as sim_submission_date, y as denied", "book_prior_rate",
            ("{}_prior_rate", "{}_prior_count"),
        ),
    ),
    "triage_rates": with_claims(
        "select * from final",
        "rows as (select *, overturned::int as y from claims where denied)",
        *prior_rate_ctes(
            "rows", "y", 180, {"sim_payer": "payer", "sim_category": "category"},
            "claim_sk, overturned is not null as appealed, review_date - adjudicated as sim_denial_review_lag_days",
            "sim_overall_prior_overturn_rate", ("{}_prior_overturn_rate", "{}_prior_appeals"),
        ),
    ),
    "asof_balance": with_claims(
        f"""select c.claim_sk, c.provider_key, {_DAY} as asked_day, h.shipped, h.quantity
from claims c asof left join h on h.k = c.provider_key and c.submitted - 30 >= h.day""",
        """h as (select l_suppkey as k, cast(l_shipdate as date) as day, count(*) as shipped, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity
  from lineitem group by 1, 2)""",
    ),
    "pit_invariance": with_claims(
        "select count(*) as past_rows, 0 as changed_rows from claims where submitted < date '1999-01-01'"
    ),
    "temporal_split": with_claims(
        """select fold, count(*) as fold_rows, min(submitted) as first_date, max(submitted) as last_date, avg(denied::int) as base_rate,
  cast(count(*) as double) / sum(count(*)) over () as fold_share
from (select *, case when submitted - date '1970-01-01' <= c then 'fit' when submitted - date '1970-01-01' <= cut then 'calibrate' else 'test' end as fold
  from claims, cuts, inner_cut) group by fold""",
        _CUT,
        _INNER,
    ),
    "forward_folds": with_claims(
        f"""select fold_no, date '1970-01-01' + cut::int as cut_date, case when {_DAY} <= cut then 'train' else 'validate' end as role,
  count(*) as fold_rows, min(submitted) as first_date, max(submitted) as last_date
from claims, folds where {_DAY} <= upper group by 1, 2, 3""",
        f"folds as ({_FOLDS})",
    ),
    "trespass": with_claims(
        """select count(*) filter (where submitted > t) as trespassers, count(*) as train_rows,
  cast(count(*) filter (where submitted > t) as double) / count(*) as share
from claims, (select min(submitted) as t from claims where claim_sk % 5 = 0) where claim_sk % 5 <> 0"""
    ),
    "pit_events": f"""with {_EVENTS}, b as (select case_id, min(ts) as until from ev where event_type = 'purchase' group by 1)
select case_id, cast(sum(minutes) as double) as touch_minutes, (epoch_us(max(until)) - epoch_us(min(ts))) / 3600000000.0::double as elapsed_hours
from ev join b using (case_id) where ts <= until group by 1""",
    "event_log_build": with_claims(
        """select claim_sk, event_type, event_date, event_seq,
  cast(cast(event_date as timestamp) + to_minutes(420 + (event_seq - 1) * 45) as varchar) as event_ts from log""",
        _LOG.strip(),
    ),
    "event_order": f"""with {_EVENTS}, n as (select *, row_number() over (partition by case_id order by event_id) as seq,
  lag(ts) over (partition by case_id order by event_id) as prev from ev)
select count(*) as events, count(distinct case_id) as cases, count(*) filter (where ts <= prev) as not_increasing, 0 as gap_cases from n""",
    "variants": f"""with {_EVENTS}, p as (select case_id, string_agg(event_type, ' -> ' order by ts, event_id) as path from ev group by 1)
select path, count(*) as claims, cast(count(*) as double) / sum(count(*)) over () as share from p group by 1""",
    "rework": f"""with {_EVENTS}, c as (select case_id, bool_or(event_type in ('error', 'purchase')) as r, bool_or(event_type = 'error') as e,
  bool_or(event_type = 'purchase') as p from ev group by 1), t as (select count(*) as n, count(*) filter (where r) as r, count(*) filter (where e) as e, count(*) filter (where p) as p from c)
select n as cases_total, 'rework' as stage, r as cases, cast(r as double) / n as share from t
union all select n, 'error', e, cast(e as double) / n from t union all select n, 'purchase', p, cast(p as double) / n from t""",
    "bottleneck": f"""with {_EVENTS} select event_type, round(cast(sum(minutes) as double), 6) as total_minutes,
  {rate('cast(sum(minutes) * 100 as hugeint)', 'count(*) * 100', 6)} as mean_minutes, count(*) as events from ev group by 1 having sum(minutes) > 0""",
    "automation": """select count(*) filter (where event_type = 'view') as automated, count(*) filter (where event_type <> 'view') as manual from events""",
    "activity_shares": f"select event_type, count(*) as events, {rate('count(*)', '(select count(*) from events)', 6)} as share from events group by 1",
    "cost_pivot": f"""with {_EVENTS}, p as (select case_id, {', '.join(
        f"cast(coalesce(sum(minutes) filter (where event_type = '{a}'), 0) * 100 as bigint) as {a}_c, count(*) filter (where event_type = '{a}') as {a}_events"
        for a in ('click', 'error', 'purchase', 'signup', 'view'))} from ev group by 1),
c as (select *, (error_c * 36 + 30) // 60 as ec, (signup_c * 24 + 30) // 60 as sc, purchase_events * 125 as pc from p)
select case_id, {', '.join(f"cast({a}_c as double) / 100 as {a}_minutes, {a}_events" for a in ('click', 'error', 'purchase', 'signup', 'view'))},
  cast(ec as double) / 100 as error_cost, cast(sc as double) / 100 as signup_cost, cast(pc as double) / 100 as purchase_fee,
  cast(ec + sc + pc as double) / 100 as total_cost from c""",
    "km": with_claims(
        """select t, cast(at_risk as bigint) as at_risk, cast(deaths as bigint) as deaths, cast(censored as bigint) as censored,
  round(survival, 9) as survival from curve""",
        _SURV.strip(),
        _km(""),
    ),
    "km_by_payer": with_claims(
        "select payer as sim_payer_id, "
        + ", ".join(f"round(1 - coalesce(min(survival) filter (where t <= {h}), 1), 9) as p{h}" for h in (30, 60, 90, 120))
        + ", round(1 - min(survival), 9) as plateau from curve group by 1",
        _SURV.strip(),
        _km("payer"),
    ),
    "chi2": with_claims(
        _CHI.format(p=chi2_p("chi2", "((r - 1) * (k - 1))")),
        "src as (select payer as a, denied as b from claims)",
        _CHI_CTES.strip().format(stat="sum(power(n - ra * rb / t, 2) / (ra * rb / t))"),
    ),
    "chi2_two_by_two": with_claims(
        _CHI.format(p=chi2_p("chi2", "((r - 1) * (k - 1))")),
        "src as (select auth_missing as a, denied as b from claims)",
        _CHI_CTES.strip().format(
            stat="sum(power(greatest(abs(n - ra * rb / t) - 0.5, 0), 2) / (ra * rb / t))"
        ),
    ),
    "crosstab": with_claims("select payer as sim_payer_id, denial_type as sim_denial_type, count(*) as n from claims group by 1, 2"),
    "kruskal": with_claims(
        f"""select round({_KRUSKAL_H}, 6) as h, dof, round(n, 6) as n,
  round({chi2_p(_KRUSKAL_H, "dof")}, 6) as p_value
from (select sum(rs * rs / sz) as q, cast(sum(sz) as double) as n, count(*) - 1 as dof from g),
  (select sum(c * c * c - c) as t from (select cast(count(*) as double) as c from paid group by days_pay))""",
        "paid as (select payer, days_pay from claims where days_pay is not null)",
        """r as (select payer, rank() over (order by days_pay) + (count(*) over (partition by days_pay) - 1) / 2.0::double as mr from paid)""",
        "g as (select payer, sum(mr) as rs, count(*) as sz from r group by payer)",
    ),
    "payment_days": with_claims(
        """select payer as sim_payer_id, quantile_cont(days_pay, 0.5) as median, cast(sum(days_pay) as double) / count(days_pay) as mean,
  count(days_pay) as n from claims where days_pay is not null group by 1"""
    ),
    "describe_denied": with_claims(
        """select count(*) as n, round(avg(x), 4) as mean, round(stddev_samp(x), 4) as sd, round(min(x), 4) as min, round(max(x), 4) as max,
  round(quantile_cont(x, 0.25), 4) as q25, round(quantile_cont(x, 0.5), 4) as q50, round(quantile_cont(x, 0.75), 4) as q75
from (select cast(denied_u as double) / 10000 as x from claims where denied)"""
    ),
    "oe_funnel": _recursive(with_claims(
        """select prvdr_num, claims, observed, round(expected, 6) as expected, round(observed / expected, 6) as oe_ratio,
  round(p, 6) as poisson_tail_p, p < 0.05 as flagged, case when p >= 0.05 then 'within' when observed >= expected then 'high' else 'low' end as side
from (select *, case when observed >= expected
    then (select sum(exp(-expected + k * ln(expected) - lgamma(k + 1))) from (select unnest(generate_series(observed, observed + 400)) as k))
    else (select sum(exp(-expected + k * ln(expected) - lgamma(k + 1))) from (select unnest(generate_series(0, observed)) as k)) end as p from s)""",
        *_newton(_CASE_TERMS),
        f"""s as (select prvdr_num, count(*) as claims, count(*) filter (where denied) as observed,
  sum(1 / (1 + exp(-list_dot_product([{', '.join(f'cast({sql} as double)' for _, sql in _CASE_TERMS)}], b)))) as expected
  from claims, fit where payer is not null and elig_failed is not null group by 1 having count(*) >= 30)""",
    )),
    "case_mix_model": _recursive(with_claims(
        """select term, round(b[k], 6) as coef, round(sqrt(m[k][%d + k]), 6) as se, round(1 - ll / ll0, 6) as pseudo_r2,
  (select round(sum(y * x[k]), 6) from pat) as observed, (select round(sum(n * x[k] / (1 + exp(-list_dot_product(x, b)))), 6) from pat) as expected
from terms, fit, (select sum(y * list_dot_product(x, b) - n * ln(1 + exp(list_dot_product(x, b)))) as ll,
  sum(y) * ln(sum(y) / sum(n)) + (sum(n) - sum(y)) * ln(1 - sum(y) / sum(n)) as ll0 from pat, fit)""" % (len(_CASE_TERMS) + 1),
        *_newton(_CASE_TERMS),
        _term_rows(_CASE_TERMS),
    )),
    "logit_or": _recursive(with_claims(
        f"""select term, round(coef, 5) as coef, round(exp(coef), 5) as odds_ratio, round(se, 5) as se, round(z, 5) as z, round({_NORMAL_P}, 5) as p_value,
  round(exp(coef - 1.959963984540054 * se), 5) as ci_low, round(exp(coef + 1.959963984540054 * se), 5) as ci_high, round(1 - ll / ll0, 5) as pseudo_r2
from (select term, b[k] as coef, sqrt(m[k][{len(_LOGIT_TERMS) + 1} + k]) as se, b[k] / sqrt(m[k][{len(_LOGIT_TERMS) + 1} + k]) as z, ll, ll0
  from terms, fit, (select sum(y * list_dot_product(x, b) - n * ln(1 + exp(list_dot_product(x, b)))) as ll,
    sum(y) * ln(sum(y) / sum(n)) + (sum(n) - sum(y)) * ln(1 - sum(y) / sum(n)) as ll0 from pat, fit))""",
        *_newton(_LOGIT_TERMS),
        _term_rows(_LOGIT_TERMS),
    )),
    "segmented_trend": _segmented_trend(),
    "concordance": with_claims(
        """select risk_score, cast(comparable as double) as comparable, cast(concordant as double) as concordant, cast(tied as double) as tied,
  round((concordant + tied / 2.0::double) / comparable, 9) as concordance
from (select a.risk_score, count(*) as comparable, count(*) filter (where a.s > b.s) as concordant, count(*) filter (where a.s = b.s) as tied
  from scores a join scores b on a.risk_score = b.risk_score and a.event = 1 and (a.dur < b.dur or (a.dur = b.dur and b.event = 0)) group by 1)""",
        _SURV.strip().replace("select payer, coalesce", "select payer, auth_missing, doc_complete, line_count, billed_u, coalesce"),
        """scores as (select 'flags' as risk_score, dur, event, 2 * auth_missing::int + (not doc_complete)::int as s from surv
  union all select 'lines', dur, event, -line_count from surv union all select 'billed', dur, event, -billed_u from surv)""",
    ),
}
