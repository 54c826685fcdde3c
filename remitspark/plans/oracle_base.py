"""Shared pieces of the reference SQL: derived claims, exact rounding, result shaping."""

from __future__ import annotations

from .roles import (
    APPEAL_COST_PER_LINE,
    BASE_COST_PER_LINE,
    DEFAULT_FILING_DAYS,
    PAYERS,
    REWORK_COST_PER_LINE,
    SERVICE_LINES,
)

_PAYER_ROWS = ", ".join(f"('{i}', '{n}', {s}, {d})" for i, n, s, d in PAYERS)
_LINE_CASE = " ".join(f"when p_size between {lo} and {hi} then '{name}'" for name, lo, hi in SERVICE_LINES)

CLAIMS = f"""
line as (
  select l_orderkey as claim_sk, l_linenumber as line_num, l_partkey as part_key, l_suppkey as provider_key,
    cast(l_quantity as bigint) as quantity,
    cast(round(l_extendedprice * 100) as bigint) * 100 as billed_u,
    cast(round(l_extendedprice * 100) as bigint) * (100 - cast(round(l_discount * 100) as bigint)) as allowed_u,
    cast(round(l_discount * 100) as bigint) as discount_pct, cast(round(l_tax * 100) as bigint) as tax_pct,
    cast(l_shipdate as date) as ship_date, l_returnflag = 'R' as is_denied, l_returnflag = 'A' as is_appeal,
    l_linestatus = 'F' as is_final
  from lineitem),
summary as (
  select claim_sk, count(*) as line_count, count(*) filter (where is_denied) as denied_lines,
    count(*) filter (where is_appeal) as appeal_lines,
    count(*) filter (where is_appeal and is_final) as overturned_lines,
    min(provider_key) as provider_key, min(part_key) as part_key,
    cast(sum(billed_u) as bigint) as billed_u, cast(sum(allowed_u) as bigint) as allowed_u,
    cast(coalesce(sum(allowed_u) filter (where is_denied), 0) as bigint) as denied_u,
    cast(coalesce(sum(allowed_u) filter (where not is_denied and is_final), 0) as bigint) as paid_u,
    cast(coalesce(sum(allowed_u) filter (where is_appeal and is_final), 0) as bigint) as recovered_u,
    min(ship_date) as first_ship, max(ship_date) as last_ship,
    max(ship_date) filter (where is_final) as payment_date,
    max(ship_date) filter (where is_denied) as last_denied_ship,
    count(distinct line_num) as distinct_lines, max(quantity) as max_quantity, min(quantity) as min_quantity,
    cast(sum(quantity) as bigint) as sum_quantity, min(tax_pct) as min_tax, max(tax_pct) as max_tax,
    min(discount_pct) as min_discount, cast(sum(discount_pct) as bigint) as sum_discount
  from line group by claim_sk),
payer_dim(sim_payer_id, sim_payer_name, sim_payer_mix_share, sim_timely_filing_days) as (values {_PAYER_ROWS}),
wide as (
  select s.*, o.o_custkey as bene_key, cast(o.o_orderdate as date) as submitted, o.o_orderpriority as priority,
    c.c_mktsegment as payer, c.c_acctbal < 0 as elig_failed, pd.sim_payer_name, pd.sim_payer_mix_share,
    pd.sim_timely_filing_days, coalesce(pd.sim_timely_filing_days, {DEFAULT_FILING_DAYS}) as limit_days,
    n.n_name as provider_state_cd, su.s_name as facility, p_size, p_type, p_brand,
    2 * s.denied_lines > s.line_count as denied
  from summary s join orders o on o.o_orderkey = s.claim_sk
    left join customer c on c.c_custkey = o.o_custkey
    left join payer_dim pd on pd.sim_payer_id = c.c_mktsegment
    left join supplier su on su.s_suppkey = s.provider_key
    left join nation n on n.n_nationkey = su.s_nationkey
    left join part p on p.p_partkey = s.part_key),
claims0 as (
  select claim_sk, 'CLM' || lpad(cast(claim_sk as varchar), 10, '0') as clm_id, bene_key, provider_key, part_key,
    'P' || lpad(cast(provider_key as varchar), 6, '0') as prvdr_num, provider_state_cd, facility,
    line_count, denied_lines, last_ship - first_ship + 1 as stay_days, submitted, strftime(submitted, '%Y-%m') as ym, last_ship as service_date,
    case when last_ship <= submitted then submitted - last_ship else 0 end as service_days, limit_days,
    case when first_ship >= submitted then first_ship end as adjudicated,
    case when first_ship >= submitted then first_ship - submitted end as days_adj,
    payment_date, case when payment_date >= submitted then payment_date - submitted end as days_pay,
    case when denied then last_denied_ship end as review_date,
    billed_u, allowed_u, paid_u, denied_u, denied,
    case when not denied then 'NONE' when denied_lines = line_count then 'FULL' else 'PARTIAL' end as denial_type,
    case when denied then priority end as category, case when denied then substr(priority, 1, 1) end as carc,
    payer, sim_payer_name as payer_name, sim_payer_mix_share as mix_share, sim_timely_filing_days as filing_days,
    elig_failed,
    max_quantity >= 40 as auth_required, (max_quantity >= 40 and min_tax = 0) as auth_missing,
    (max_quantity >= 40 and min_tax <> 0 and max_tax >= 8) as auth_late,
    min_discount > 0 as doc_complete, min_quantity <= 5 as deficit, distinct_lines < line_count as dup,
    sum_discount, sum_quantity, p_size, p_type, p_brand,
    case {_LINE_CASE} else 'UNKNOWN' end as service_line,
    case when denied then denied_lines * {REWORK_COST_PER_LINE} else 0 end as rework_cost,
    case when denied and appeal_lines > 0 then appeal_lines * {APPEAL_COST_PER_LINE} else 0 end as appeal_cost,
    line_count * {BASE_COST_PER_LINE} as base_cost,
    case when denied and appeal_lines > 0 then appeal_lines end as appeal_levels,
    case when denied and appeal_lines > 0 then overturned_lines > 0 end as overturned,
    case when denied and appeal_lines > 0 then recovered_u end as recovered_u
  from wide),
claims as (
  select *, base_cost + rework_cost + appeal_cost as total_cost, service_days > limit_days as late,
    (not denied and not service_days > limit_days and not coalesce(elig_failed, false) and not dup) as clean,
    (payment_date is not null and not denied) as first_pass, payment_date is null as ar_open,
    greatest(allowed_u - paid_u, 0) as balance_u,
    case when denied then case
      when greatest(4 * auth_missing::int + 2 * auth_late::int, 2 * deficit::int, 3 - 3 * doc_complete::int, 3 * dup::int) <= 0
        then 'baseline'
      when 4 * auth_missing::int + 2 * auth_late::int >= greatest(2 * deficit::int, 3 - 3 * doc_complete::int, 3 * dup::int)
        then 'authorization'
      when 2 * deficit::int >= greatest(3 - 3 * doc_complete::int, 3 * dup::int) then 'coding'
      when not doc_complete then 'documentation' else 'duplicate' end end as driver
  from claims0)
"""

#: The last day of the earlier fold: the day below which four fifths of the claims were submitted.
CUT = "(select date '1970-01-01' + cast(floor(quantile_cont(submitted - date '1970-01-01', 0.8)) as integer) from claims)"

AS_OF = "as_of as (select greatest(max(adjudicated), max(payment_date), max(review_date)) as d from claims)"


def with_claims(body: str, *ctes: str) -> str:
    return "with " + ",\n".join([CLAIMS.strip(), *ctes]) + "\n" + body


def rate(numerator: str, denominator: str, digits: int = 4) -> str:
    """numerator/denominator (non-negative integers) rounded half up without touching doubles."""
    scale = 10**digits
    return (
        f"cast((2 * {scale} * cast({numerator} as hugeint) + ({denominator})) "
        f"// nullif(2 * cast({denominator} as hugeint), 0) as double) / {scale}"
    )


def share_where(condition: str, digits: int = 4) -> str:
    return rate(f"count(*) filter (where {condition})", "count(*)", digits)


def among(condition: str, base: str, digits: int = 4) -> str:
    return rate(f"count(*) filter (where ({condition}) and ({base}))", f"count(*) filter (where {base})", digits)


def mean(column: str, digits: int = 1) -> str:
    return rate(f"sum({column})", f"count({column})", digits)


def dollars(units: str) -> str:
    """Units of 0.0001 as dollars rounded to cents."""
    return f"cast((cast({units} as hugeint) + 50) // 100 as double) / 100"


def dollars4(units: str) -> str:
    return f"cast({units} as double) / 10000"


def units_ratio(numerator: str, denominator: str, digits: int = 4) -> str:
    return rate(numerator, denominator, digits)
