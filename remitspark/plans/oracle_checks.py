"""Reference SQL of the check families: every check a query of its own."""

from __future__ import annotations

from .oracle_base import with_claims
from .oracle_data import SQL as DATA_SQL
from .oracle_time import _LOG
from .roles import SERVICE_LINES


def _fk(child: str, key: str, parent: str, parent_key: str) -> str:
    return f"select count(*) from {child} c where not exists (select 1 from {parent} p where p.{parent_key} = c.{key})"


def _unique(table: str, *keys: str) -> str:
    return f"select count(*) - count(distinct ({', '.join(keys)})) from {table} where {' is not null and '.join(keys)} is not null"


def _rows(table: str, condition: str) -> str:
    return f"select count(*) from {table} where {condition}"


_DAYS = "(select cast(o_orderdate as date) as day from orders union select cast(l_shipdate as date) from lineitem)"
_WAREHOUSE = {
    "nonneg:orders.o_totalprice": _rows("orders", "o_totalprice < 0"), "present:orders.o_orderpriority": _rows("orders", "o_orderpriority is null"),
    "nonneg:lineitem.l_extendedprice": _rows("lineitem", "l_extendedprice < 0"), "nonneg:lineitem.l_quantity": _rows("lineitem", "l_quantity < 0"),
    "unit interval:lineitem.l_discount": _rows("lineitem", "l_discount < 0 or l_discount > 1"),
    "known:lineitem.l_returnflag": _rows("lineitem", "l_returnflag is null or l_returnflag not in ('A', 'N', 'R')"),
    "nonneg:customer.c_acctbal": _rows("customer", "c_acctbal < 0"), "nonneg:supplier.s_acctbal": _rows("supplier", "s_acctbal < 0"),
    "nonneg:part.p_retailprice": _rows("part", "p_retailprice < 0"), "crosswalk:assigned": _rows("crossed", "assigned is null"),
    "fk:orders.o_custkey": _fk("orders", "o_custkey", "customer", "c_custkey"), "fk:lineitem.l_orderkey": _fk("lineitem", "l_orderkey", "orders", "o_orderkey"),
    "fk:lineitem.l_suppkey": _fk("lineitem", "l_suppkey", "supplier", "s_suppkey"), "fk:lineitem.l_partkey": _fk("lineitem", "l_partkey", "part", "p_partkey"),
    "fk:orders.o_orderdate": f"select count(*) from orders where cast(o_orderdate as date) not in {_DAYS}",
    "fk:lineitem.l_shipdate": f"select count(*) from lineitem where cast(l_shipdate as date) not in {_DAYS}",
    "fk:customer.c_nationkey": _fk("customer", "c_nationkey", "nation", "n_nationkey"), "fk:supplier.s_nationkey": _fk("supplier", "s_nationkey", "nation", "n_nationkey"),
    "fk:nation.n_regionkey": _fk("nation", "n_regionkey", "region", "r_regionkey"),
    "fk:crosswalk.s_suppkey": _fk("crossed", "s_suppkey", "supplier", "s_suppkey"), "fk:crosswalk.c_custkey": _fk("crossed", "assigned", "customer", "c_custkey"),
    "coverage:every order has lines": _fk("orders", "o_orderkey", "lineitem", "l_orderkey"), "coverage:every supplier has a crosswalk row": _fk("supplier", "s_suppkey", "crossed", "s_suppkey"),
    "unique:customer.c_custkey": _unique("customer", "c_custkey"), "unique:customer.c_name": _unique("customer", "c_name"),
    "unique:supplier.s_suppkey": _unique("supplier", "s_suppkey"), "unique:supplier.s_name": _unique("supplier", "s_name"),
    "unique:orders.o_orderkey": _unique("orders", "o_orderkey"), "unique:lineitem.grain": _unique("lineitem", "l_orderkey", "l_linenumber"),
    "unique:part.p_partkey": _unique("part", "p_partkey"), "unique:crosswalk.s_suppkey": _unique("crossed", "s_suppkey"),
    "date order:ordered<=first shipped": "select count(*) from (select l_orderkey, min(cast(l_shipdate as date)) as first from lineitem group by 1) join orders on o_orderkey = l_orderkey where cast(o_orderdate as date) > first",
    "unknown member:dim_date": f"select count(*) from {_DAYS} where year(day) * 10000 + month(day) * 100 + day(day) = 0",
    **{f"unknown member:dim_{n}": f"select abs(1 - count(*)) from (select 0 as k union all select row_number() over (order by v) from (select distinct {c} as v from {t} where trim({c}) <> '')) where k = 0"
       for n, t, c in (("bene", "customer", "c_name"), ("provider", "supplier", "s_name"), ("drg", "part", "p_name"))},
    **{f"provenance:dim_{n}": "select 0" for n in ("bene", "provider", "drg")},
}
_LINES = ", ".join(f"'{n}'" for n, _, _ in SERVICE_LINES)
_PER_CLAIM = "(select claim_sk, count(*) as n, sum(recovered) as r from appeal group by 1) a join claims c using (claim_sk)"
_OUTCOME = {
    "money:paid<=allowed": _rows("claims", "paid_u > allowed_u"), "money:allowed<=billed": _rows("claims", "allowed_u > billed_u"),
    "money:no negative amounts": _rows("claims", "allowed_u < 0 or paid_u < 0 or denied_u < 0 or billed_u < 0"),
    "money:paid+denied<=allowed": _rows("claims", "paid_u + denied_u > allowed_u"), "money:recovered<=allowed": _rows("claims", "recovered_u > allowed_u"),
    "time:coded<=submitted<=adjudicated": _rows("claims", "least(service_date, submitted) > submitted or submitted > adjudicated"),
    "time:paid after adjudication": _rows("claims", "payment_date < adjudicated"), "time:paid after submission": _rows("claims", "payment_date < submitted"),
    "outcome:category iff denied": _rows("claims", "denied <> (category is not null)"), "outcome:type matches flag": _rows("claims", "denied <> (denial_type <> 'NONE')"),
    "outcome:review date iff denied": _rows("claims", "denied <> (review_date is not null)"), "outcome:mechanism iff denied": _rows("claims", "denied <> (driver is not null)"),
    "outcome:appeal levels only when denied": _rows("claims", "appeal_levels is not null and not denied"),
    "auth:not obtained and missing": _rows("claims", "auth_missing and auth_required and not auth_missing"),
    "auth:no state when not required": _rows("claims", "not auth_required and auth_missing"),
    "cost:total is the sum of its parts": _rows("claims", "total_cost <> base_cost + rework_cost + appeal_cost"),
    "known:service line": _rows("claims", f"service_line not in ({_LINES}, 'UNKNOWN')"),
    "money:no recovery when upheld": _rows("appeal", "not is_final and recovered > 0"), "time:no event without a date": _rows("log", "event_date is null"),
    "fk:claims.claim_sk": _fk("claims", "claim_sk", "orders", "o_orderkey"), "fk:claims.payer": _fk("claims", "payer", "customer", "c_mktsegment"),
    "fk:appeals.claim_sk": _fk("appeal", "claim_sk", "claims", "claim_sk"), "fk:events.claim_sk": _fk("log", "claim_sk", "claims", "claim_sk"),
    "unique:claims.claim_sk": _unique("claims", "claim_sk"), "unique:appeals.grain": _unique("appeal", "claim_sk", "line_num"), "unique:events.grain": _unique("log", "claim_sk", "event_seq"),
    "coverage:every order has an outcome": _fk("orders", "o_orderkey", "claims", "claim_sk"), "coverage:every claim has events": _fk("claims", "claim_sk", "log", "claim_sk"),
    "coverage:every payer has claims": "select count(*) from (select distinct c_mktsegment as s from customer) where s not in (select payer from claims where payer is not null)",
    "money:billed equals the lines": "select count(*) from claims join (select claim_sk, sum(billed_u) as b from line group by 1) using (claim_sk) where b <> billed_u",
    "grain:line count equals the lines": "select count(*) from claims join (select claim_sk, count(*) as b from line group by 1) using (claim_sk) where b <> line_count",
    "money:recovered equals the appeals": f"select count(*) from {_PER_CLAIM} where r <> recovered_u", "outcome:appeals only on denied claims": "select count(*) from appeal join claims using (claim_sk) where not denied",
    "outcome:appeal levels equal the appeals": f"select count(*) from {_PER_CLAIM} where n <> appeal_levels",
    "cost:appeal cost follows the appeals": "select count(*) from claims c left join (select claim_sk, count(*) as n from appeal group by 1) using (claim_sk) where appeal_cost <> 118 * coalesce(n, 0)",
    "time:events begin at 1": "select count(*) from (select min(event_seq) as lo from log group by claim_sk) where lo <> 1",
    "time:events are numbered without gaps": "select count(*) from (select max(event_seq) as hi, count(*) as n from log group by claim_sk) where hi <> n",
    "time:event times increase": "select count(*) from (select event_date, lag(event_date) over (partition by claim_sk order by event_seq) as prev from log) where event_date < prev",
    "outcome:payments have an event": "select count(*) from claims c left join (select claim_sk, count(*) as n from log where event_type = 'PAYMENT_POSTED' group by 1) using (claim_sk) where (payment_date is not null)::int <> coalesce(n, 0)",
}


def _report(checks: dict[str, str]) -> str:
    rows = " union all ".join(f"select '{name}' as check_name, ({sql}) as violations" for name, sql in checks.items())
    return f"select check_name, cast(violations as bigint) as violations, violations = 0 as passed from ({rows})"


SQL = {
    "warehouse_checks": f"with crossed as materialized ({DATA_SQL['hash_crosswalk']}) {_report(_WAREHOUSE)}",
    "outcome_layer_checks": with_claims(
        _report(_OUTCOME),
        _LOG.strip(),
        """appeal as (select l.claim_sk, line_num, is_final, case when is_final then l.allowed_u else 0 end as recovered
  from line l join claims c on c.claim_sk = l.claim_sk where is_appeal and denied)""",
    ),
}
