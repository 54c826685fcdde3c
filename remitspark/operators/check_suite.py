"""A check compiler: declared row, key and cross-table checks of many sources, compiled to one scan of each source and one aggregation.

Each row of a source is turned into one entry for every key role that it plays (``domain``, key) and one for every rule of its own that
it violates; the entries of all sources are counted by key, once. A foreign key, a repeated key, missing coverage and an identity between
two tables are all conditions on one key's counts and sums, so no check joins anything. Counting combines before the shuffle, so
a key that a third of the rows has is one entry for each task.

Where all tables of a domain are laid together by its key beforehand, the joined rows can be a source themselves (``merged``): the domain's
key checks are then made on each row, and only what violates them becomes an entry.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.inline import literal

_ROW = "#row"


@dataclass(frozen=True)
class KeyRole:
    """A key that the rows of a source have: SQL text of the key in a domain, and sums to compare across tables.

    ``rows``: SQL text of the number of rows that one row stands for; of none, it has no key.

    ``measures``: name -> (aggregate, SQL text); they appear in checks as ``<role>_<name>``, the number of rows as ``n_<role>``.
    """

    role: str
    domain: str
    key: str
    measures: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    rows: str = "1L"


@dataclass(frozen=True)
class Source:
    """``merged``: a domain with one row here for each of its keys, which has the columns ``key``, ``n_<role>`` and ``<role>_<measure>``."""

    frame: DataFrame
    rules: Mapping[str, str] = field(default_factory=dict)  # check name -> SQL text that holds for a violating row
    roles: Sequence[KeyRole] = ()
    counts: Mapping[str, str] = field(default_factory=dict)  # check name -> SQL text of the violations that a row stands for
    merged: str | None = None


@dataclass(frozen=True)
class KeyCheck:
    """``per_key``: SQL text of the violations that one key of the domain makes, from the roles' counts and measures."""

    name: str
    domain: str
    per_key: str


@dataclass(frozen=True)
class MemberCheck:
    """The key must come exactly once in the role: violations are its distance from one."""

    name: str
    domain: str
    role: str
    key: str


def resolves(name: str, domain: str, child: str, parent: str) -> KeyCheck:
    """Child rows whose key no parent row has; a null key resolves nowhere."""
    return KeyCheck(name, domain, f"if(n_{parent} = 0 or key is null, n_{child}, 0L)")


def unique(name: str, domain: str, role: str) -> KeyCheck:
    """Rows beyond the first of each key; null is no key."""
    return KeyCheck(name, domain, f"if(key is null, n_{role}, greatest(n_{role} - 1, 0L))")


def run_checks(sources: Sequence[Source], checks: Sequence[KeyCheck | MemberCheck]) -> DataFrame:
    """(check_name, violations, passed) of all row rules and checks. Sources without rows violate nothing but member checks."""
    roles = [r for s in sources for r in s.roles]
    if len({r.role for r in roles}) != len(roles):
        raise ValueError("every role needs its own name")
    merged = [s.merged for s in sources if s.merged]
    if len(set(merged)) != len(merged) or set(merged) & {r.domain for r in roles}:
        raise ValueError("a merged domain has its keys in one source")
    unknown = {c.domain for c in checks} - {r.domain for r in roles} - set(merged)
    if unknown:
        raise ValueError(f"no source has a key in {sorted(unknown)}")
    # a role counts in a place of its domain, a measure adds in one; domains share the places, so a key's counts are few
    taken: Counter = Counter()
    place: dict[str, int] = {}
    sums: dict[str, str] = {}  # shared column -> aggregate
    column: dict[tuple[str, str], str] = {}
    for r in roles:
        place[r.role] = taken[r.domain]
        taken[r.domain] += 1
        for m, (aggregate, _) in r.measures.items():
            column[r.role, m] = f"{aggregate}{taken[r.domain, aggregate]}"
            sums[column[r.role, m]] = aggregate
            taken[r.domain, aggregate] += 1
    entries = None
    counted: list[str] = []  # checks whose violations are counted row by row
    for s in sources:
        own = {**{n: (sql, "1L") for n, sql in s.rules.items()}, **{n: (f"{sql} <> 0", sql) for n, sql in s.counts.items()}}
        for c in checks:
            if c.domain == s.merged:
                sql = _violations(c) if isinstance(c, KeyCheck) else f"if(key = {literal(c.key)}, n_{c.role}, 0L)"
                own[c.name] = (f"{sql} <> 0", sql)
        items = []
        for r in s.roles:
            item = _entry(literal(r.domain), f"cast({r.key} as string)", r.rows, place[r.role], {column[r.role, m]: sql for m, (_, sql) in r.measures.items()}, sums)
            items.append(item if r.rows == "1L" else f"if({r.rows} <> 0, {item}, null)")
        items += [f"if({sql}, {_entry(literal(_ROW), literal(name), n, -1, {}, sums)}, null)" for name, (sql, n) in own.items()]
        counted += own
        # rules that hold are dropped after the explode: a lambda over the array would keep Spark from compiling the entries
        one = s.frame.selectExpr(f"explode(array({', '.join(items)})) as e").where("e is not null").select("e.*")
        entries = one if entries is None else entries.unionByName(one)
    counts = [F.expr(f"sum(if(place = {i}, n, 0L)) as _n{i}") for i in range(max(place.values(), default=-1) + 1)]
    shared = entries.groupBy("domain", "key").agg(
        F.sum("n").alias("n"), *counts, *[F.expr(f"{aggregate}({c}) as {c}") for c, aggregate in sums.items()]
    )
    per_key = shared.selectExpr(
        "domain", "key", "n", *[f"if(domain = {literal(r.domain)}, _n{place[r.role]}, 0L) as n_{r.role}" for r in roles],
        *[f"if(domain = {literal(r.domain)}, {column[r.role, m]}, null) as {r.role}_{m}" for r in roles for m in r.measures],
    )
    figures = {name: f"sum(if(domain = {literal(_ROW)} and key = {literal(name)}, n, 0L))" for name in counted}
    for c in checks:
        if isinstance(c, MemberCheck):
            found = figures.get(c.name) or f"sum(if(domain = {literal(c.domain)} and key = {literal(c.key)}, n_{c.role}, 0L))"
            figures[c.name] = f"abs(1L - coalesce({found}, 0L))"
        elif c.domain not in merged:
            figures[c.name] = f"sum(if(domain = {literal(c.domain)}, {_violations(c)}, 0L))"
    names = list(figures)
    row = per_key.agg(*[F.expr(f"cast(coalesce({sql}, 0L) as bigint) as c{i}") for i, sql in enumerate(figures.values())])
    cells = ", ".join(f"struct({literal(name)} as check_name, c{i} as violations)" for i, name in enumerate(names))
    return row.selectExpr(f"inline(array({cells}))").selectExpr("*", "violations = 0 as passed")


def _violations(check: KeyCheck) -> str:
    return f"coalesce({check.per_key}, 0L)"


def _entry(domain: str, key: str, rows: str, place: int, own: Mapping[str, str], columns: Mapping[str, str]) -> str:
    values = ", ".join(f"cast({own.get(c, 'null')} as decimal(28,4)) as {c}" for c in columns)
    return f"struct({domain} as domain, {key} as key, {rows} as n, {place} as place{', ' + values if values else ''})"
