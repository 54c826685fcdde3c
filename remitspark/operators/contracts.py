"""Table contracts: required columns, unique keys, date order, non-negative money; quarantine."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.inline import values_frame

KEYS_PER_TASK = 1_000_000
QUARANTINE_SCHEMA = "table_name string, contract string, entity_key string, reason string"


@dataclass(frozen=True)
class Contract:
    table: str
    required: Sequence[str] = ()
    unique_key: Sequence[str] = ()
    date_order: Sequence[tuple[str, str]] = ()
    non_negative: Sequence[str] = field(default_factory=tuple)


def missing_columns(df: DataFrame, contract: Contract) -> list[str]:
    return [c for c in contract.required if c not in df.columns]


def _date(df: DataFrame, c: str) -> str:
    kind = dict(df.dtypes)[c]
    return f"try_cast({c} as date)" if kind == "string" else f"cast({c} as date)"


def _number(df: DataFrame, c: str) -> str:
    return f"try_cast({c} as double)" if dict(df.dtypes)[c] == "string" else c


def _copies(df: DataFrame, keys: Sequence[str], rows: int | None) -> DataFrame:
    """(keys, _n): how many rows each key has.

    With ``rows`` the keys are dealt into parts of about ``KEYS_PER_TASK``: sorted keys compress so well that parts of equal
    bytes would hold more of them the larger the table is. Copies within an Arrow batch are combined before they are dealt.
    """
    if rows is None:
        return df.groupBy(*keys).agg(F.expr("count(1) as _n"))
    only = df.select(*keys)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from pa.Table.from_batches([b]).group_by(list(keys)).aggregate([([], "count_all")]).select([*keys, "count_all"]).rename_columns([*keys, "_n"]).to_batches()

    kinds = ", ".join(f"`{c}` {t}" for c, t in only.dtypes)
    dealt = only.mapInArrow(combine, f"{kinds}, _n bigint").repartition(max(1, math.ceil(rows / KEYS_PER_TASK)), *keys)
    return dealt.groupBy(*keys).agg(F.expr("sum(_n) as _n"))


def quarantine(df: DataFrame, contract: Contract, rows: int | None = None) -> DataFrame:
    """One row per violation: (table_name, contract, entity_key, reason).

    Row rules are tested together in one scan. Uniqueness is counted per key (a key with many
    copies is combined before the shuffle) and the copies are written out again by repeating the
    key, so every duplicate row is quarantined without collecting its copies. ``rows``: about how many rows there are, if known;
    it bounds the keys that one task holds.
    """
    t = contract.table
    keys = [k for k in contract.unique_key if k in df.columns]
    entity = f"concat_ws('|', {', '.join(f'cast({k} as string)' for k in keys)})" if keys else "cast(null as string)"
    rules = []
    for early, late in contract.date_order:
        if early in df.columns and late in df.columns:
            rules.append(
                f"if({_date(df, early)} > {_date(df, late)}, "
                f"struct('date_order' as contract, '{early} > {late}' as reason), null)"
            )
    for c in contract.non_negative:
        if c in df.columns:
            rules.append(f"if({_number(df, c)} < 0, struct('non_negative_money' as contract, '{c} < 0' as reason), null)")
    parts = []
    if rules:
        parts.append(
            df.selectExpr(f"{entity} as entity_key", f"inline(array_compact(array({', '.join(rules)})))")
        )
    if keys:
        repeated = _copies(df, keys, rows).where("_n > 1")
        parts.append(_repeat(repeated, entity, f"duplicate {'+'.join(keys)}"))
    if not parts:
        return df.sparkSession.createDataFrame([], QUARANTINE_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.selectExpr(f"'{t}' as table_name", "contract", "entity_key", "reason")


def _repeat(repeated: DataFrame, entity: str, reason: str, chunk: int = 10_000) -> DataFrame:
    """Each key once per copy. Done in two steps so no single array grows with the copies."""
    blocks = repeated.selectExpr(
        f"{entity} as entity_key", "_n", f"explode(sequence(0L, (_n - 1) div {chunk})) as _block"
    )
    return blocks.selectExpr(
        "entity_key",
        "'key_uniqueness' as contract",
        f"'{reason}' as reason",
        f"explode(sequence(1, cast(least({chunk}, _n - _block * {chunk}) as int))) as _copy",
    ).drop("_copy")


def contract_report(df: DataFrame, contract: Contract, rows: int | None = None) -> DataFrame:
    """(table_name, check_name, violations, passed), one row per rule."""
    missing = missing_columns(df, contract)
    spark = df.sparkSession
    found = quarantine(df, contract, rows)
    names = []
    if contract.unique_key:
        names.append(("key_uniqueness", f"duplicate {'+'.join(contract.unique_key)}"))
    names += [("date_order", f"{a} > {b}") for a, b in contract.date_order]
    names += [("non_negative_money", f"{c} < 0") for c in contract.non_negative]
    counts = found.groupBy("contract", "reason").agg(F.expr("count(1) as violations"))
    spine = values_frame(spark, [(c, r) for c, r in names], "contract string, reason string")
    rows = spine.join(counts, ["contract", "reason"], "left").selectExpr(
        f"'{contract.table}' as table_name",
        "contract",
        "reason",
        "coalesce(violations, 0) as violations",
        "coalesce(violations, 0) = 0 as passed",
    )
    required = values_frame(
        spark,
        [(contract.table, "required_columns", ",".join(missing), len(missing), not missing)],
        "table_name string, contract string, reason string, violations bigint, passed boolean",
    )
    return required.unionByName(rows)


def table_passes(report: DataFrame) -> bool:
    """Table-level verdict: required columns present and keys unique."""
    return report.where("contract in ('required_columns', 'key_uniqueness') and not passed").isEmpty()


def row_reconciliation(counts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Staged rows against manifest rows per table name: (name, staged, expected, passed)."""
    joined = counts.selectExpr("name", "row_count as staged").join(
        manifest.selectExpr("name", "row_count as expected"), "name", "full_outer"
    )
    return joined.selectExpr("name", "staged", "expected", "staged <=> expected as passed")
