"""Reconciliation and integrity checks, each returning one row per check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.inline import values_frame
from .relational import orphans, union_labelled


def violation_counts(df: DataFrame, rules: Mapping[str, str], label: str = "check_name") -> DataFrame:
    """Row rules of one table counted in a single scan: (check, violations, passed)."""
    row = df.agg(*[F.expr(f"count_if({sql}) as `{name}`") for name, sql in rules.items()])
    return row.unpivot([], list(rules), label, "violations").selectExpr("*", "violations = 0 as passed")


@dataclass(frozen=True)
class ForeignKey:
    name: str
    child: DataFrame
    child_key: str
    parent: DataFrame
    parent_key: str


def foreign_key_violations(keys: Sequence[ForeignKey]) -> DataFrame:
    """Orphan rows per foreign key: (check_name, violations, passed)."""
    frames = {
        k.name: orphans(k.child.select(k.child_key), k.parent, k.child_key, k.parent_key).agg(
            F.expr("count(1) as violations")
        )
        for k in keys
    }
    return union_labelled(frames, "check_name").selectExpr("check_name", "violations", "violations = 0 as passed")


def duplicate_surplus(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(row_count, distinct_keys, surplus): rows, keys and rows beyond the first of each key."""
    counts = df.groupBy(*columns).agg(F.expr("count(1) as n"))
    return counts.agg(
        F.expr("coalesce(sum(n), 0) as row_count"),
        F.expr("count(1) as distinct_keys"),
        F.expr("coalesce(sum(n - 1), 0) as surplus"),
    )


def unknown_member_once(dim: DataFrame, surrogate: str) -> DataFrame:
    return dim.agg(F.expr(f"abs(count_if({surrogate} = 0) - 1) as violations")).selectExpr(
        "violations", "violations = 0 as passed"
    )


def scorecard(rows: DataFrame) -> DataFrame:
    """Metric and verdict from (check_id, …, numerator, denominator, threshold_min, severity).

    A zero denominator marks an absolute count that must equal the threshold; info checks are
    not scored.
    """
    metric = (
        "if(denominator = 0, cast(numerator as decimal(38,6)), "
        "round(cast(numerator as decimal(20,0)) / nullif(cast(denominator as decimal(20,0)), 0), 6))"
    )
    return rows.selectExpr("*", f"cast({metric} as decimal(28,6)) as metric_value").selectExpr(
        "*",
        "case when severity = 'info' then cast(null as boolean) "
        "when denominator = 0 then numerator = threshold_min else metric_value >= threshold_min end as pass_flag",
    )


def reconcile(pairs: Sequence[tuple[str, DataFrame | None, DataFrame | None, float]], spark) -> DataFrame:
    """Figures against control totals: (check_name, figure, control, status).

    Each side is a one-cell frame; a missing side gives MISSING_INPUT, which is not a pass.
    """
    frames = []
    for name, figure, control, tolerance in pairs:
        if figure is None or control is None:
            frames.append(
                values_frame(
                    spark,
                    [(name, None, None, "MISSING_INPUT")],
                    "check_name string, figure double, control double, status string",
                )
            )
            continue
        base = spark.range(1).select(
            figure.scalar().cast("double").alias("figure"), control.scalar().cast("double").alias("control")
        )
        frames.append(
            base.selectExpr(
                f"'{name}' as check_name",
                "figure",
                "control",
                f"case when figure is null or control is null then 'ERROR' "
                f"when abs(figure - control) <= {tolerance}D then 'PASS' else 'FAIL' end as status",
            )
        )
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def reconcile_summary(report: DataFrame) -> DataFrame:
    return report.agg(
        F.expr("count_if(status = 'PASS') as passed"),
        F.expr("count_if(status = 'FAIL') as failed"),
        F.expr("count_if(status in ('MISSING_INPUT', 'ERROR')) as unevaluated"),
        F.expr("count(1) as checks"),
    )


def null_profile(df: DataFrame, digits: int = 6) -> DataFrame:
    """(column_name, data_type, rows, nulls, null_rate) in one scan."""
    counts = df.agg(
        F.expr("count(1) as _rows"), *[F.expr(f"count_if(`{c}` is null) as `{c}`") for c in df.columns]
    )
    kinds = ", ".join(f"'{c}', '{t}'" for c, t in df.dtypes)
    return counts.unpivot(["_rows"], list(df.columns), "column_name", "nulls").selectExpr(
        "column_name",
        f"map({kinds})[column_name] as data_type",
        "_rows as row_count",
        "nulls",
        f"round(cast(nulls as decimal(20,0)) / nullif(cast(_rows as decimal(20,0)), 0), {digits}) as null_rate",
    )


def profile_drift(candidate: DataFrame, committed: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Differences between two null profiles: (column_name, deviation, committed_value, candidate_value)."""
    a = committed.selectExpr("column_name", "row_count as _ra", "null_rate as _na")
    b = candidate.selectExpr("column_name", "row_count as _rb", "null_rate as _nb")
    columns = a.join(b, "column_name", "full_outer").selectExpr(
        "column_name",
        f"case when _rb is null then 'column_removed' when _ra is null then 'column_added' "
        f"when abs(_na - _nb) > {tolerance} then 'null_rate_changed' end as deviation",
        "cast(_na as double) as committed_value",
        "cast(_nb as double) as candidate_value",
    )
    rows = (
        committed.agg(F.expr("max(row_count) as a"))
        .withColumn("b", candidate.agg(F.expr("max(row_count)")).scalar())
        .selectExpr(
            "'*' as column_name",
            "if(a <=> b, null, 'row_count_changed') as deviation",
            "cast(a as double) as committed_value",
            "cast(b as double) as candidate_value",
        )
    )
    return columns.unionByName(rows).where("deviation is not null")


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive fingerprint: rows, sum and xor of row hashes."""
    return df.select(F.xxhash64(*df.columns).alias("h")).agg(
        F.expr("count(1) as row_count"),
        F.expr("sum(cast(h as decimal(20,0))) as hash_sum"),
        F.expr("bit_xor(h) as hash_xor"),
    )


def keys_agree(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Load guard: both tables hold as many keys with the same sum: (rows_a, rows_b, sum_a, sum_b, passed)."""
    one = a.agg(F.expr("count(1) as rows_a"), F.expr(f"sum(cast({key} as decimal(20,0))) as sum_a"))
    two = b.agg(F.expr("count(1) as rows_b"), F.expr(f"sum(cast({key} as decimal(20,0))) as sum_b"))
    return (
        one.withColumn("rows_b", two.select("rows_b").scalar())
        .withColumn("sum_b", two.select("sum_b").scalar())
        .selectExpr("rows_a", "rows_b", "sum_a", "sum_b", "rows_a <=> rows_b and sum_a <=> sum_b as passed")
    )


def require_rows(df: DataFrame, name: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{name} is empty")
    return df


def changed_columns(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """How many rows differ per column between two builds, aligned by key."""
    columns = [c for c in before.columns if c != key and c in after.columns]
    joined = before.alias("a").join(after.alias("b"), key, "inner")
    row = joined.agg(*[F.expr(f"count_if(not (a.`{c}` <=> b.`{c}`)) as `{c}`") for c in columns])
    return row.unpivot([], columns, "column_name", "changed_rows")


def perturbation_lineage(source: DataFrame, key: str, columns: Sequence[str], build, change: Mapping[str, str]) -> DataFrame:
    """Which output columns move when one input column is changed: (input, column_name, changed_rows).

    ``build`` maps the source to the output; ``change`` gives the SQL of each altered column.
    """
    base = build(source)
    frames = {
        c: changed_columns(base, build(source.withColumn(c, F.expr(change[c]))), key).where("changed_rows > 0")
        for c in columns
    }
    return union_labelled(frames, "input_column")


def directional_checks(df: DataFrame, outcome: str, masks: Mapping[str, tuple[str, str, float]]) -> DataFrame:
    """(check_name, high_rate, low_rate, lift, passed): rate(high) - rate(low) >= margin."""
    row = df.agg(
        *[
            F.expr(f"struct(avg(case when {hi} then cast({outcome} as double) end) as high_rate, "
                   f"avg(case when {lo} then cast({outcome} as double) end) as low_rate, "
                   f"{margin}D as margin) as `{name}`")
            for name, (hi, lo, margin) in masks.items()
        ]
    )
    return row.unpivot([], list(masks), "check_name", "v").selectExpr(
        "check_name", "v.high_rate", "v.low_rate", "v.high_rate - v.low_rate as lift",
        "coalesce(v.high_rate - v.low_rate >= v.margin, false) as passed",
    )


def band_checks(df: DataFrame, measures: Mapping[str, tuple[str, float, float]]) -> DataFrame:
    """(check_name, value, low, high, passed) for aggregates that must lie in a band."""
    row = df.agg(
        *[
            F.expr(f"struct(cast({sql} as double) as value, {lo}D as low, {hi}D as high) as `{name}`")
            for name, (sql, lo, hi) in measures.items()
        ]
    )
    return row.unpivot([], list(measures), "check_name", "v").selectExpr(
        "check_name", "v.value", "v.low", "v.high", "coalesce(v.value between v.low and v.high, false) as passed"
    )


def run_report(df: DataFrame, measures: Mapping[str, str]) -> DataFrame:
    """One-row report of named aggregates."""
    return df.agg(*[F.expr(f"{sql} as `{name}`") for name, sql in measures.items()])
