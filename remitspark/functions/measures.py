"""Aggregate and ratio expressions with exact decimal rounding.

All helpers take and return SQL text, so a whole aggregation is a handful of parsed expressions.
Counts and money are summed exactly (integers, decimals); a rate is one decimal division, rounded
half up. Doubles are only produced by the caller, at the very end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNT = "decimal(20,0)"


def ratio(numerator: str, denominator: str, digits: int | None = 4) -> str:
    """numerator / denominator, null when the denominator is zero or null."""
    value = f"({numerator}) / nullif({denominator}, 0)"
    return value if digits is None else f"round({value}, {digits})"


def count_ratio(numerator: str, denominator: str, digits: int | None = 4) -> str:
    return ratio(f"cast({numerator} as {COUNT})", f"cast({denominator} as {COUNT})", digits)


def rate_where(condition: str, digits: int = 4) -> str:
    """Share of all rows of the group for which ``condition`` is true (null counts as false)."""
    return count_ratio(f"count_if({condition})", "count(1)", digits)


def rate_among(condition: str, base: str, digits: int = 4) -> str:
    return count_ratio(f"count_if(({condition}) and ({base}))", f"count_if({base})", digits)


def money_sum(column: str, digits: int = 2) -> str:
    return f"round(sum({column}), {digits})"


def money_sum_or_zero(column: str, digits: int = 2) -> str:
    return f"round(coalesce(sum({column}), 0), {digits})"


def mean_of(column: str, digits: int = 1) -> str:
    """Mean of an integer or decimal column over its non-null rows, rounded exactly."""
    return ratio(f"cast(sum({column}) as decimal(28,4))", f"cast(count({column}) as {COUNT})", digits)


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Cast every decimal column to double (the shape plotting and hashing tools expect)."""
    return df.selectExpr(
        *[
            f"cast(`{name}` as double) as `{name}`" if kind.startswith("decimal") else f"`{name}`"
            for name, kind in df.dtypes
        ]
    )


def grouped(df: DataFrame, keys: list[str], **measures: str) -> DataFrame:
    """``df.groupBy(keys)`` with named SQL aggregates."""
    return df.groupBy(*keys).agg(*[F.expr(f"{sql} as `{name}`") for name, sql in measures.items()])


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Every double and decimal column rounded (for reports and comparisons)."""
    return df.selectExpr(
        *[
            f"round(cast(`{n}` as double), {digits}) as `{n}`" if t == "double" or t.startswith("decimal") else f"`{n}`"
            for n, t in df.dtypes
        ]
    )
