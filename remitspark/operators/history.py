"""Embargoed prior-period rates: what was already known about an entity on a row's date."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DAY = "_day"


def _history(df: DataFrame, keys: Sequence[str], outcome: str, embargo_days: int) -> DataFrame:
    """Per (keys, day): outcome sum and count over days up to day - embargo.

    Rows are first merged to one row per (keys, day); the range frame then runs over days, so a
    key with a third of all rows still has at most one row per calendar day in its window.
    Same-day rows never see one another because the frame ends ``embargo_days`` before the day.
    """
    per_day = df.groupBy(*keys, _DAY).agg(
        F.expr(f"sum({outcome}) as _s"), F.expr(f"count({outcome}) as _n")
    )
    part = f"partition by {', '.join(keys)} " if keys else ""
    frame = f"over ({part}order by {_DAY} range between unbounded preceding and {embargo_days} preceding)"
    return per_day.selectExpr(
        *keys, _DAY, f"coalesce(sum(_s) {frame}, 0) as _total", f"coalesce(sum(_n) {frame}, 0) as _count"
    )


def _check(df: DataFrame, date: str, embargo_days: int) -> None:
    if embargo_days < 1:
        raise ValueError("embargo_days must be at least 1; with zero a row would see its own outcome")
    if dict(df.dtypes)[date] not in ("date", "timestamp", "timestamp_ntz"):
        raise TypeError(f"{date} must be a date or timestamp")


def _with_day(df: DataFrame, date: str) -> DataFrame:
    return df.selectExpr("*", f"datediff({date}, date'1970-01-01') as {_DAY}")


def _join_null_safe(df: DataFrame, side: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Left join on keys and day. A null key meets nothing, which is 'no history'."""
    return df.join(side.select(*keys, _DAY, *values), [*keys, _DAY], "left")


def prior_rate(
    df: DataFrame,
    date: str,
    outcome: str,
    key: str | Sequence[str] | None = None,
    embargo_days: int = 60,
    smoothing: float = 20.0,
    prefix: str = "prior",
) -> DataFrame:
    """Adds ``{prefix}_rate``, ``{prefix}_count`` and ``{prefix}_raw_rate``.

    The rate is shrunk toward the book rate of the same embargoed window with weight
    ``smoothing``. While the book itself has no history the smoothed rate is null. An unkeyed
    rate shrinks toward itself.
    """
    keys = [] if key is None else [key] if isinstance(key, str) else list(key)
    out = add_prior_rates(
        df, date, outcome, {prefix: keys}, embargo_days, smoothing, names=("{}_rate", "{}_count", "{}_raw_rate")
    )
    return out.drop("book_prior_rate")


def add_prior_rates(
    df: DataFrame,
    date: str,
    outcome: str,
    entities: Mapping[str, str | Sequence[str]],
    embargo_days: int = 60,
    smoothing: float = 20.0,
    book: str = "book_prior_rate",
    names: tuple[str, str, str | None] = ("{}_prior_rate", "{}_prior_count", None),
) -> DataFrame:
    """Attach a smoothed rate and a count per entity, all shrunk toward one moving book rate.

    Null outcomes add no history but still receive rates. One aggregation to (key, day) and one
    join per entity.
    """
    _check(df, date, embargo_days)
    base = _with_day(df, date)
    # the unkeyed history has one row per calendar day
    book_side = _history(base, [], outcome, embargo_days).selectExpr(
        _DAY, f"cast(_total as double) / nullif(_count, 0) as {book}", "_total as _bt", "_count as _bc"
    )
    # one row for each calendar day, so it is sent to the rows
    out = _join_null_safe(base, F.broadcast(book_side), [], [book, "_bt", "_bc"])
    rate_name, count_name, raw_name = names
    for prefix, key in entities.items():
        keys = [key] if isinstance(key, str) else list(key)
        if keys:
            known = base.where(" and ".join(f"{k} is not null" for k in keys))
            side = _history(known, keys, outcome, embargo_days).selectExpr(
                *keys, _DAY, "_total as _kt", "_count as _kc"
            )
            out = _join_null_safe(out, side, keys, ["_kt", "_kc"])
        else:
            out = out.selectExpr("*", "_bt as _kt", "_bc as _kc")
        total, count = "cast(coalesce(_kt, 0) as double)", "coalesce(_kc, 0)"
        if smoothing > 0:
            rate = f"({total} + {smoothing}D * {book}) / ({count} + {smoothing}D)"
        else:
            rate = f"{total} / nullif({count}, 0)"
        extra = [f"{total} / nullif({count}, 0) as {raw_name.format(prefix)}"] if raw_name else []
        out = out.selectExpr(
            "*", f"{rate} as {rate_name.format(prefix)}", f"{count} as {count_name.format(prefix)}", *extra
        ).drop("_kt", "_kc")
    return out.drop(_DAY, "_bt", "_bc")
