"""Temporal splits on a date quantile: every row of the cut date stays on the train side."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import day_quantiles

EPOCH = dt.date(1970, 1, 1)


def _days(df: DataFrame, date: str) -> DataFrame:
    return df.selectExpr(f"datediff({date}, date'1970-01-01') as _day")


def date_cuts(df: DataFrame, date: str, quantiles: list[float]) -> list[dt.date]:
    """Floor-to-day date quantiles. Runs over (day, rows) counts; only the cuts reach the driver."""
    return [EPOCH + dt.timedelta(days=math.floor(q)) for q in day_quantiles(_days(df, date), "_day", quantiles)]


def _no_nulls(df: DataFrame, date: str) -> None:
    if not df.where(F.col(date).isNull()).isEmpty():
        raise ValueError(f"{date} has nulls; a temporal split cannot place those rows")


def temporal_split(df: DataFrame, date: str, quantile: float = 0.8, out: str = "fold") -> DataFrame:
    """Adds ``out`` = train (date <= cut) or test."""
    if not 0.0 < quantile < 1.0:
        raise ValueError("quantile must be in (0, 1)")
    _no_nulls(df, date)
    cuts = date_cuts(df, date, [quantile])
    last = df.agg(F.max(F.col(date).cast("date"))).first()[0]
    if not cuts or last is None or last <= cuts[0]:
        raise ValueError("the cut leaves an empty fold")
    return df.withColumn(out, F.expr(f"if(cast({date} as date) <= date'{cuts[0]}', 'train', 'test')"))


def two_folds(df: DataFrame, date: str, quantile: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The rows up to the cut date and those after it; rows without a date are in neither. Without any date both are empty."""
    cuts = date_cuts(df, date, [quantile])
    cut = f"date'{cuts[0]}'" if cuts else "cast(null as date)"
    return df.where(f"cast({date} as date) <= {cut}"), df.where(f"cast({date} as date) > {cut}")


def nested_split(
    df: DataFrame,
    date: str,
    quantile: float = 0.8,
    calibration_quantile: float = 0.8,
    out: str = "fold",
    dates: DataFrame | None = None,
) -> DataFrame:
    """Adds ``out`` = fit, calibrate (the end of train) or test, in time order.

    The cuts are worked out on (day, rows) counts, scanned once. ``dates`` may give the same rows
    from a cheaper plan than the full feature frame.
    """
    d = f"cast({date} as date)"
    per_day = (
        (df if dates is None else dates)
        .groupBy(F.expr(f"{d} as _d"))
        .agg(F.expr("count(1) as _n"))
        .selectExpr("_n", "datediff(_d, date'1970-01-01') as _day")
        .persist()
    )
    try:
        row = per_day.agg(
            F.expr(f"percentile(_day, {quantile}D, _n) as q"),
            F.expr("max(_day) as last"),
            F.expr("count_if(_day is null) as missing"),
        ).first()
        if row["missing"]:
            raise ValueError(f"{date} has nulls; a temporal split cannot place those rows")
        cut_day = math.floor(row["q"])
        inner_q = per_day.where(F.col("_day") <= cut_day).agg(
            F.expr(f"percentile(_day, {calibration_quantile}D, _n) as q")
        ).first()["q"]
    finally:
        per_day.unpersist()
    inner_day = math.floor(inner_q)
    if row["last"] <= cut_day or inner_day >= cut_day:
        raise ValueError("the cuts leave an empty fold")
    cut, inner = EPOCH + dt.timedelta(days=cut_day), EPOCH + dt.timedelta(days=inner_day)
    return df.withColumn(
        out, F.expr(f"case when {d} <= date'{inner}' then 'fit' when {d} <= date'{cut}' then 'calibrate' else 'test' end")
    )


def forward_folds(
    df: DataFrame, date: str, n_folds: int = 4, first_train_quantile: float = 0.4
) -> DataFrame:
    """Expanding-window folds as rows: each input row once per fold it takes part in.

    Adds ``fold_no``, ``cut_date`` and ``role`` (train/validate). Folds with an empty side are
    left out.
    """
    if n_folds < 2:
        raise ValueError("need at least two folds")
    step = (1.0 - first_train_quantile) / n_folds
    quantiles = [first_train_quantile + step * i for i in range(n_folds)]
    cuts = date_cuts(df, date, quantiles)
    last = df.agg(F.max(F.col(date).cast("date"))).first()[0]
    first = df.agg(F.min(F.col(date).cast("date"))).first()[0]
    windows = []
    for i, cut in enumerate(cuts):
        upper = cuts[i + 1] if i + 1 < len(cuts) else last
        windows.append((i, cut, upper))
    d = f"cast({date} as date)"
    parts = ", ".join(
        f"case when {d} <= date'{cut}' then struct({i} as fold_no, date'{cut}' as cut_date, 'train' as role) "
        f"when {d} <= date'{upper}' then struct({i} as fold_no, date'{cut}' as cut_date, 'validate' as role) end"
        for i, cut, upper in windows
        if first <= cut < upper
    )
    return df.select("*", F.expr(f"inline(array_compact(array({parts})))"))


def split_evidence(df: DataFrame, date: str, label: str | None = None, fold: str = "fold") -> DataFrame:
    """Rows, share, date range and base rate per fold."""
    base = [F.expr(f"avg(cast({label} as double)) as base_rate")] if label else []
    sizes = df.groupBy(fold).agg(
        F.expr("count(1) as fold_rows"),
        F.expr(f"min(cast({date} as date)) as first_date"),
        F.expr(f"max(cast({date} as date)) as last_date"),
        *base,
    )
    return sizes.selectExpr("*", "cast(fold_rows as double) / sum(fold_rows) over () as fold_share")


def temporal_trespass(df: DataFrame, date: str, fold: str = "fold", train: str = "train") -> DataFrame:
    """How many train rows are later than the earliest other row: (trespassers, train_rows, share)."""
    first_test = df.where(F.col(fold) != train).agg(F.min(date).alias("d"))
    return (
        df.where(F.col(fold) == train)
        .withColumn("_first", first_test.scalar())
        .agg(F.expr(f"count_if({date} > _first) as trespassers"), F.expr("count(1) as train_rows"))
        .selectExpr("*", "trespassers / nullif(train_rows, 0) as share")
    )
