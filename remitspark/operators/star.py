"""Star-schema building: calendar, surrogate-key dimensions with an Unknown member, facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import date_key
from .ordering import with_position
from .relational import keep_first, map_surrogates, slots_to_rows


def calendar_dim(frames: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """One row per distinct date of the given date columns, plus the Unknown row (key 0)."""
    dates = None
    for df, columns in frames:
        one = df.select(F.explode(F.array(*[F.col(c).cast("date") for c in columns])).alias("full_date")).distinct()
        dates = one if dates is None else dates.unionAll(one)
    known = dates.where("full_date is not null").distinct()
    unknown = known.sparkSession.range(1).selectExpr("cast(null as date) as full_date")
    d = F.col("full_date")
    return known.unionAll(unknown).select(
        date_key(d).alias("date_key"),
        "full_date",
        F.expr("year(full_date) as year"),
        F.expr("quarter(full_date) as quarter"),
        F.expr("month(full_date) as month"),
        F.expr("date_format(full_date, 'MMMM') as month_name"),
        F.expr("day(full_date) as day"),
        F.expr("weekday(full_date) as day_of_week"),
        F.expr("date_format(full_date, 'EEEE') as day_name"),
        F.expr("weekday(full_date) >= 5 as is_weekend"),
    )


def surrogate_dim(
    df: DataFrame,
    natural: str,
    surrogate: str,
    attributes: Sequence[str] = (),
    first_by: Sequence[str] = (),
    provenance: str = "SOURCE",
) -> DataFrame:
    """Members with dense keys 1..n in natural-key order and the Unknown member with key 0.

    Of several rows with one natural key the first in ``first_by`` order gives the attributes.
    Blank keys are not members.
    """
    rows = df.where(F.col(natural).isNotNull())
    if dict(df.dtypes)[natural] == "string":
        rows = rows.where(F.trim(F.col(natural)) != "")
    if attributes:
        members = keep_first(rows.select(natural, *attributes, *[c for c in first_by if c not in (natural, *attributes)]), [natural], list(first_by) or list(attributes))
        members = members.select(natural, *attributes)
    else:
        members = rows.select(natural).distinct()
    keyed = with_position(members, [natural], surrogate)
    out = keyed.selectExpr(f"cast({surrogate} as bigint) as {surrogate}", natural, *attributes, f"'{provenance}' as provenance")
    text = dict(df.dtypes)[natural] == "string"
    unknown = df.sparkSession.range(1).selectExpr(
        f"cast(0 as bigint) as {surrogate}",
        (f"'UNKNOWN' as {natural}" if text else f"cast(null as {dict(df.dtypes)[natural]}) as {natural}"),
        *[f"cast(null as {dict(df.dtypes)[a]}) as {a}" for a in attributes],
        "'DERIVED' as provenance",
    )
    return unknown.unionByName(out)


def claim_headers(lines: DataFrame, claim: str, line: str) -> DataFrame:
    """Header grain: the first line of each claim by line number."""
    return keep_first(lines, [claim], [line])


def header_fact(
    headers: DataFrame,
    dims: Sequence[tuple[DataFrame, str, str]],
    dates: Sequence[tuple[str, str]],
    money: Sequence[str],
    stay: tuple[str, str] | None = None,
) -> DataFrame:
    """Headers with surrogate keys (0 when unknown), date keys, rounded money and stay length.

    ``dims`` holds (dimension, natural key, surrogate key); ``dates`` (source column, key column).
    """
    out = headers
    for dim, natural, surrogate in dims:
        members = dim.where(F.col(surrogate) != 0)
        out = map_surrogates(out, members, natural, surrogate)
    extra = [date_key(F.col(src).cast("date")).alias(key) for src, key in dates]
    if stay:
        extra.append(F.expr(f"datediff({stay[1]}, {stay[0]}) + 1 as length_of_stay_days"))
    fixed = [F.expr(f"cast(round({c}, 2) as decimal(14,2)) as {c}") for c in money]
    return out.select(*[c for c in out.columns if c not in money], *fixed, *extra)


def diagnosis_fact(headers: DataFrame, claim: str, code_prefix: str, flag_prefix: str, slots: int = 25) -> DataFrame:
    return slots_to_rows(
        headers, [claim], [(f"{code_prefix}{i}", f"{flag_prefix}{i}") for i in range(1, slots + 1)],
        "dgns_seq", "icd_dgns_cd", "poa_ind_sw",
    )


def star_report(lines: DataFrame, headers: DataFrame, fact: DataFrame, diagnoses: DataFrame, money: str, keys: Sequence[str]) -> DataFrame:
    """One row of reconciliation figures for a star build."""
    base = fact.agg(
        F.expr("count(1) as claims"),
        F.expr(f"round(sum({money}), 2) as money_total"),
        *[F.expr(f"count_if({k} = 0) as unresolved_{k}") for k in keys],
    )
    return base.withColumn("raw_lines", lines.agg(F.count(F.lit(1))).scalar()).withColumn(
        "diagnoses", diagnoses.agg(F.count(F.lit(1))).scalar()
    ).withColumn("headers", headers.agg(F.count(F.lit(1))).scalar())
