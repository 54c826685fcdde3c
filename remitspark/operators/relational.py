"""Joins and reshapes that keep the grain of the left side visible."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.measures import grouped


def aggregate_then_join(
    base: DataFrame, many: DataFrame, key: str, aggregates: Mapping[str, str]
) -> DataFrame:
    """Left join of a one-to-many table reduced to one row per key, so the base grain holds."""
    reduced = grouped(many, [key], **aggregates)
    return base.join(reduced, key, "left")


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add every column of a one-row aggregate to all rows, as one scalar subquery."""
    packed = one_row.select(F.struct(*one_row.columns).alias("s"))
    return df.withColumn("_one", packed.scalar()).select(*df.columns, "_one.*")


def describe_codes(df: DataFrame, codes: DataFrame, code: str, text: str, columns: Mapping[str, str]) -> DataFrame:
    """One code table joined once per code column: ``columns`` maps code column -> text column."""
    out = df
    for column, label in columns.items():
        side = codes.select(F.col(code).alias(column), F.col(text).alias(label))
        out = out.join(side, column, "left")
    return out


def spine_join(spine: DataFrame, facts: DataFrame, on: str) -> DataFrame:
    """Keep every spine row, also those without facts."""
    return spine.join(facts, on, "left")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose (non-null) key has no parent."""
    keys = parent.select(F.col(parent_key).alias(child_key)).where(F.col(child_key).isNotNull())
    return child.where(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def matching(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows with at least one match."""
    return left.join(right.select(key), key, "left_semi")


def code_coverage(fact: DataFrame, codes: DataFrame, key: str) -> DataFrame:
    """(matched, total, coverage) of a code column against a reference list.

    Facts are first reduced to one row per code, so a code on a third of the rows costs one row
    in the join.
    """
    per_code = fact.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    known = codes.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_known", F.lit(True))
    joined = per_code.join(known, key, "left")
    matched = F.coalesce(F.sum(F.when(F.col("_known"), F.col("n"))), F.lit(0))
    return joined.agg(matched.alias("matched"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).withColumn(
        "coverage", F.col("matched") / F.nullif(F.col("total"), F.lit(0))
    )


def map_surrogates(fact: DataFrame, dim: DataFrame, natural: str, surrogate: str, dim_natural: str | None = None) -> DataFrame:
    """Replace a natural key by the dimension's surrogate; no match (or blank) gives 0."""
    side = dim.select(F.col(dim_natural or natural).alias(natural), F.col(surrogate))
    return fact.join(side, natural, "left").withColumn(surrogate, F.coalesce(surrogate, F.lit(0)))


def enrich_dimension(dim: DataFrame, reference: DataFrame, key: str, column: str, source: str, label: str) -> DataFrame:
    """Fill ``column`` from a reference table; where it was filled, its provenance becomes ``label``."""
    side = reference.select(F.col(key), F.col(source).alias("_ref"))
    old = F.col(column) if column in dim.columns else F.lit(None)
    origin = F.col("provenance") if "provenance" in dim.columns else F.lit(None)
    found = F.col("_ref").isNotNull()
    return (
        dim.join(side, key, "left")
        .withColumn(f"{column}_provenance", F.when(found, label).otherwise(origin))
        .withColumn(column, F.coalesce(F.col("_ref"), old))
        .drop("_ref")
    )


def checked_join(left: DataFrame, right: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Join that refuses a right side with repeated keys (the left grain would change)."""
    repeated = right.groupBy(on).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():
        raise ValueError(f"right side repeats {on}; the join would change the row grain")
    return left.join(right, on, how)


def range_bucket(
    df: DataFrame,
    code: str,
    ranges: DataFrame,
    low: str,
    high: str,
    label: str,
    out: str,
    unknown: str = "UNKNOWN",
    bin_width: int = 16,
) -> DataFrame:
    """Label of the [low, high] range an integer code (SQL text) falls in.

    Each range is spread over the bins it touches, and rows meet ranges by bin equality, so this
    is a hash or sort-merge join at any number of ranges.
    """
    binned = ranges.selectExpr(
        f"{low} as _lo",
        f"{high} as _hi",
        f"{label} as _label",
        f"explode(sequence(floor({low} / {bin_width}), floor({high} / {bin_width}))) as _bin",
    )
    rows = df.selectExpr("*", f"cast({code} as bigint) as _code", f"floor(cast({code} as bigint) / {bin_width}) as _rbin")
    return (
        rows.join(binned, F.expr("_rbin = _bin and _code between _lo and _hi"), "left")
        .withColumn(out, F.expr(f"coalesce(_label, '{unknown}')"))
        .drop("_code", "_rbin", "_bin", "_lo", "_hi", "_label")
    )


def month_snapshots(df: DataFrame, date: str, window_days: int, first: Column, last: Column, out: str = "as_of") -> DataFrame:
    """One row per month start on which the row is open: date <= as_of <= date + window.

    Every row generates its own few month starts; no spine is joined. ``first`` and ``last``
    bound the snapshots (month starts at or after the earliest date, at or before the latest).
    """
    month = F.trunc(F.col(date), "month")
    start = F.when(month == F.col(date), month).otherwise(F.add_months(month, 1))
    lower = F.greatest(start, first)
    upper = F.least(F.trunc(F.date_add(F.col(date), window_days), "month"), F.trunc(last, "month"))
    months = F.when(lower <= upper, F.sequence(lower, upper, F.expr("interval 1 month")))
    return df.withColumn(out, F.explode(months))


def keep_first(df: DataFrame, key: Sequence[str], order_by: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in the given order.

    ``min_by`` over a struct combines on the map side, so a key with very many copies is reduced
    before the shuffle.
    """
    rest = [c for c in df.columns if c not in key]
    order = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order_by])
    if not rest:
        return df.distinct()
    picked = df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return picked.select(*key, "_r.*").select(*df.columns)


def slots_to_rows(
    df: DataFrame, keys: Sequence[str], slots: Sequence[tuple[str, str | None]], seq: str, code: str, flag: str
) -> DataFrame:
    """Wide (code, flag) slot pairs to one row per non-blank code, with the slot number."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(i).alias(seq),
                F.col(c).cast("string").alias(code),
                (F.col(f).cast("string") if f in df.columns else F.lit(None).cast("string")).alias(flag),
            )
            for i, (c, f) in enumerate(slots, start=1)
            if c in df.columns
        ]
    )
    return (
        df.select(*keys, F.inline(pairs))
        .where(F.col(code).isNotNull() & (F.trim(F.col(code)) != ""))
    )


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def union_labelled(frames: Mapping[str, DataFrame], label: str) -> DataFrame:
    """Stack frames by column name, with the frame's name in ``label``."""
    out = None
    for name, frame in frames.items():
        part = frame.withColumn(label, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose number of copies differs: columns…, copies_a - copies_b as ``excess``.

    One union and one aggregation instead of two EXCEPT ALL passes; copies are combined before
    the shuffle.
    """
    if a.columns != b.columns or [t for _, t in a.dtypes] != [t for _, t in b.dtypes]:
        raise ValueError("the two tables have different schemas")
    both = a.withColumn("_w", F.lit(1)).unionAll(b.withColumn("_w", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("_w").alias("excess")).where("excess <> 0")


def same_bag(a: DataFrame, b: DataFrame) -> bool:
    if a.columns != b.columns or a.dtypes != b.dtypes:
        return False
    return bag_difference(a, b).isEmpty()


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def project(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Explicit allow-list projection; a missing column is an error."""
    missing = [c for c in allowed if c not in df.columns]
    if missing:
        raise ValueError(f"columns not present: {missing}")
    return df.select(*allowed)


def drop_prefixed(df: DataFrame, prefixes: Sequence[str] = (), names: Sequence[str] = ()) -> DataFrame:
    """Projection for a reader who may not see some columns."""
    return df.select(*[c for c in df.columns if c not in names and not c.startswith(tuple(prefixes) or ("\0",))])


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` does not hold."""
    return a.select(key).where(F.col(key).isNotNull()).distinct().join(b.select(key), key, "left_anti")


def asof_backward(
    left: DataFrame, right: DataFrame, key: str, left_day: str, right_day: str, values: Sequence[str], lag_days: int = 0
) -> DataFrame:
    """For each left row the right values at the latest day <= left_day - lag_days of its key.

    Both sides are reduced to one row per (key, day) before they meet in one window, so the
    frame of a hot key is bounded by the calendar. A null key has no history.
    """
    latest = right.where(F.col(key).isNotNull()).groupBy(key, right_day).agg(
        *[F.max_by(v, F.struct(*[F.col(x) for x in values])).alias(v) for v in values]
    )
    history = latest.select(
        key, F.col(right_day).alias("_d"), F.lit(0).alias("_side"), F.struct(*values).alias("_v")
    )
    asked = (
        left.where(F.col(key).isNotNull())
        .select(key, F.col(left_day).alias("_asked"))
        .distinct()
        .select(
            key,
            (F.col("_asked") - F.lit(lag_days)).alias("_d"),
            F.lit(1).alias("_side"),
            F.lit(None).cast(history.schema["_v"].dataType).alias("_v"),
        )
    )
    w = Window.partitionBy(key).orderBy("_d", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        history.unionByName(asked)
        .withColumn("_hit", F.last("_v", ignorenulls=True).over(w))
        .where("_side = 1")
        .select(F.col(key), (F.col("_d") + F.lit(lag_days)).alias(left_day), F.col("_hit"))
    )
    return left.join(found, [key, left_day], "left").select(
        *left.columns, *[F.col(f"_hit.{v}").alias(v) for v in values]
    )


def modal_value(df: DataFrame, key: str, value: str, out: str = "mode") -> DataFrame:
    """Most frequent value per key, the smallest on ties; counted per (key, value) first."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(key).agg(
        F.min_by(F.col(value), F.struct((-F.col("_n")).alias("n"), F.col(value))).alias(out)
    )


def empty_like(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], T.StructType(df.schema.fields))
