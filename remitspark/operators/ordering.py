"""Positions, running totals, mid-ranks and exact quantiles over any number of rows.

A window without PARTITION BY moves every row to one task. Here the rows are range-partitioned
on the order columns (the last of which should make the order total, so one hot value is still
spread), the partitioned rows are pinned in the checkpoint folder, and each partition is offset
by the totals of the partitions before it. The offsets have one row per partition (and group).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash_long
from ..session import package_on_path, pin

_PART = "_part"
_LOCAL_MASK = (1 << 33) - 1  # monotonically_increasing_id keeps the row number in the low 33 bits


def _orders(order_by: Sequence[Column | str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order_by]


def _partitions(df: DataFrame, partitions: int | None) -> int:
    return partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def range_sorted(df: DataFrame, order_by: Sequence[Column | str], partitions: int | None = None) -> DataFrame:
    """Rows in global order across partitions, pinned, with ``_part`` naming the partition."""
    n = _partitions(df, partitions)
    keys = _orders(order_by)
    ordered = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return pin(ordered.withColumn(_PART, F.spark_partition_id()))


def with_position(
    df: DataFrame,
    order_by: Sequence[Column | str],
    name: str = "position",
    partitions: int | None = None,
    total: str | None = None,
    keep_part: bool = False,
) -> DataFrame:
    """Dense 1-based position of every row in the given order; ``total`` adds the row count.

    The row's place inside its partition comes with the sorted write itself, so no second
    shuffle is needed; only the partition offsets are joined back.
    """
    n = _partitions(df, partitions)
    keys = _orders(order_by)
    pinned = pin(
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
    ).withColumn(_PART, F.shiftright("_mid", 33))
    before = (
        pinned.groupBy(_PART)
        .agg(F.count(F.lit(1)).alias("_n"))
        .selectExpr(
            _PART,
            f"coalesce(sum(_n) over (order by {_PART} rows between unbounded preceding and 1 preceding), 0) as _before",
            "sum(_n) over () as _total",
        )
    )
    # one row per partition: the broadcast is bounded by the partition count
    return (
        pinned.join(F.broadcast(before), _PART)
        .selectExpr(
            *df.columns,
            f"(_mid & {_LOCAL_MASK}) + _before + 1 as {name}",
            *([f"_total as {total}"] if total else []),
            *([_PART] if keep_part else []),
        )
    )


def _sum_type(t: T.DataType) -> T.DataType:
    """The type in which Spark sums a column of type ``t``."""
    if isinstance(t, T.DecimalType):
        return T.DecimalType(min(38, t.precision + 10), t.scale)
    return T.DoubleType() if isinstance(t, (T.DoubleType, T.FloatType)) else T.LongType()


def _boundaries(columns: list[pa.Array], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Which rows differ in the given columns from the row before them, and the last row's values."""
    rows = len(columns[0]) if columns else 0
    new = np.zeros(rows, dtype=bool)
    for c in columns:
        ahead, behind = c.slice(1), c.slice(0, rows - 1)
        same = pc.fill_null(pc.equal(ahead, behind), False)
        both = pc.and_(pc.is_null(ahead), pc.is_null(behind))
        new[1:] |= ~pc.or_(same, both).to_numpy(zero_copy_only=False)
    first = tuple(c[0].as_py() for c in columns)
    new[0] = last is None or first != last
    return new, tuple(c[rows - 1].as_py() for c in columns)


def _cumulated(values: pa.Array, starts: np.ndarray, run: np.ndarray, carried):
    """Sums of ``values`` up to each row of its run; ``carried`` is what the first run has from earlier batches."""
    if pa.types.is_decimal(values.type):
        out, total, fresh = [], carried, set(starts.tolist())
        with localcontext() as exact:
            exact.prec = 80
            for i, v in enumerate(values.to_pylist()):
                total = (Decimal(0) if i in fresh else total) + (v or 0)
                out.append(total)
        return pa.array(out, values.type), total
    v = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
    if v.dtype.kind == "f":  # no difference of long sums: a run's sums begin at its own first row
        out = np.empty(len(v))
        edges = np.r_[0, starts[starts > 0], len(v)]
        for i, j in zip(edges[:-1], edges[1:]):
            np.cumsum(v[i:j], out=out[i:j])
        out[run == 0] += carried
    else:
        total = np.cumsum(v)
        base = np.r_[0, np.where(starts > 0, total[starts - 1], 0)]
        out = total - base[run]
        out[run == 0] += carried
    return pa.array(out), out[-1].item()


def sorted_pass(
    df: DataFrame,
    order_by: Sequence[Column | str],
    totals: Mapping[str, str],
    groups: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Number the rows of every group in the given order and sum columns up to each row, in one range exchange.

    Rows are range-partitioned and sorted by (groups, order); one pass over each sorted partition numbers and sums the runs of equal
    groups. Only the first run of a partition can have begun earlier: what came before it is found from at most two rows for
    each partition and added by a broadcast of one row for each. A group of a third of all rows is many partitions, and no second
    exchange of the rows follows. Null is a group. Returns the columns of ``df``, ``_number`` (from 1) and ``totals`` (name: column).
    """
    n = _partitions(df, partitions)
    keys = [*[F.col(g).asc_nulls_first() for g in groups], *_orders(order_by)]
    names, kinds = df.columns, {f.name: f.dataType for f in df.schema.fields}
    sums = {f"_sum_{i}": c for i, c in enumerate(totals.values())}
    typed = df.select("*", *[F.col(c).cast(_sum_type(kinds[c])).alias(f"{s}_in") for s, c in sums.items()])
    fields = [T.StructField(f.name, f.dataType) for f in df.schema.fields]
    fields += [T.StructField("_number", T.LongType()), *[T.StructField(s, _sum_type(kinds[c])) for s, c in sums.items()]]
    fields += [T.StructField("_border", T.IntegerType()), T.StructField("_begun", T.BooleanType())]
    at = [names.index(g) for g in groups]
    width = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, number, carried = None, None, 0, [0] * len(sums)
        begun, first_row = True, True
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                yield pa.RecordBatch.from_arrays(held[0], names=held[1])
            new, last = _boundaries([b.column(i) for i in at], last) if at else (np.zeros(b.num_rows, bool), last)
            if at and first_row:
                new[0] = False
            starts = np.flatnonzero(new)
            which = np.cumsum(new)
            count = np.arange(1, b.num_rows + 1)
            local = count - np.r_[0, starts][which]
            local[which == 0] += number
            columns = []
            for k in range(len(sums)):
                out, carried[k] = _cumulated(b.column(width + k), starts, which, carried[k] if not (len(starts) and starts[0] == 0) else 0)
                columns.append(out)
            border = np.zeros(b.num_rows, np.int32)
            border[0] += first_row  # 1: first row of its partition, 2: last row, 3: both
            held = ([*b.columns[:width], pa.array(local), *columns, pa.array(border), pa.array((which == 0) & begun)], [*names, "_number", *sums, "_border", "_begun"])
            number = int(local[-1])
            begun, first_row = begun and not len(starts), False
        if held is not None:
            border = held[0][-2].to_numpy(zero_copy_only=False).copy()
            border[-1] += 2
            held[0][-2] = pa.array(border)
            yield pa.RecordBatch.from_arrays(held[0], names=held[1])

    package_on_path(df.sparkSession)
    passed = typed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, T.StructType(fields))
    pinned = pin(passed.withColumn(_PART, F.spark_partition_id()))
    # what came before a partition's first run: the last runs of the same group in earlier partitions
    ends = pinned.where("_border >= 2").select(_PART, *groups, F.lit(1).alias("_end"), "_number", *sums)
    heads = pinned.where("_border in (1, 3)").select(_PART, *groups, F.lit(0).alias("_end"), F.lit(0).alias("_number"), *[F.lit(0).cast(_sum_type(kinds[c])).alias(s) for s, c in sums.items()])
    earlier = Window.partitionBy(*groups).orderBy(_PART, "_end").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.unionByName(heads).select(
        F.col(_PART).alias("_at"), "_end", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_b{i}") for i, c in enumerate(["_number", *sums])]
    ).where("_end = 0")
    joined = pinned.join(F.broadcast(before), (F.col(_PART) == F.col("_at")) & F.col("_begun"), "left")
    shifted = [(F.col(c) + F.coalesce(F.col(f"_b{i}"), F.lit(0))).alias(name) for i, (c, name) in enumerate(zip(["_number", *sums], ["_number", *totals]))]
    return joined.select(*names, *shifted)


def running_totals(
    df: DataFrame,
    order_by: Sequence[Column | str],
    totals: Mapping[str, Column],
    groups: Sequence[str] = (),
    partitions: int | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Cumulative sums in the given order, per group, however large a single group is.

    ``totals`` maps output names to the summed expression. The order must be total within a group (aggregate equal
    values first). One range exchange, see :func:`sorted_pass`.
    """
    named = {f"_v{i}": F.coalesce(e, F.lit(0)) for i, e in enumerate(totals.values())}
    summed = sorted_pass(df.select("*", *[e.alias(k) for k, e in named.items()]), order_by, {f"{k}_c": k for k in named}, groups, partitions)
    own = {k: F.lit(0) if inclusive else F.col(k) for k in named}
    return summed.select(*df.columns, *[(F.col(f"{k}_c") - own[k]).alias(name) for k, name in zip(named, totals)])


def number_in_group(
    df: DataFrame, group: Sequence[str], order_by: Sequence[Column | str], name: str, partitions: int | None = None
) -> DataFrame:
    """1..n inside each group (null is a group), however many rows one group holds; one range exchange."""
    return sorted_pass(df, order_by, {}, group, partitions).select(*df.columns, F.col("_number").alias(name))


def mid_ranks(df: DataFrame, value: str, partitions: int | None = None) -> DataFrame:
    """Average rank of every distinct value: (value, ties, mid_rank)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("ties"))
    ranked = running_totals(counts, [value], {"_upto": F.col("ties")}, partitions=partitions)
    return ranked.select(
        value, "ties", (F.col("_upto") - (F.col("ties") - F.lit(1)) / F.lit(2.0)).alias("mid_rank")
    )


def ntile_of(position: str, rows: str, tiles: int) -> str:
    """SQL text of the tile NTILE would give: the first ``rows mod tiles`` tiles hold one extra row."""
    size, extra = f"({rows} div {tiles})", f"({rows} % {tiles})"
    wide = f"({extra} * ({size} + 1))"
    return (
        f"cast(if({position} <= {wide}, ({position} - 1) div ({size} + 1) + 1, "
        f"{extra} + ({position} - 1 - {wide}) div greatest({size}, 1) + 1) as int)"
    )


def equal_count_bin(position: str, rows: str, bins: int) -> str:
    """SQL text of the 0-based quantile bin of a position: edges at (rows-1)*k/bins, right-closed.

    Integer arithmetic, so a position on an edge never moves by rounding.
    """
    top = f"({position} - 1) * {bins}"
    below = f"greatest({rows} - 1, 1)"
    return f"cast(greatest(({top} + {below} - 1) div {below} - 1, 0) as int)"


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    groups: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Exact interpolated quantiles as rows (groups…, probability, quantile).

    Equal values are merged into counts and put in order over range partitions. From the partition
    totals it is known which partitions hold a wanted order statistic; only the rows of those
    partitions are numbered, and no task ever holds all values of a group.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    pinned = range_sorted(counts, [value, *groups], partitions)
    keys = [_PART, *groups]
    part = f"partition by {', '.join(groups)} " if groups else ""
    per_part = pinned.groupBy(*keys).agg(F.expr("sum(_n) as _in")).selectExpr(
        *keys,
        "_in",
        f"sum(_in) over ({part}order by {_PART} rows between unbounded preceding and current row) - _in as _before",
        f"sum(_in) over ({part.strip()}) as _rows",
    )
    ps = ", ".join(f"{float(p)!r}D" for p in probabilities)
    neighbours = (
        f"flatten(transform(array({ps}), p -> transform("
        "array_distinct(array(floor((_rows - 1) * p), ceil((_rows - 1) * p))), "
        "r -> struct(p as probability, 1D - abs((_rows - 1) * p - r) as weight, r + 1 as rnk))))"
    )
    wanted = per_part.selectExpr(
        *keys, "_before", f"filter({neighbours}, t -> t.rnk > _before and t.rnk <= _before + _in) as _wanted"
    ).where("size(_wanted) > 0")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"v.{k}").eqNullSafe(F.col(f"w.{k}"))
    rows = pinned.alias("v").join(wanted.alias("w"), on).select("v.*", "_before", "_wanted")
    inside = f"partition by {', '.join(keys)} order by {value} rows between unbounded preceding and current row"
    covered = "filter(_wanted, t -> t.rnk > _upto - _n and t.rnk <= _upto)"
    hits = rows.selectExpr("*", f"_before + sum(_n) over ({inside}) as _upto").selectExpr(
        *groups, f"cast({value} as double) as _x", f"inline({covered})"
    )
    return hits.groupBy(*groups, "probability").agg(F.expr("sum(_x * weight) as quantile"))


def quantile_scalars(df: DataFrame, value: str, probabilities: Sequence[float]) -> dict[float, float]:
    """The quantiles as numbers on the driver (one per probability)."""
    rows = exact_quantiles(df, value, probabilities).collect()
    return {r["probability"]: r["quantile"] for r in rows}


def day_quantiles(df: DataFrame, day: str, probabilities: Sequence[float]) -> list[float]:
    """Exact quantiles of an integer day number.

    Days are merged into (day, rows) first, so the percentile state holds one entry per calendar
    day and is bounded by the calendar, not by the rows.
    """
    per_day = df.where(F.col(day).isNotNull()).groupBy(day).agg(F.count(F.lit(1)).alias("_n"))
    ps = F.array(*[F.lit(float(p)) for p in probabilities])
    row = per_day.agg(F.percentile(day, ps, F.col("_n")).alias("q")).first()
    return list(row["q"]) if row["q"] is not None else []


def top_fraction_flag(
    df: DataFrame,
    score: str,
    fraction: float,
    key: str,
    seed: int,
    name: str = "in_top",
    partitions: int | None = None,
) -> DataFrame:
    """Mark the top ``max(1, round(rows*fraction))`` rows by score; ties in seeded-hash order."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    shuffled = df.withColumn("_tie", hash_long(seed, key))
    placed = with_position(shuffled, [F.col(score).desc_nulls_last(), "_tie", key], "_pos", partitions, total="_n")
    cut = f"greatest(1, bround(_n * {fraction}D))"
    return placed.withColumn(name, F.expr(f"_pos <= {cut}")).drop("_tie", "_pos", "_n")
