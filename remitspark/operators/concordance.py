"""Harrell's concordance: two-dimensional dominance counting over two range sorts, no pair join.

Rows are merged to (time, censored, score) and sorted by that; events come before the censored rows of their day, and scores ascend
within a day. Then a pair is concordant exactly if the later of two rows has the smaller score: rows of one day and kind ascend, so
they never count. That is the number of inversions of a sequence, weighted by events (earlier row) times rows (later row), and it splits:

* both rows in one range of times: counted inside that range;
* in two ranges of times and one range of scores: counted inside the range of scores, between different ranges of times;
* in two ranges of both: from the counts of each (range of times, range of scores) alone.

The second sort is by (score, place in the first), so a score that a third of the rows has is many ranges too, and equal scores ascend.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import package_on_path, pin
from .ordering import range_sorted, running_totals

_WIDE = "decimal(38,0)"


def weighted_inversions(key: np.ndarray, early: np.ndarray, late: np.ndarray) -> int:
    """Sum of early[i] * late[j] over all i before j with key[j] < key[i], in n log n steps."""
    n = len(key)
    if n < 2:
        return 0
    order = np.argsort(key, kind="stable")  # equal keys keep their order: no inversion
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    big = float(early.sum(dtype=np.float64)) * float(late.sum(dtype=np.float64)) >= 2.0**62
    kind = object if big else np.int64
    early, late = early.astype(kind), late.astype(kind)
    total = 0
    # rows grouped by the upper bits of their rank, in sequence; two rows part at exactly one bit
    for bit in reversed(range(int(n - 1).bit_length())):
        upper = rank >> (bit + 1)
        at = np.argsort(upper, kind="stable")
        high = (rank[at] >> bit) & 1
        group = upper[at]
        seen = np.cumsum(np.where(high == 1, early[at], 0))
        first = np.r_[True, group[1:] != group[:-1]]
        before = np.where(first, np.r_[0, seen[:-1]], 0)
        start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        inside = seen - before[start]
        total += int(np.sum(np.where(high == 0, inside * late[at], 0)))
    return total


def _inside(parts: DataFrame, key: str, early: str, late: str) -> DataFrame:
    """One row for each written partition: the weighted inversions of ``key`` in its order."""
    package_on_path(parts.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if held:
            f = pd.concat(held, ignore_index=True)
            found = weighted_inversions(f["key"].to_numpy(), f["early"].to_numpy(), f["late"].to_numpy())
            yield pd.DataFrame({"pairs": [str(found)]})

    return parts.select(F.col(key).alias("key"), F.col(early).alias("early"), F.col(late).alias("late")).mapInPandas(run, "pairs string")


def _between(cells: DataFrame) -> DataFrame:
    """Pairs of rows in different ranges of both orders, from the cells' counts (one row for each cell, ranges squared at most)."""
    times, scores = cells.select("p").distinct(), cells.agg(F.sort_array(F.collect_set("b")).alias("bs"))
    grid = times.withColumn("b", F.explode(scores.scalar()))
    full = grid.join(cells, ["p", "b"], "left").fillna(0)
    later = Window.partitionBy("b").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy("p").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    after = full.withColumn("after", F.coalesce(F.sum(F.col("rows").cast(_WIDE)).over(later), F.lit(0)))
    below = after.withColumn("below", F.coalesce(F.sum("after").over(lower), F.lit(0)))
    return below.select((F.col("events").cast("decimal(19,0)") * F.col("below").cast("decimal(19,0)")).cast("string").alias("pairs"))


def concordance(df: DataFrame, dur: str, event: str, score: str, partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """One row: comparable, concordant and tied pairs, and the index (concordant + tied / 2) / comparable.

    A pair is comparable if the earlier row is an event, or if of two rows of one time exactly one is. It is concordant if the
    earlier one has the larger score. Rows with a null time, event or score take no part; without comparable pairs the index
    is null. ``weight`` names a column that tells how many equal rows a row stands for.
    """
    rows = df.selectExpr(f"cast({dur} as double) as t", f"cast({event} as int) as e", f"cast({score} as double) as s", f"cast({weight or '1'} as bigint) as n").where("t is not null and e is not null and s is not null")
    merged = rows.groupBy("t", F.expr("1 - e").alias("c"), "s").agg(F.sum("n").alias("rows")).withColumn("events", F.expr("if(c = 0, rows, 0L)"))
    by_time = range_sorted(merged, ["t", "c", "s"], partitions).withColumnRenamed("_part", "p")
    placed = by_time.withColumn("at", F.monotonically_increasing_id())
    by_score = range_sorted(placed, ["s", "at"], partitions).withColumnRenamed("_part", "b")
    one = _inside(by_time, "s", "events", "rows")
    two = _inside(by_score, "p", "rows", "events")
    cells = pin(by_score.groupBy("p", "b").agg(F.sum("rows").alias("rows"), F.sum("events").alias("events")))
    pairs = one.unionByName(two).unionByName(_between(cells)).agg(F.sum(F.col("pairs").cast(_WIDE)).alias("concordant"))

    after = "cast(cast({w} as decimal(19,0)) * cast({n} as decimal(19,0)) as decimal(38,0))"
    groups = merged.groupBy("t", "c").agg(F.sum("rows").alias("rows"), F.sum("events").alias("events"))
    later = running_totals(groups, [F.col("t").desc(), F.col("c").desc()], {"later": F.col("rows")}, inclusive=False, partitions=partitions)
    comparable = later.agg(F.expr(f"sum({after.format(w='events', n='later')}) as comparable"))
    same = running_totals(merged, [F.col("t").desc(), F.col("c").desc()], {"later": F.col("rows")}, ["s"], inclusive=False, partitions=partitions)
    tied = same.agg(F.expr(f"sum({after.format(w='events', n='later')}) as tied"))
    out = comparable.withColumn("concordant", pairs.scalar()).withColumn("tied", tied.scalar())
    return out.selectExpr(
        "coalesce(cast(comparable as double), 0D) as comparable", "coalesce(cast(concordant as double), 0D) as concordant", "coalesce(cast(tied as double), 0D) as tied",
        "if(comparable > 0, (cast(concordant as double) + cast(tied as double) / 2D) / cast(comparable as double), null) as concordance",
    )
