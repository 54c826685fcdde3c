"""Paired intervals of ranking rules: what each rule captures within a capacity, on the same resampled rows.

Rows are not repeated. A row's weight in a resample is a Poisson draw from a hash of (row, resample) in whole numbers, so any engine
draws the same. All rules are put in order by one range sort. A first pass gives each range's weight and money by rule and resample;
from these it is known in which one range a rule's capacity ends in a resample, and only there rows are weighed once more.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping, Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_long
from ..functions.inline import literal, values_frame
from ..session import package_on_path, pin
from .ordering import range_sorted

#: Rows are hashed into 0 .. PRIME - 1 and from there, anew for each resample, by an affine map.
PRIME = (1 << 31) - 1
#: Thresholds of the Poisson(1) distribution function, in steps of 1 / PRIME; a weight is the number of thresholds reached.
POISSON = [math.floor(PRIME * p) for p in accumulate(math.exp(-1) / math.factorial(k) for k in range(12)) if math.floor(PRIME * p) < PRIME]


def resample_maps(resamples: int, seed: int) -> list[tuple[int, int]]:
    """Factor and shift of each resample's map."""
    out = []
    for b in range(resamples):
        digest = hashlib.md5(f"{seed}|resample {b}".encode()).digest()
        out.append((int.from_bytes(digest[:8], "big") % (PRIME - 1) + 1, int.from_bytes(digest[8:], "big") % PRIME))
    return out


def resample_weights(row: np.ndarray, maps: list[tuple[int, int]]) -> np.ndarray:
    """Weights of rows (hashes below PRIME) in all resamples; a last column of ones stands for the rows as they are."""
    a, c = (np.array(x, dtype=np.int64) for x in zip(*maps))
    drawn = (row[:, None] * a[None, :] + c[None, :]) % PRIME
    weights = np.searchsorted(np.array(POISSON), drawn, side="right")
    return np.hstack([weights, np.ones((len(row), 1), weights.dtype)])


def captured(
    df: DataFrame, key: str, rules: Mapping[str, str], dollars: str, share: float, resamples: int = 200, seed: int = 1337, partitions: int | None = None
) -> DataFrame:
    """(rule, resample, captured, total): money in the top ``share`` of each resample's weight, by every rule; resample -1 is the rows
    as they are. Ties are broken by one hash for all rules, null scores come last, null money counts as none."""
    spark = df.sparkSession
    package_on_path(spark)
    maps = resample_maps(resamples, seed)
    width = resamples + 1
    items = ", ".join(f"struct({literal(n)} as rule, cast({sql} as double) as score)" for n, sql in rules.items())
    long = df.selectExpr(f"{key} as key", f"cast(coalesce({dollars}, 0) as double) as money", f"inline(array({items}))").withColumn("tie", hash_long(seed, "key"))
    sorted_rows = range_sorted(long, ["rule", F.col("score").desc_nulls_last(), "tie", "key"], partitions)
    rows = sorted_rows.selectExpr("_part as part", "rule", "money", f"tie % {PRIME} as row")

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for frame in batches:
            for (part, rule), f in frame.groupby(["part", "rule"], sort=False):
                w = resample_weights(f["row"].to_numpy(), maps)
                sums.setdefault((part, rule), np.zeros((2, width)))
                sums[part, rule] += np.vstack([w.sum(axis=0), f["money"].to_numpy() @ w])
        for (part, rule), s in sums.items():
            yield pd.DataFrame({"part": part, "rule": rule, "b": np.r_[np.arange(resamples), -1], "w": s[0], "money": s[1]})

    parts = pin(rows.mapInPandas(weigh, "part int, rule string, b int, w double, money double"))
    each = Window.partitionBy("rule", "b")
    earlier = each.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.select("*", F.coalesce(F.sum("w").over(earlier), F.lit(0.0)).alias("before"), F.sum("w").over(each).alias("all_w"))
    placed = pin(placed.withColumn("cut", F.expr(f"if(all_w > 0, greatest(1D, bround(all_w * {share}D)), 0D)")))
    # each rule and resample ends in one range: rules x resamples numbers, whatever the rows
    last = placed.where("before < cut and before + w > cut").select("part", "rule", "b", (F.col("cut") - F.col("before")).alias("room")).collect()
    room: dict[tuple, np.ndarray] = {}
    for r in last:
        room.setdefault((r["part"], r["rule"]), np.zeros(width))[r["b"]] = r["room"]

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = {k: v.copy() for k, v in room.items()}
        got: dict[str, np.ndarray] = {}
        for frame in batches:
            for (part, rule), f in frame.groupby(["part", "rule"], sort=False):
                if (part, rule) in left:
                    w = resample_weights(f["row"].to_numpy(), maps)
                    before = np.cumsum(w, axis=0) - w
                    taken = np.clip(left[part, rule][None, :] - before, 0, w)
                    got[rule] = got.get(rule, 0) + f["money"].to_numpy() @ taken
                    left[part, rule] = np.maximum(left[part, rule] - w.sum(axis=0), 0)
        for rule, g in got.items():
            yield pd.DataFrame({"rule": rule, "b": np.r_[np.arange(resamples), -1], "got": g})

    partly = rows.mapInPandas(inside, "rule string, b int, got double")
    whole = placed.selectExpr("rule", "b", "if(before + w <= cut, money, 0D) as got", "money")
    both = whole.unionByName(partly.selectExpr("rule", "b", "got", "0D as money"))
    return both.groupBy("rule", F.col("b").alias("resample")).agg(F.sum("got").alias("captured"), F.sum("money").alias("total"))


def rule_differences(
    df: DataFrame, key: str, rules: Mapping[str, str], pairs: Sequence[tuple[str, str]], dollars: str, share: float,
    resamples: int = 200, seed: int = 1337, alpha: float = 0.05, partitions: int | None = None,
) -> DataFrame:
    """(difference, point, low, high, draws): share captured by the first rule minus that by the second, on the same resampled rows.

    An interval that spans zero says that the first rule adds nothing. Without money there is no share: point and interval are null.
    """
    shares = captured(df, key, rules, dollars, share, resamples, seed, partitions).selectExpr("rule", "resample", "if(total > 0, captured / total, null) as share")
    wide = pin(shares.groupBy("resample").pivot("rule", list(rules)).agg(F.first("share")))
    wanted = values_frame(df.sparkSession, [(f"{a}_minus_{b}", a, b) for a, b in pairs], "difference string, a string, b string")
    cells = ", ".join(f"struct({literal(f'{a}_minus_{b}')} as difference, `{a}` - `{b}` as d)" for a, b in pairs)
    draws = wide.selectExpr("resample", f"inline(array({cells}))").groupBy("difference").agg(
        F.expr("max(if(resample = -1, d, null)) as point"),
        F.expr(f"percentile(if(resample >= 0, d, null), {alpha / 2}D) as low"),
        F.expr(f"percentile(if(resample >= 0, d, null), {1 - alpha / 2}D) as high"),
        F.expr("cast(count(if(resample >= 0, d, null)) as int) as draws"),
    )
    return wanted.join(draws, "difference", "left").selectExpr("difference", "point", "low", "high", "coalesce(draws, 0) as draws")
