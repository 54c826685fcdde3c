"""Classifier evaluation on scored rows: ranking metrics, calibration, thresholds, bootstrap.

All ranking metrics work on rows merged to distinct scores, with running totals over score order
that are spread over range partitions; nothing sorts all rows in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_long
from ..functions.inline import values_frame
from ..session import pin
from .ordering import (
    _PART,
    equal_count_bin,
    quantile_scalars,
    range_sorted,
    running_totals,
    top_fraction_flag,
    with_position,
)


def score_counts(df: DataFrame, y: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Rows merged to (groups…, score): n rows, pos positives."""
    return df.where(F.col(score).isNotNull()).groupBy(*groups, score).agg(
        F.expr("count(1) as n"), F.expr(f"sum(cast({y} as bigint)) as pos")
    )


def counts_above(counts: DataFrame, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Score counts with the rows and positives at all higher scores."""
    return running_totals(
        counts,
        [F.col(score).desc(), *groups],
        {"n_above": F.col("n"), "pos_above": F.col("pos")},
        groups,
        inclusive=False,
    )


def ranking_metrics(df: DataFrame, y: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups…, n, positives, base_rate, mean_predicted, roc_auc, pr_auc, brier, pr_auc_lift).

    ROC-AUC counts tied pairs half; PR-AUC is average precision with one step per distinct score.
    Both are null where a group has only one class.
    """
    return metrics_from_counts(score_counts(df, y, score, groups), score, groups)


def metrics_from_counts(counts: DataFrame, score: str, groups: Sequence[str] = ()) -> DataFrame:
    sums = counts_above(counts, score, groups).groupBy(*groups).agg(
        F.expr("sum(n) as n"),
        F.expr("sum(pos) as positives"),
        # twice the won pairs, as an exact integer
        F.expr("sum(cast(n - pos as decimal(18,0)) * cast(2 * pos_above + pos as decimal(19,0))) as doubled_wins"),
        F.expr("sum(if(pos > 0, pos * (cast(pos_above + pos as double) / (n_above + n)), 0D)) as ap_sum"),
        F.expr(f"sum(pos * power({score} - 1D, 2) + (n - pos) * power({score}, 2)) as sq"),
        F.expr(f"sum(n * {score}) as score_sum"),
    )
    both = "positives > 0 and positives < n"
    return sums.selectExpr(
        *groups,
        "n",
        "positives",
        "positives / n as base_rate",
        "score_sum / n as mean_predicted",
        f"if({both}, cast(doubled_wins as double) / (2D * positives * (n - positives)), null) as roc_auc",
        f"if({both}, ap_sum / positives, null) as pr_auc",
        "sq / n as brier",
        f"if({both}, ap_sum / positives / (positives / n), null) as pr_auc_lift",
    )


def slice_metrics(df: DataFrame, y: str, score: str, by: str, min_positives: int = 20) -> DataFrame:
    """Ranking metrics per slice in one job; too thin slices keep volumes but get no ranking metric."""
    rows = df.where(F.col(by).isNotNull()).withColumn("slice", F.col(by).cast("string"))
    m = ranking_metrics(rows, y, score, ["slice"])
    thin = f"not (positives >= {min_positives} and positives < n)"
    return m.selectExpr(
        "slice", "n", "positives", "base_rate", "mean_predicted",
        f"if({thin}, null, roc_auc) as roc_auc", f"if({thin}, null, pr_auc) as pr_auc", "brier",
        f"{thin} as too_thin_to_score",
    )


def dollars_captured(
    df: DataFrame, y: str, score: str, amount: str, key: str, fraction: float = 0.10, seed: int = 1337
) -> DataFrame:
    """Share of positive dollars in the top fraction by score: (rows, worked, captured, total, share)."""
    flagged = top_fraction_flag(df.select(key, y, score, amount), score, fraction, key, seed)
    positive = f"if(cast({y} as int) = 1, {amount}, 0)"
    return flagged.agg(
        F.expr("count(1) as row_count"),
        F.expr("count_if(in_top) as worked"),
        F.expr(f"coalesce(sum(if(in_top, {positive}, 0)), 0) as captured"),
        F.expr(f"coalesce(sum({positive}), 0) as total"),
    ).selectExpr("*", "if(total > 0, cast(captured as double) / cast(total as double), null) as share")


def calibration_bins(df: DataFrame, y: str, score: str, key: str, bins: int = 10) -> DataFrame:
    """Equal-count bins in score order (ties by key): (bin, n, mean_predicted, observed_rate, gap)."""
    placed = with_position(df.select(key, y, score), [score, key], "_pos", total="_n")
    return (
        placed.selectExpr(y, score, f"{equal_count_bin('_pos', '_n', bins)} as bin")
        .groupBy("bin")
        .agg(
            F.expr("count(1) as n"),
            F.expr(f"avg({score}) as mean_predicted"),
            F.expr(f"avg(cast({y} as double)) as observed_rate"),
        )
        .selectExpr("*", "mean_predicted - observed_rate as gap")
    )


def calibration_error(bins: DataFrame) -> DataFrame:
    """Count-weighted mean absolute gap, one row."""
    return bins.agg(F.expr("sum(n * abs(gap)) / sum(n) as ece"))


# ---------------------------------------------------------------- thresholds


def _per_score(df: DataFrame, y: str, score: str, amount: str) -> DataFrame:
    per = df.where(F.col(score).isNotNull()).groupBy(score).agg(
        F.expr("count(1) as n"),
        F.expr(f"sum(cast({y} as bigint)) as pos"),
        F.expr(f"coalesce(sum(if(cast({y} as int) = 1, {amount}, 0)), 0) as dollars"),
    )
    return running_totals(
        per,
        [F.col(score).desc()],
        {"flagged": F.col("n"), "caught": F.col("pos"), "caught_dollars": F.col("dollars")},
    )


def threshold_grid(df: DataFrame, y: str, score: str, amount: str, candidates: int = 200) -> DataFrame:
    """What each candidate score quantile would flag: (threshold, flagged, caught, caught_dollars, row_count, positives).

    Each distinct score finds the highest candidate at or below it by binary search; of the scores
    of one candidate the lowest one flags the most. The last steps run over the candidates only.
    """
    df = pin(df.select(y, score, amount))
    grid = sorted(set(quantile_scalars(df, score, [i / (candidates - 1) for i in range(candidates)]).values()))
    per = _per_score(df, y, score, amount).withColumn("_s", F.col(score).cast("double"))
    met = Bucketizer(splits=[float("-inf"), *grid, float("inf")], inputCol="_s", outputCol="_k").transform(per)
    lowest = met.groupBy(F.expr("cast(_k as int) as _i")).agg(
        F.expr("max(struct(flagged, caught, caught_dollars)) as a")
    )
    spine = values_frame(df.sparkSession, [(i, g) for i, g in enumerate(grid, start=1)], "_i int, threshold double")
    totals = df.where(F.col(score).isNotNull()).agg(
        F.expr("count(1) as row_count"), F.expr(f"sum(cast({y} as bigint)) as positives")
    )
    # a candidate no score falls on is answered by the next one that has scores
    answered = spine.join(lowest, "_i", "left").selectExpr(
        "threshold", "max(a) over (order by _i desc rows between unbounded preceding and current row) as a"
    )
    return answered.selectExpr("threshold", "a.*").select(
        "*", totals.select("row_count").scalar().alias("row_count"), totals.select("positives").scalar().alias("positives")
    )


_CHOICE = (
    "threshold",
    "net_benefit",
    "flagged",
    "flagged / row_count as flagged_share",
    "caught",
    "caught / greatest(1, positives) as recall",
    "caught / greatest(1, flagged) as precision",
)


def cost_threshold(grid: DataFrame, review_cost: float, multiplier: float = 1.0) -> DataFrame:
    """The threshold with the largest net benefit; the lowest one on ties."""
    benefit = f"{multiplier}D * cast(caught_dollars as double) - {review_cost}D * flagged"
    best = grid.selectExpr("*", f"{benefit} as net_benefit").agg(
        F.expr(
            "max_by(struct(threshold, net_benefit, flagged, caught, row_count, positives), "
            "struct(net_benefit, -threshold)) as b"
        )
    )
    return best.selectExpr("b.*").selectExpr(*_CHOICE)


def multiplier_sweep(grid: DataFrame, review_cost: float, multipliers: Sequence[float]) -> DataFrame:
    """The cost-optimal threshold for each multiplier, all in one aggregation."""
    options = ", ".join(f"{float(x)}D" for x in multipliers)
    rows = grid.selectExpr("*", f"explode(array({options})) as multiplier").selectExpr(
        "*", f"multiplier * cast(caught_dollars as double) - {review_cost}D * flagged as net_benefit"
    )
    best = rows.groupBy("multiplier").agg(
        F.expr(
            "max_by(struct(threshold, net_benefit, flagged, caught, row_count, positives), "
            "struct(net_benefit, -threshold)) as b"
        )
    )
    return best.selectExpr("multiplier", "b.*").selectExpr("multiplier", *_CHOICE)


def apply_threshold(
    df: DataFrame, y: str, score: str, amount: str, threshold: float, review_cost: float, multiplier: float = 1.0
) -> DataFrame:
    """Re-measure a threshold chosen elsewhere: one aggregation."""
    hit = f"{score} >= {float(threshold)!r}D"
    sums = df.agg(
        F.expr(f"count_if({hit}) as flagged"),
        F.expr(f"count_if({hit} and cast({y} as int) = 1) as caught"),
        F.expr(f"coalesce(sum(if({hit} and cast({y} as int) = 1, {amount}, 0)), 0) as caught_dollars"),
        F.expr("count(1) as row_count"),
        F.expr(f"sum(cast({y} as bigint)) as positives"),
    )
    return sums.selectExpr(
        "*",
        f"{float(threshold)!r}D as threshold",
        f"{multiplier}D * cast(caught_dollars as double) - {review_cost}D * flagged as net_benefit",
    ).selectExpr(*_CHOICE)


def capacity_threshold(df: DataFrame, score: str, share: float) -> float:
    """The score quantile that leaves ``share`` of the rows at or above it."""
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    return next(iter(quantile_scalars(df, score, [1.0 - share]).values()))


def value_multiplier(*factors: float) -> float:
    """The product of the named factors of the cost matrix."""
    return float(np.prod(factors))


def break_even(df: DataFrame, y: str, amount: str, review_cost: float) -> DataFrame:
    """Multiplier at which reviewing an average row stops paying: cost / (rate * mean amount)."""
    return df.agg(
        F.expr(f"avg(cast({y} as double)) as rate"), F.expr(f"cast(avg({amount}) as double) as mean_amount")
    ).selectExpr("*", f"{review_cost}D / nullif(rate * mean_amount, 0D) as break_even_multiplier")


def concentration(df: DataFrame, amount: str, k: int = 10) -> DataFrame:
    """(top_k, total, share): part of all dollars held by the k largest rows."""
    top = df.select(F.col(amount).alias("a")).orderBy(F.col("a").desc_nulls_last()).limit(k).agg(F.expr("sum(a) as s"))
    return (
        df.agg(F.expr(f"sum({amount}) as total"))
        .withColumn("top_k", top.scalar())
        .selectExpr("cast(top_k as double) as top_k", "cast(total as double) as total",
                    "cast(top_k as double) / nullif(cast(total as double), 0D) as share")
    )


# ---------------------------------------------------------------- bootstrap


def value_bands(fit: DataFrame, rows: DataFrame, value: str, probabilities: Sequence[float], out: str = "value_band") -> DataFrame:
    """Bands learned on the fit rows and applied to all rows; outer edges open, equal edges merged."""
    edges = sorted(set(quantile_scalars(fit, value, probabilities).values()))
    inner = edges[1:-1]
    whens = " ".join(f"when {value} <= {e!r}D then {i}" for i, e in enumerate(inner))
    sql = f"case when {value} is null then null {whens} else {len(inner)} end"
    return rows.withColumn(out, F.expr(sql))


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# P(X <= k) for a Poisson(1) count, k = 0..9
_POISSON_CDF = np.cumsum(np.exp(-1.0) / np.array([1.0, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880]))


def resample_weights(keys: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """Poisson(1) weights (rows x resamples) that depend only on key, resample and seed.

    The same row gets the same weight in every ranking and on every retry, which is what makes
    differences paired and reruns equal.
    """
    base = _mix(keys.astype(np.int64).view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
    with np.errstate(over="ignore"):
        salt = _mix((np.arange(1, resamples + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
    u = (_mix(base[:, None] ^ salt[None, :]) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.searchsorted(_POISSON_CDF, u, side="right").astype(np.float64)


def _resampled_segments(pinned: DataFrame, resamples: int, seed: int) -> DataFrame:
    """Per partition and resample: the lowest score, the highest score and all between.

    Batches arrive in score order, so only running weights and the open tie are carried. The two
    outer scores are reported on their own because their ties may go on in the next partition.
    Output is at most three rows per partition and resample.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = open_tie = None
        mid = [np.zeros(resamples) for _ in range(3)]  # positives, negatives, won pairs
        low = high = None
        for b in batches:
            if b.empty:
                continue
            w = resample_weights(b["k"].to_numpy(), resamples, seed)
            s, y = b["s"].to_numpy(), b["y"].to_numpy().astype(float)
            edges = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            pos = np.add.reduceat(w * y[:, None], edges, axis=0)
            neg = np.add.reduceat(w * (1.0 - y)[:, None], edges, axis=0)
            value = s[edges]
            if open_tie is not None:
                if open_tie[0] == value[0]:
                    pos[0] += open_tie[1]
                    neg[0] += open_tie[2]
                else:
                    value = np.r_[open_tie[0], value]
                    pos, neg = np.vstack([open_tie[1], pos]), np.vstack([open_tie[2], neg])
            open_tie = (value[-1], pos[-1], neg[-1])
            value, pos, neg = value[:-1], pos[:-1], neg[:-1]
            if len(value) and first is None:
                first = (value[0], pos[0], neg[0])
                value, pos, neg = value[1:], pos[1:], neg[1:]
            if len(value):
                below = mid[1] + np.cumsum(neg, axis=0) - neg
                mid[2] += (pos * (below + neg / 2)).sum(axis=0)
                mid[0] += pos.sum(axis=0)
                mid[1] += neg.sum(axis=0)
        if open_tie is None:
            return
        b = np.arange(resamples)
        zero = np.zeros(resamples)
        if first is not None:
            low, high = first[0], open_tie[0]
            yield pd.DataFrame({"b": b, "lo": low, "hi": low, "pos": first[1], "neg": first[2], "wins": zero})
            yield pd.DataFrame({"b": b, "lo": low, "hi": high, "pos": mid[0], "neg": mid[1], "wins": mid[2]})
        yield pd.DataFrame(
            {"b": b, "lo": open_tie[0], "hi": open_tie[0], "pos": open_tie[1], "neg": open_tie[2], "wins": zero}
        )

    return pinned.mapInPandas(run, "b int, lo double, hi double, pos double, neg double, wins double")


def bootstrap_auc(
    df: DataFrame, y: str, score: str, key: str, resamples: int = 200, seed: int = 1337
) -> DataFrame:
    """ROC-AUC of every Poisson resample: (b, auc); resamples with one class only are left out.

    Rows are range-partitioned once by (score, row key), so a score on a third of the rows is still
    many tasks; no row is ever repeated per resample. The segments of all partitions are then
    put in order per resample (partitions x resamples x 3 numbers) to add the pairs across them.
    """
    rows = df.where(F.col(score).isNotNull()).select(
        F.col(score).cast("double").alias("s"), F.col(y).cast("int").alias("y"), F.xxhash64(key).alias("k")
    )
    pinned = range_sorted(rows, ["s", "k"])
    segments = _resampled_segments(pinned, resamples, seed).groupBy("b", "lo", "hi").agg(
        F.expr("sum(pos) as pos"), F.expr("sum(neg) as neg"), F.expr("sum(wins) as inside")
    )
    below = (
        "coalesce(sum(neg) over (partition by b order by lo, hi rows between unbounded preceding and 1 preceding), 0D)"
    )
    per_b = segments.selectExpr(
        "b", "pos", "neg", f"if(lo = hi, pos * neg / 2, inside) + pos * {below} as wins"
    ).groupBy("b").agg(F.expr("sum(wins) as w"), F.expr("sum(pos) as p"), F.expr("sum(neg) as n"))
    return per_b.where("p > 0 and n > 0").selectExpr("b", "w / (p * n) as auc")


def interval(draws: DataFrame, value: str, alpha: float = 0.05) -> DataFrame:
    """(low, high, draws) percentile interval over resample values (at most one row per resample)."""
    return draws.agg(
        F.expr(f"percentile({value}, {alpha / 2}D) as low"),
        F.expr(f"percentile({value}, {1 - alpha / 2}D) as high"),
        F.expr("count(1) as draws"),
    )


def paired_auc_difference(
    df: DataFrame, y: str, score_a: str, score_b: str, key: str, resamples: int = 200, seed: int = 1337, alpha: float = 0.05,
    draws_a: DataFrame | None = None,
) -> DataFrame:
    """(point, low, high, draws) of auc(a) - auc(b) over the same resampled rows.

    ``draws_a``: what ``bootstrap_auc`` gave for ``score_a`` with the same resamples and seed, if it was worked out before.
    """
    a = (bootstrap_auc(df, y, score_a, key, resamples, seed) if draws_a is None else draws_a).withColumnRenamed("auc", "auc_a")
    b = bootstrap_auc(df, y, score_b, key, resamples, seed).withColumnRenamed("auc", "auc_b")
    point = ranking_metrics(df, y, score_a).selectExpr("roc_auc as a").withColumn(
        "b", ranking_metrics(df, y, score_b).select("roc_auc").scalar()
    ).selectExpr("a - b as point")
    draws = a.join(b, "b").selectExpr("auc_a - auc_b as d")
    return interval(draws, "d", alpha).withColumn("point", point.scalar())


def capture_resamples(
    df: DataFrame, score: str, dollars: str, key: str, fraction: float, resamples: int = 200, seed: int = 1337
) -> DataFrame:
    """(b, share): dollars in the top fraction of every resample's weight, ties in seeded-hash order.

    A first pass gives each partition's resample weights; with the weight above each partition
    known, a second pass adds the dollars of rows still inside the cut.
    """
    rows = df.select(
        F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))).alias("s"),
        F.coalesce(F.col(dollars).cast("double"), F.lit(0.0)).alias("d"),
        F.xxhash64(key).alias("k"),
        hash_long(seed, key).alias("h"),
    )
    pinned = range_sorted(rows, [F.col("s").desc(), "h", "k"])

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, money, part = np.zeros(resamples), np.zeros(resamples), None
        for b in batches:
            if b.empty:
                continue
            part = int(b[_PART].iloc[0])
            w = resample_weights(b["k"].to_numpy(), resamples, seed)
            total += w.sum(axis=0)
            money += b["d"].to_numpy() @ w
        if part is not None:
            yield pd.DataFrame({"part": part, "b": np.arange(resamples), "w": total, "d": money})

    # partitions x resamples numbers: bounded by the configuration, not by the rows
    totals = pinned.mapInPandas(weigh, "part int, b int, w double, d double").toPandas()
    parts = sorted(totals["part"].unique())
    grid = totals.pivot(index="part", columns="b", values="w").to_numpy()
    above = {p: row for p, row in zip(parts, np.vstack([np.zeros(grid.shape[1]), np.cumsum(grid, axis=0)[:-1]]))}
    cut = np.maximum(1.0, np.rint(grid.sum(axis=0) * fraction))
    money = totals.groupby("b")["d"].sum().to_numpy()

    def capture(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got, run, part = np.zeros(resamples), None, None
        for b in batches:
            if b.empty:
                continue
            part = int(b[_PART].iloc[0])
            if run is None:
                run = above[part].copy()
            w = resample_weights(b["k"].to_numpy(), resamples, seed)
            before = run + np.cumsum(w, axis=0) - w
            inside = np.clip(cut - before, 0.0, w)
            got += b["d"].to_numpy() @ inside
            run = run + w.sum(axis=0)
        if part is not None:
            yield pd.DataFrame({"b": np.arange(resamples), "got": got})

    captured = pinned.mapInPandas(capture, "b int, got double").groupBy("b").agg(F.expr("sum(got) as got"))
    whole = values_frame(
        df.sparkSession, [(int(i), float(v)) for i, v in enumerate(money)], "b int, total double"
    )
    return captured.join(whole, "b").where("total > 0").selectExpr("b", "got / total as share")


def paired_capture_difference(
    df: DataFrame, score_a: str, score_b: str, dollars: str, key: str, fraction: float,
    resamples: int = 200, seed: int = 1337, alpha: float = 0.05,
) -> DataFrame:
    """(low, high, draws) of capture(a) - capture(b) over the same resampled rows."""
    a = capture_resamples(df, score_a, dollars, key, fraction, resamples, seed).withColumnRenamed("share", "a")
    b = capture_resamples(df, score_b, dollars, key, fraction, resamples, seed).withColumnRenamed("share", "bb")
    return interval(a.join(b, "b").selectExpr("a - bb as d"), "d", alpha)
