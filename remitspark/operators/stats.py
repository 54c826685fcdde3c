"""Tests, standardisation and regression over grouped sums."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import poisson_tail
from ..functions.tails import chi2_tail, normal_two_sided
from .ordering import exact_quantiles, mid_ranks


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency counts in long form: (a, b, n)."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.expr("count(1) as n"))


def chi_square(df: DataFrame, a: str, b: str, yates: bool = True) -> DataFrame:
    """(chi2, dof, n, cramers_v, p_value) of independence, from the contingency counts only.

    Empty cells count: sum over all cells of (o-e)^2/e equals sum over filled cells of o^2/e, minus n.
    ``yates`` applies the continuity correction to a 2x2 table. Cramer's V is bias-corrected.
    """
    cells = crosstab(df, a, b).selectExpr(
        "n",
        f"sum(n) over (partition by {a}) as ra",
        f"sum(n) over (partition by {b}) as rb",
        f"count(1) over (partition by {a}) as na",
        f"count(1) over (partition by {b}) as nb",
        "sum(n) over () as total",
        a,
        b,
    )
    sums = cells.agg(
        F.expr("cast(max(total) as double) as n"),
        F.expr(f"count(distinct {a}) as r"),
        F.expr(f"count(distinct {b}) as k"),
        F.expr("sum(cast(n as double) * n / (cast(ra as double) * rb)) as q"),
        # in a 2x2 table all four |o-e| are equal, and the sum of 1/e is n * sum(1/row) * sum(1/column): empty cells need no row
        F.expr("power(max(greatest(abs(n - cast(ra as double) * rb / total) - 0.5D, 0D)), 2) * cast(max(total) as double) "
               "* sum(1D / (cast(ra as double) * na)) * sum(1D / (cast(rb as double) * nb)) as corrected"),
    )
    plain = "n * (q - 1D)"
    stat = f"if({str(yates).lower()} and r = 2 and k = 2, corrected, {plain})"
    out = sums.selectExpr(f"{stat} as chi2", "(r - 1) * (k - 1) as dof", "n", "r", "k").selectExpr(
        "*",
        "greatest(0D, chi2 / n - (k - 1) * (r - 1) / (n - 1)) as _phi",
        "least(k - power(k - 1, 2) / (n - 1), r - power(r - 1, 2) / (n - 1)) - 1 as _room",
    )
    return out.selectExpr(
        "chi2", "dof", "n", "if(_room > 0, sqrt(_phi / _room), null) as cramers_v"
    ).withColumn("p_value", chi2_tail("chi2", F.col("dof").cast("double")))


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """(h, dof, n, p_value) with tie correction. Ranks are worked out over distinct values."""
    rows = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    per = rows.groupBy(group, value).agg(F.expr("count(1) as c"))
    ranks = mid_ranks(rows, value)
    by_group = per.join(ranks, value).groupBy(group).agg(
        F.expr("sum(c * mid_rank) as rank_sum"), F.expr("sum(c) as size")
    )
    ties = ranks.agg(F.expr("sum(power(cast(ties as double), 3) - ties) as t"))
    return (
        by_group.agg(
            F.expr("sum(rank_sum * rank_sum / size) as q"),
            F.expr("cast(sum(size) as double) as n"),
            F.expr("count(1) - 1 as dof"),
        )
        .withColumn("t", ties.scalar())
        .selectExpr(
            "(12D / (n * (n + 1)) * q - 3 * (n + 1)) / (1D - t / (n * n * n - n)) as h", "dof", "n"
        )
        .withColumn("p_value", chi2_tail("h", F.col("dof").cast("double")))
    )


def group_summary(df: DataFrame, group: str, days: str) -> DataFrame:
    """(group, median, mean, n) of an integer day count."""
    counts = df.where(F.col(days).isNotNull()).groupBy(group, days).agg(F.expr("count(1) as _c"))
    return counts.groupBy(group).agg(
        F.expr(f"percentile({days}, 0.5, _c) as median"),
        F.expr(f"cast(sum(cast({days} as bigint) * _c) as double) / sum(_c) as mean"),
        F.expr("sum(_c) as n"),
    )


def observed_expected(
    scored: DataFrame, entity: str, outcome: str, expected: str, min_rows: int = 30, alpha: float = 0.05
) -> DataFrame:
    """Indirect standardisation per entity: claims, observed, expected, O/E, Poisson tail, flag, side."""
    sums = scored.groupBy(entity).agg(
        F.expr("count(1) as claims"),
        F.expr(f"sum(cast({outcome} as int)) as observed"),
        F.expr(f"cast(sum({expected}) as double) as expected"),
    )
    ranked = sums.where(F.col("claims") >= min_rows).selectExpr("*", "observed / nullif(expected, 0D) as oe_ratio")
    return ranked.withColumn("poisson_tail_p", poisson_tail(F.col("observed"), F.col("expected"))).selectExpr(
        "*",
        f"poisson_tail_p < {alpha}D as flagged",
        f"case when poisson_tail_p >= {alpha}D then 'within' when observed >= expected then 'high' else 'low' end as side",
    )


def describe(df: DataFrame, value: str) -> DataFrame:
    """(n, mean, sd, min, max) in one pass; quartiles come from the exact distributed quantiles."""
    basics = df.agg(
        F.expr(f"count({value}) as n"),
        F.expr(f"avg(cast({value} as double)) as mean"),
        F.expr(f"stddev_samp(cast({value} as double)) as sd"),
        F.expr(f"cast(min({value}) as double) as min"),
        F.expr(f"cast(max({value}) as double) as max"),
    )
    q = exact_quantiles(df, value, [0.25, 0.5, 0.75])
    wide = q.groupBy().agg(
        *[F.expr(f"max(if(probability = {p}D, quantile, null)) as {n}") for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    )
    return basics.select("*", *[wide.select(c).scalar().alias(c) for c in wide.columns])


def adjusted_logit(
    df: DataFrame, outcome: str, drivers: Sequence[str], factors: Sequence[str]
) -> DataFrame:
    """Odds ratios of a logistic model with factor adjustment, as rows.

    (term, coef, odds_ratio, se, z, p_value, ci_low, ci_high, pseudo_r2). The base level of a
    factor is its alphabetically first value.
    """
    data = df.selectExpr(
        f"cast({outcome} as double) as label",
        *[f"cast({d} as double) as `{d}`" for d in drivers],
        *[f"cast({f} as string) as `{f}`" for f in factors],
    ).na.drop()
    stages = []
    for f in factors:
        stages += [
            StringIndexer(inputCol=f, outputCol=f"{f}_i", stringOrderType="alphabetDesc"),
            OneHotEncoder(inputCol=f"{f}_i", outputCol=f"{f}_v", dropLast=True),
        ]
    stages.append(VectorAssembler(inputCols=[*drivers, *[f"{f}_v" for f in factors]], outputCol="features"))
    model = Pipeline(stages=stages).fit(data)
    ready = model.transform(data)
    fit = GeneralizedLinearRegression(family="binomial", link="logit", maxIter=50, tol=1e-8).fit(ready)
    names = list(drivers)
    for i, f in enumerate(factors):
        labels = model.stages[2 * i].labels
        names += [f"{f}={v}" for v in labels[:-1]]
    names.append("intercept")
    s = fit.summary
    if s.numIterations >= 50:
        raise ArithmeticError("the logistic fit has not converged after 50 steps")
    coefs = [*fit.coefficients, fit.intercept]
    pseudo = 1.0 - s.deviance / s.nullDeviance
    rows = [
        (
            n, float(c), float(np.exp(c)), float(e), float(z), float(pv),
            float(np.exp(c - 1.959963984540054 * e)), float(np.exp(c + 1.959963984540054 * e)), float(pseudo),
        )
        for n, c, e, z, pv in zip(names, coefs, s.coefficientStandardErrors, s.tValues, s.pValues)
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "term string, coef double, odds_ratio double, se double, z double, p_value double, ci_low double, "
        "ci_high double, pseudo_r2 double",
    )


TERMS = ("1D", "time", "level", "time_since")


def segmented_frame(series: DataFrame, period: str, value: str, cut: int | None = None) -> DataFrame:
    """(time, level, time_since, y) of a monthly series; the cut defaults to the midpoint.

    The series has one row per month, so a single ordered window is bounded by the calendar.
    """
    numbered = series.selectExpr(
        period, f"cast({value} as double) as y", f"cast(row_number() over (order by {period}) - 1 as int) as time",
        "cast(count(1) over () as int) as _rows",
    )
    at = f"{int(cut)}" if cut is not None else "(_rows div 2)"
    return numbered.selectExpr(
        period, "y", "cast(time as double) as time", f"if(time >= {at}, 1D, 0D) as level",
        f"if(time >= {at}, cast(time - {at} as double), 0D) as time_since",
    )


def segmented_regression(frame: DataFrame, max_lags: int = 3) -> DataFrame:
    """Segmented OLS with Newey-West errors: (term, coef, se, z, p_value).

    X'X, X'y and the lagged score products are aggregates; only 4x4 systems are solved here.
    """
    k = len(TERMS)
    cols = ["one", "time", "level", "time_since"]
    base = frame.selectExpr("1D as one", "time", "level", "time_since", "y")
    first = base.agg(
        *[F.expr(f"sum({cols[i]} * {cols[j]}) as m{i}_{j}") for i in range(k) for j in range(k)],
        *[F.expr(f"sum({cols[i]} * y) as v{i}") for i in range(k)],
    ).first()
    xtx = np.array([[first[f"m{i}_{j}"] for j in range(k)] for i in range(k)])
    beta = np.linalg.solve(xtx, np.array([first[f"v{i}"] for i in range(k)]))
    fitted = " + ".join(f"{float(b)!r}D * {c}" for b, c in zip(beta, cols))
    scores = base.selectExpr("time as _o", *[f"{c} * (y - ({fitted})) as u{i}" for i, c in enumerate(cols)])
    lagged = scores.selectExpr(
        "*", *[f"lag(u{i}, {lag}) over (order by _o) as l{lag}_{i}" for lag in range(1, max_lags + 1) for i in range(k)]
    )
    sums = lagged.agg(
        *[F.expr(f"sum(u{i} * u{j}) as s0_{i}_{j}") for i in range(k) for j in range(k)],
        *[
            F.expr(f"coalesce(sum(u{i} * l{lag}_{j}), 0D) as s{lag}_{i}_{j}")
            for lag in range(1, max_lags + 1) for i in range(k) for j in range(k)
        ],
    ).first()
    meat = np.array([[sums[f"s0_{i}_{j}"] for j in range(k)] for i in range(k)])
    for lag in range(1, max_lags + 1):
        g = np.array([[sums[f"s{lag}_{i}_{j}"] for j in range(k)] for i in range(k)])
        meat = meat + (1.0 - lag / (max_lags + 1.0)) * (g + g.T)
    inv = np.linalg.inv(xtx)
    se = np.sqrt(np.diag(inv @ meat @ inv))
    rows = [
        (name, float(b), float(s), float(b / s), normal_two_sided(b / s))
        for name, b, s in zip(["intercept", "time", "level", "time_since"], beta, se)
    ]
    return frame.sparkSession.createDataFrame(rows, "term string, coef double, se double, z double, p_value double")
