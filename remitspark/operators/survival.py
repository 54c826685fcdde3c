"""Time-to-payment: survival frame, Kaplan-Meier, Cox regression."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tails import normal_two_sided


def survival_frame(df: DataFrame, start: str, paid: str, other_dates: Sequence[str] = ()) -> DataFrame:
    """Adds ``dur`` (days to payment, or to the snapshot when unpaid) and ``event``; negative
    durations are left out. The snapshot is the latest date of the given columns."""
    latest = ", ".join(f"max({c})" for c in (paid, *other_dates))
    as_of = df.agg(F.expr(f"greatest({latest}, max({paid})) as d"))
    return (
        df.withColumn("_as_of", as_of.scalar())
        .selectExpr(
            "*",
            f"datediff(coalesce({paid}, _as_of), {start}) as dur",
            f"cast({paid} is not null as int) as event",
        )
        .where("dur >= 0")
        .drop("_as_of")
    )


def merged_rows(df: DataFrame, columns: Sequence[str], out: str = "rows") -> DataFrame:
    """Equal rows as one, with their number: as many rows as there are different values, whatever the input."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(out))


def kaplan_meier(df: DataFrame, dur: str = "dur", event: str = "event", groups: Sequence[str] = ()) -> DataFrame:
    """Survival curve rows (groups…, t, at_risk, deaths, censored, survival).

    Rows are merged to (group, day) first; the windows then hold one row per day of follow-up.
    """
    per_t = df.groupBy(*groups, F.col(dur).alias("t")).agg(
        F.expr(f"sum({event}) as deaths"), F.expr(f"count(1) - sum({event}) as censored")
    )
    part = f"partition by {', '.join(groups)} " if groups else ""
    at_risk = per_t.selectExpr(
        "*", f"sum(deaths + censored) over ({part}order by t desc rows between unbounded preceding and current row) as at_risk"
    )
    upto = f"over ({part}order by t rows between unbounded preceding and current row)"
    # ln(0) is null and would be skipped by the sum, so survival is forced to 0 once all have died
    return at_risk.selectExpr(
        *groups,
        "t",
        "at_risk",
        "deaths",
        "censored",
        f"if(max(if(deaths = at_risk, 1, 0)) {upto} = 1, 0D, "
        f"exp(sum(if(deaths < at_risk, ln(1D - deaths / at_risk), 0D)) {upto})) as survival",
    )


def paid_by(curve: DataFrame, horizons: Sequence[int], groups: Sequence[str] = ()) -> DataFrame:
    """P(event by t) per horizon column p{t}, and the plateau at the end of follow-up."""
    return curve.groupBy(*groups).agg(
        *[F.expr(f"1D - coalesce(min(case when t <= {h} then survival end), 1D) as p{h}") for h in horizons],
        F.expr("1D - min(survival) as plateau"),
    )


def cox_regression(
    df: DataFrame,
    dur: str,
    event: str,
    covariates: Sequence[str],
    strata: str | None = None,
    ridge: float = 0.01,
    max_iter: int = 25,
    tolerance: float = 1e-7,
    weight: str | None = None,
) -> DataFrame:
    """Cox proportional hazards with Breslow ties: (covariate, coef, hazard_ratio, se, z, p, ci_low, ci_high).

    Each Newton step is one Spark job: rows are merged to (stratum, day) sums of exp(xb), x*exp(xb)
    and x*x'*exp(xb), a reverse running sum over days gives the risk sets, and only the p-vector
    gradient and p-by-p information matrix reach the driver. ``ridge`` penalises b'b as
    ridge * n / 2. ``weight`` names a column that tells how many equal rows a row stands for.
    """
    p = len(covariates)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    keep = df.selectExpr(
        *([f"{strata} as _s"] if strata else ["1 as _s"]),
        f"cast({dur} as int) as _t",
        f"cast({event} as double) as _e",
        f"{weight or '1L'} as _w",
        *[f"cast({c} as double) as x{i}" for i, c in enumerate(covariates)],
    )
    # identical rows are merged once: covariates of claims repeat, and the sums only need counts
    keep = keep.groupBy("_s", "_t", *[f"x{i}" for i in range(p)]).agg(
        F.expr("sum(_e * _w) as _d"), F.expr("cast(sum(_w) as double) as _n")
    ).persist()
    rows = keep.agg(F.expr("sum(_n)")).first()[0]
    beta = np.zeros(p)
    information = np.eye(p)
    for _ in range(max_iter):
        gradient, information = _cox_step(keep, beta, pairs)
        gradient = gradient - ridge * rows * beta
        information = information + ridge * rows * np.eye(p)
        step = np.linalg.solve(information, gradient)
        size = np.abs(step).max()
        beta = beta + (step if size < 5 else step * 5 / size)
        if size < tolerance:
            break
    else:
        keep.unpersist()
        raise ArithmeticError(f"the Cox fit has not converged after {max_iter} steps")
    keep.unpersist()
    se = np.sqrt(np.diag(np.linalg.inv(information)))
    out = []
    for name, b, s in zip(covariates, beta, se):
        z = b / s
        out.append(
            (name, float(b), float(np.exp(b)), float(s), float(z), normal_two_sided(z),
             float(np.exp(b - 1.959963984540054 * s)), float(np.exp(b + 1.959963984540054 * s)))
        )
    return df.sparkSession.createDataFrame(
        out,
        "covariate string, coef double, hazard_ratio double, se double, z double, p_value double, ci_low double, ci_high double",
    )


def _cox_step(rows: DataFrame, beta: np.ndarray, pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    p = len(beta)
    xb = " + ".join(f"({float(b)!r}D * x{i})" for i, b in enumerate(beta))
    sums = {"s0": "sum(_n * w)", "d": "sum(_d)"}
    sums |= {f"a{i}": f"sum(_n * w * x{i})" for i in range(p)}
    sums |= {f"b{i}_{j}": f"sum(_n * w * x{i} * x{j})" for i, j in pairs}
    sums |= {f"dx{i}": f"sum(_d * x{i})" for i in range(p)}
    per_t = rows.selectExpr("*", f"exp({xb}) as w").groupBy("_s", "_t").agg(
        *[F.expr(f"{v} as {k}") for k, v in sums.items()]
    )
    back = "over (partition by _s order by _t desc rows between unbounded preceding and current row)"
    risk = per_t.selectExpr(
        "d", *[f"dx{i}" for i in range(p)],
        *[f"sum({k}) {back} as r_{k}" for k in sums if k == "s0" or k[0] in "ab"],
    )
    total = risk.agg(
        *[F.expr(f"sum(dx{i} - d * r_a{i} / r_s0) as g{i}") for i in range(p)],
        *[
            F.expr(f"sum(d * (r_b{i}_{j} / r_s0 - r_a{i} * r_a{j} / (r_s0 * r_s0))) as h{i}_{j}")
            for i, j in pairs
        ],
    ).first()
    gradient = np.array([total[f"g{i}"] for i in range(p)])
    information = np.zeros((p, p))
    for i, j in pairs:
        information[i, j] = information[j, i] = total[f"h{i}_{j}"]
    return gradient, information


def schoenfeld_check(
    df: DataFrame, dur: str, event: str, covariates: Sequence[str], coefficients: Sequence[float], strata: str | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Correlation of scaled-free Schoenfeld residuals with the rank of time, per covariate.

    Per day the residual is the mean covariate of those paid minus the risk-set mean; days are
    weighted by their payments. (covariate, correlation, z, p_value). ``weight`` as in :func:`cox_regression`.
    """
    p = len(covariates)
    xb = " + ".join(f"({float(b)!r}D * x{i})" for i, b in enumerate(coefficients))
    rows = df.selectExpr(
        *([f"{strata} as _s"] if strata else ["1 as _s"]),
        f"cast({dur} as int) as _t",
        f"cast({event} as double) * {weight or '1L'} as _e",
        f"{weight or '1L'} as _w",
        *[f"cast({c} as double) as x{i}" for i, c in enumerate(covariates)],
    ).selectExpr("*", f"_w * exp({xb}) as w")
    per_t = rows.groupBy("_s", "_t").agg(
        F.expr("sum(_e) as d"),
        F.expr("sum(w) as s0"),
        *[F.expr(f"sum(w * x{i}) as a{i}") for i in range(p)],
        *[F.expr(f"sum(_e * x{i}) as dx{i}") for i in range(p)],
        *[F.expr(f"sum(_e * x{i} * x{i}) as dxx{i}") for i in range(p)],
    )
    back = "over (partition by _s order by _t desc rows between unbounded preceding and current row)"
    # rank of time among payments: one row per day
    residuals = per_t.selectExpr(
        "*", f"sum(s0) {back} as r0", *[f"sum(a{i}) {back} as ra{i}" for i in range(p)]
    ).where("d > 0")
    ranks = residuals.groupBy("_t").agg(F.expr("sum(d) as n")).selectExpr(
        "_t", "sum(n) over (order by _t) - (n - 1) / 2D as rank"
    )
    joined = residuals.join(ranks, "_t")
    row = joined.agg(
        F.expr("sum(d) as n"), F.expr("sum(d * rank) as sr"), F.expr("sum(d * rank * rank) as srr"),
        *[F.expr(f"sum(dx{i} - d * ra{i} / r0) as e{i}") for i in range(p)],
        *[F.expr(f"sum(dxx{i} - 2 * dx{i} * ra{i} / r0 + d * pow(ra{i} / r0, 2)) as ee{i}") for i in range(p)],
        *[F.expr(f"sum(rank * (dx{i} - d * ra{i} / r0)) as er{i}") for i in range(p)],
    ).first()
    out = []
    n = row["n"]
    var_r = row["srr"] / n - (row["sr"] / n) ** 2
    for i, name in enumerate(covariates):
        var_e = row[f"ee{i}"] / n - (row[f"e{i}"] / n) ** 2
        cov = row[f"er{i}"] / n - row["sr"] / n * row[f"e{i}"] / n
        r = cov / np.sqrt(var_e * var_r) if var_e > 0 and var_r > 0 else float("nan")
        z = float(r * np.sqrt(n))
        out.append((name, float(r), z, normal_two_sided(z)))
    return df.sparkSession.createDataFrame(out, "covariate string, correlation double, z double, p_value double")
