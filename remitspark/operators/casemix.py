"""Logistic case-mix model on merged covariate patterns, and what it expects."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.inline import literal
from ..session import package_on_path, pin


@dataclass(frozen=True)
class CaseMix:
    """A fitted model: SQL text of every term, its coefficient, and the fit's state."""

    terms: dict[str, str]
    coefficients: np.ndarray
    covariance: np.ndarray
    steps: int
    log_likelihood: float
    null_log_likelihood: float

    @property
    def pseudo_r2(self) -> float:
        return 1.0 - self.log_likelihood / self.null_log_likelihood

    def probability(self) -> Column:
        """Expected probability of a row, from its own columns: nothing is joined. Null where a covariate is null."""
        xb = " + ".join(f"({float(b)!r}D * {sql})" for b, sql in zip(self.coefficients, self.terms.values()))
        return F.expr(f"1D / (1D + exp(-({xb})))")


def design_terms(patterns: DataFrame, flags: Sequence[str], factors: Sequence[str]) -> dict[str, str]:
    """Terms of the model: intercept, flags, and every level of a factor but its alphabetically first."""
    terms = {"intercept": "1D"} | {f: f"cast({f} as double)" for f in flags}
    for f in factors:  # the model's own width: as many levels as it has coefficients
        levels = sorted(r[0] for r in patterns.select(F.col(f).cast("string")).distinct().collect())
        for level in levels[1:]:
            terms[f"{f}={level}"] = f"if(cast({f} as string) = {literal(level)}, 1D, if({f} is null, null, 0D))"
    return terms


def covariate_patterns(df: DataFrame, outcome: str, flags: Sequence[str], factors: Sequence[str]) -> DataFrame:
    """Rows merged to (flags, factors): n rows and y events. Rows with a null take no part."""
    known = df.where(" and ".join(f"{c} is not null" for c in (outcome, *flags, *factors)))
    return known.groupBy(*flags, *factors).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(outcome).cast("int")).alias("y"))


def fit_case_mix(
    df: DataFrame, outcome: str, flags: Sequence[str], factors: Sequence[str], max_iter: int = 40, tolerance: float = 1e-9
) -> CaseMix:
    """Maximum-likelihood logistic fit by Newton steps on merged covariate patterns.

    The rows are merged once; each step is a job over the patterns, whose partitions return one row each with the score vector,
    the information matrix and the likelihood. A fit that does not settle (a term that separates the outcomes, or that is a
    combination of others) raises instead of returning its last step.
    """
    patterns = pin(covariate_patterns(df, outcome, flags, factors))
    terms = design_terms(patterns, flags, factors)
    columns = patterns.selectExpr("cast(n as double) as n", "cast(y as double) as y", *[f"{sql} as x{i}" for i, sql in enumerate(terms.values())])
    p = len(terms)
    beta, step = np.zeros(p), np.full(p, np.inf)
    package_on_path(df.sparkSession)
    null_ll = ll = None
    for steps in range(max_iter + 1):
        score, information, ll = _sums(columns, beta)
        if null_ll is None:
            n, y = ll[1], ll[2]
            if not 0 < y < n:
                raise ArithmeticError("the outcome does not vary")
            null_ll = y * np.log(y / n) + (n - y) * np.log(1 - y / n)
        if np.abs(step).max() < tolerance:
            return CaseMix(terms, beta, np.linalg.inv(information), steps, float(ll[0]), float(null_ll))
        try:
            step = np.linalg.solve(information, score)
        except np.linalg.LinAlgError as e:
            raise ArithmeticError("the terms are not independent") from e
        size = np.abs(step).max()
        beta = beta + (step if size < 5 else step * 5 / size)
        if np.abs(beta).max() > 30:
            raise ArithmeticError("a term separates the outcomes")
    raise ArithmeticError(f"the case-mix fit has not settled after {max_iter} steps")


def _sums(columns: DataFrame, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score vector, information matrix and (log-likelihood, rows, events) at ``beta``."""
    p = len(beta)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(p + p * p + 3)
        for f in frames:
            a = f.to_numpy(dtype=np.float64)
            n, y, x = a[:, 0], a[:, 1], a[:, 2:]
            z = x @ beta
            mu = 1 / (1 + np.exp(-z))
            total[:p] += x.T @ (y - n * mu)
            total[p:-3] += (x.T @ (x * (n * mu * (1 - mu))[:, None])).ravel()
            total[-3:] += (y * z - n * np.logaddexp(0, z)).sum(), n.sum(), y.sum()
        yield pd.DataFrame({"sums": [total.tolist()]})

    rows = columns.mapInPandas(run, "sums array<double>").collect()  # one row a partition
    total = np.sum([np.zeros(p + p * p + 3), *[r["sums"] for r in rows]], axis=0)
    return total[:p], total[p:-3].reshape(p, p), total[-3:]


def score_equations(df: DataFrame, outcome: str, flags: Sequence[str], factors: Sequence[str], model: CaseMix) -> DataFrame:
    """(term, observed, expected): events on each term, seen and expected. A maximum-likelihood fit makes them equal."""
    scored = covariate_patterns(df, outcome, flags, factors).withColumn("p", model.probability())
    rows = scored.agg(*[F.struct(F.sum(F.expr(f"y * {sql}")).alias("observed"), F.sum(F.expr(f"n * p * {sql}")).alias("expected")).alias(f"_{i}") for i, sql in enumerate(model.terms.values())])
    items = ", ".join(f"struct({literal(t)} as term, _{i}.observed as observed, _{i}.expected as expected)" for i, t in enumerate(model.terms))
    return rows.selectExpr(f"inline(array({items}))")
