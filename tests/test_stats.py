import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from remitspark.functions.scalars import log_factorial, poisson_tail
from remitspark.functions.tails import normal_two_sided, upper_gamma
from remitspark.operators import stats, survival
from remitspark.operators.concordance import concordance
from remitspark.plans import queries_time
from remitspark.plans.roles import LINE_MEASURES

SF = "/root/testdata/sf0.001"


def test_tail_functions():
    assert upper_gamma(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, abs=1e-9)
    assert upper_gamma(2.0, 9.487729036781154 / 2) == pytest.approx(0.05, abs=1e-9)
    assert upper_gamma(3.0, 0.0) == 1.0
    assert normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-9)


def test_poisson_tail_on_both_sides(spark):
    def exact(o, e):
        mass = lambda k: math.exp(-e + k * math.log(e) - math.lgamma(k + 1))
        return sum(mass(k) for k in range(o, o + 4000)) if o >= e else sum(mass(k) for k in range(o + 1))

    cases = [(0, 0.5), (0, 30.0), (3, 1.2), (40, 60.5), (60, 40.5), (1200, 1000.0), (25, 25.0), (950, 1000.0)]
    df = spark.createDataFrame(cases, "o long, e double")
    for r in df.withColumn("p", poisson_tail(F.col("o"), F.col("e"))).collect():
        assert r["p"] == pytest.approx(exact(r["o"], r["e"]), rel=1e-8, abs=1e-12)


def test_log_factorial(spark):
    for r in spark.createDataFrame([(n,) for n in (0, 1, 5, 19, 20, 21, 170, 5000)], "n long").withColumn("f", log_factorial(F.col("n"))).collect():
        assert r["f"] == pytest.approx(math.lgamma(r["n"] + 1), rel=1e-12, abs=1e-12)


def test_chi_square_counts_empty_cells(spark):
    data = [("a", "x")] * 10 + [("a", "y")] * 5 + [("b", "y")] * 7 + [("c", "x")] * 3 + [("c", "z")] * 9
    df = spark.createDataFrame(data, "g string, h string")
    t = np.array([[10, 5, 0], [0, 7, 0], [3, 0, 9]], float)
    exp = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
    r = stats.chi_square(df, "g", "h").first()
    chi = ((t - exp) ** 2 / exp).sum()
    assert r["chi2"] == pytest.approx(chi) and r["dof"] == 4
    assert r["p_value"] == pytest.approx(upper_gamma(2.0, chi / 2))
    phi = max(0.0, chi / 34 - 4 / 33)
    assert r["cramers_v"] == pytest.approx(math.sqrt(phi / (3 - 4 / 33 - 1)))


def test_yates_on_two_by_two(spark):
    df = spark.createDataFrame([(1, 1)] * 12 + [(1, 0)] * 5 + [(0, 1)] * 4 + [(0, 0)] * 9, "a int, b int")
    t = np.array([[9, 4], [5, 12]], float)
    exp = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
    assert stats.chi_square(df, "a", "b").first()["chi2"] == pytest.approx((np.maximum(np.abs(t - exp) - 0.5, 0) ** 2 / exp).sum())
    assert stats.chi_square(df, "a", "b", yates=False).first()["chi2"] == pytest.approx(((t - exp) ** 2 / exp).sum())


def test_yates_with_an_empty_cell(spark):
    df = spark.createDataFrame([(1, 1)] * 10 + [(0, 1)] * 5 + [(0, 0)] * 5, "a int, b int")
    assert stats.chi_square(df, "a", "b").first()["chi2"] == pytest.approx(64 / 15)
    assert stats.chi_square(df, "a", "b", yates=False).first()["chi2"] == pytest.approx(20 / 3)


def test_line_numbers_far_apart_are_distinct(spark):
    lines = spark.createDataFrame([(1, 1), (1, 65), (2, 3), (2, 3)], "claim int, line_num int")
    got = lines.groupBy("claim").agg(F.expr(LINE_MEASURES["distinct_lines"]).alias("n")).collect()
    assert {r["claim"]: r["n"] for r in got} == {1: 2, 2: 1}


def test_kruskal_with_ties(spark):
    groups = {"a": [1, 2, 2, 5], "b": [2, 3, 7], "c": [5, 5, 9, 10]}
    values = sorted(v for g in groups.values() for v in g)
    rank = {v: np.mean([i + 1 for i, x in enumerate(values) if x == v]) for v in values}
    n = len(values)
    h = 12 / (n * (n + 1)) * sum(sum(rank[v] for v in g) ** 2 / len(g) for g in groups.values()) - 3 * (n + 1)
    ties = sum(values.count(v) ** 3 - values.count(v) for v in set(values))
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v int")
    r = stats.kruskal_wallis(df, "g", "v").first()
    assert r["h"] == pytest.approx(h / (1 - ties / (n**3 - n))) and r["dof"] == 2


def test_survival_frame_and_curve(spark):
    d = dt.date(2024, 1, 1)
    rows = [(d, d + dt.timedelta(days=10)), (d, d + dt.timedelta(days=20)), (d, None), (d + dt.timedelta(days=30), d)]
    df = survival.survival_frame(spark.createDataFrame(rows, "s date, p date"), "s", "p")
    assert sorted((r["dur"], r["event"]) for r in df.collect()) == [(10, 1), (20, 0), (20, 1)]
    curve = {r["t"]: r["survival"] for r in survival.kaplan_meier(df).collect()}
    assert curve[10] == pytest.approx(2 / 3) and curve[20] == pytest.approx(1 / 3)
    p = survival.paid_by(survival.kaplan_meier(df), [5, 10, 30]).first()
    assert (p["p5"], round(p["p10"], 9), round(p["p30"], 9)) == (0.0, round(1 / 3, 9), round(2 / 3, 9))


def test_curve_reaches_zero_when_all_die(spark):
    df = spark.createDataFrame([(1, 1), (2, 1)], "dur int, event int")
    assert {r["t"]: r["survival"] for r in survival.kaplan_meier(df).collect()}[2] == 0.0


def test_cox_recovers_the_hazard_and_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    n = 600
    x = rng.integers(0, 2, n)
    t = np.ceil(rng.exponential(40 * np.exp(-0.7 * x))).astype(int)
    c = rng.integers(20, 100, n)
    dur, ev = np.minimum(t, c), (t <= c).astype(int)
    df = spark.createDataFrame([(int(a), int(b), int(z)) for a, b, z in zip(dur, ev, x)], "dur int, event int, x int")
    fit = survival.cox_regression(df, "dur", "event", ["x"], ridge=0.0).first()
    beta = 0.0
    for _ in range(30):
        g = h = 0.0
        w = np.exp(beta * x)
        for i in np.flatnonzero(ev):
            risk = dur >= dur[i]
            m = (w * x)[risk].sum() / w[risk].sum()
            g += x[i] - m
            h += m - m * m
        beta += g / h
    assert fit["coef"] == pytest.approx(beta, abs=1e-5)
    assert 0.4 < fit["coef"] < 1.0 and fit["ci_low"] < fit["hazard_ratio"] < fit["ci_high"]
    ph = survival.schoenfeld_check(df, "dur", "event", ["x"], [fit["coef"]]).first()
    assert abs(ph["correlation"]) < 0.2


def test_merged_rows_fit_as_the_rows_themselves(spark):
    rng = np.random.default_rng(5)
    rows = [(int(t), int(e), int(x), "ab"[int(s)]) for t, e, x, s in zip(rng.integers(1, 9, 400), rng.integers(0, 2, 400), rng.integers(0, 3, 400), rng.integers(0, 2, 400))]
    df = spark.createDataFrame(rows, "dur int, event int, x int, s string")
    merged = survival.merged_rows(df, ["dur", "event", "x", "s"], "n")
    assert merged.count() < 100 and merged.agg({"n": "sum"}).first()[0] == 400
    for strata in (None, "s"):
        one, two = (survival.cox_regression(d, "dur", "event", ["x"], strata=strata, weight=w).first() for d, w in ((df, None), (merged, "n")))
        assert tuple(one)[1:] == pytest.approx(tuple(two)[1:], rel=1e-9)
        one, two = (survival.schoenfeld_check(d, "dur", "event", ["x"], [0.3], strata, weight=w).first() for d, w in ((df, None), (merged, "n")))
        assert tuple(one)[1:] == pytest.approx(tuple(two)[1:], rel=1e-9)
    one, two = (concordance(d, "dur", "event", "x", 3, weight=w).first() for d, w in ((df, None), (merged, "n")))
    assert tuple(one) == tuple(two)


def test_the_cox_queries_read_each_combination_once(spark):
    rows = queries_time._cox_rows(spark, SF)
    twice = rows.groupBy("dur", "event", "sim_payer_id", *queries_time.COX).count().where("count > 1")
    assert twice.isEmpty() and rows.agg({"claims": "sum"}).first()[0] == queries_time._survival(spark, SF).count()


def test_segmented_regression_matches_numpy_and_recovers_the_effect(spark):
    rng = np.random.default_rng(20260723)
    t = np.arange(60)
    level, since = (t >= 30).astype(float), np.where(t >= 30, t - 30, 0).astype(float)
    y = 0.30 - 0.001 * t - 0.05 * level + 0.002 * since + rng.normal(0, 0.01, 60)
    df = spark.createDataFrame([(f"{2000 + i // 12}-{1 + i % 12:02d}", float(v)) for i, v in enumerate(y)], "m string, y double")
    got = {r["term"]: r for r in stats.segmented_regression(stats.segmented_frame(df, "m", "y")).collect()}
    X = np.column_stack([np.ones(60), t, level, since])
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    u = X * (y - X @ beta)[:, None]
    s = u.T @ u
    for lag in range(1, 4):
        g = u[lag:].T @ u[:-lag]
        s += (1 - lag / 4) * (g + g.T)
    inv = np.linalg.inv(X.T @ X)
    se = np.sqrt(np.diag(inv @ s @ inv))
    for i, name in enumerate(["intercept", "time", "level", "time_since"]):
        assert got[name]["coef"] == pytest.approx(beta[i], abs=1e-9)
        assert got[name]["se"] == pytest.approx(se[i], rel=1e-6)
    assert got["level"]["coef"] == pytest.approx(-0.05, abs=0.02) and got["level"]["p_value"] < 0.01


def test_adjusted_logit_odds_ratio(spark):
    rng = np.random.default_rng(4)
    n = 4000
    x = rng.integers(0, 2, n)
    g = rng.integers(0, 3, n)
    p = 1 / (1 + np.exp(-(-1.5 + 1.0 * x + 0.5 * (g == 2))))
    y = rng.uniform(size=n) < p
    df = spark.createDataFrame([(bool(a), int(b), "abc"[c]) for a, b, c in zip(y, x, g)], "y boolean, x int, g string")
    got = {r["term"]: r for r in stats.adjusted_logit(df, "y", ["x"], ["g"]).collect()}
    assert set(got) == {"x", "g=b", "g=c", "intercept"}
    assert got["x"]["odds_ratio"] == pytest.approx(math.e, rel=0.25) and got["x"]["p_value"] < 1e-6
    assert 0 < got["x"]["pseudo_r2"] < 0.2


def test_observed_expected_flags_only_large_entities(spark):
    data = [("low", 0, 0.5)] * 40 + [("ok", i % 2, 0.5) for i in range(40)] + [("tiny", 1, 0.01)] * 5
    df = spark.createDataFrame(data, "p string, y int, e double")
    got = {r["p"]: r for r in stats.observed_expected(df, "p", "y", "e").collect()}
    assert set(got) == {"low", "ok"} and got["low"]["side"] == "low" and got["ok"]["side"] == "within"


def test_describe(spark):
    r = stats.describe(spark.range(1, 6).selectExpr("cast(id as double) as v"), "v").first()
    assert (r["n"], r["mean"], r["min"], r["q25"], r["q50"], r["q75"], r["max"]) == (5, 3.0, 1.0, 2.0, 3.0, 4.0, 5.0)
