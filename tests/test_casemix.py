import random

import numpy as np
import pytest

from remitspark.operators import casemix
from remitspark.operators.events import path_variants


def data(n=600):
    rng = random.Random(4)
    out = []
    for i in range(n):
        flag, level = rng.randrange(2), rng.choice("abc")
        z = -1 + 0.8 * flag + {"a": 0, "b": 0.5, "c": -0.7}[level]
        out.append((int(rng.random() < 1 / (1 + np.exp(-z))), flag, level, i % 7))
    return out


def plain_fit(rows):
    x = np.array([[1, f, level == "b", level == "c"] for _, f, level, _ in rows], dtype=float)
    y = np.array([r[0] for r in rows], dtype=float)
    b = np.zeros(4)
    for _ in range(30):
        mu = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve(x.T @ (x * (mu * (1 - mu))[:, None]), x.T @ (y - mu))
    return b, np.sqrt(np.diag(np.linalg.inv(x.T @ (x * (mu * (1 - mu))[:, None])))), mu


def test_fit_on_patterns_as_on_rows(spark):
    rows = data()
    df = spark.createDataFrame(rows + [(1, None, "a", 0), (None, 1, "a", 0), (1, 1, None, 0)], "y int, f int, g string, k int")
    model = casemix.fit_case_mix(df, "y", ["f"], ["g"])
    b, se, mu = plain_fit(rows)
    assert list(model.terms) == ["intercept", "f", "g=b", "g=c"] and model.steps < 12
    assert np.allclose(model.coefficients, b, atol=1e-9) and np.allclose(np.sqrt(np.diag(model.covariance)), se, atol=1e-9)
    got = [r["p"] for r in df.withColumn("p", model.probability()).collect()]
    assert np.allclose([p for p in got if p is not None][: len(rows)], mu) and got.count(None) == 2
    for r in casemix.score_equations(df, "y", ["f"], ["g"], model).collect():
        assert r["observed"] == pytest.approx(r["expected"], abs=1e-7)


def test_fits_that_do_not_exist_raise(spark):
    separated = [(int(f), f, "a", 0) for f in (0, 1) for _ in range(20)]
    doubled = [(i % 2, i // 2 % 2, "ab"[i // 2 % 2], 0) for i in range(40)]
    constant = [(1, i % 2, "a", 0) for i in range(10)]
    for rows in (separated, doubled, constant, []):
        with pytest.raises(ArithmeticError):
            casemix.fit_case_mix(spark.createDataFrame(rows, "y int, f int, g string, k int"), "y", ["f"], ["g"])


def test_paths_of_a_hot_case_null_types_and_null_cases(spark, monkeypatch):
    from remitspark.operators import events

    monkeypatch.setattr(events, "PATH_BLOCK", 7)
    rng = random.Random(1)
    cases = {"hot": 300, None: 4, "x": 3, "y": 3, "z": 3}
    rows = [(c, i, (rng.choice(["a", "b", None]) if c == "hot" else "abc"[i % 3])) for c, n in cases.items() for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "c string, i int, k string").repartition(5)
    want = {}
    for c in cases:
        path = " -> ".join(k for _, _, k in sorted((r for r in rows if r[0] == c), key=lambda r: r[1]) if k)
        want[path] = want.get(path, 0) + 1
    got = {r["path"]: (r["claims"], r["share"]) for r in path_variants(df, "c", ["i"], "k").collect()}
    assert got == {p: (n, n / 5) for p, n in want.items()}
    plan = path_variants(df, "c", ["i"], "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan
