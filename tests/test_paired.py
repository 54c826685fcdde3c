import hashlib
import random

import numpy as np
import pytest

from remitspark.operators import paired


def tie(key, seed=1337):
    return int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:12], 16)


def plain(rows, share, resamples):
    """Share of money captured by (rule, resample), row by row."""
    maps = paired.resample_maps(resamples, 1337)
    out = {}
    for rule in (1, 2):
        order = sorted(rows, key=lambda r: (r[rule] is None, -(r[rule] or 0), tie(r[0]), r[0]))
        for b in range(-1, resamples):
            weight = [1 if b < 0 else sum((tie(r[0]) % paired.PRIME * maps[b][0] + maps[b][1]) % paired.PRIME >= t for t in paired.POISSON) for r in order]
            cut, seen, got = max(1, round(sum(weight) * share)), 0, 0.0
            for r, w in zip(order, weight):
                got += (r[3] or 0) * max(0, min(w, cut - seen))
                seen += w
            out["ab"[rule - 1], b] = (got, sum((r[3] or 0) * w for r, w in zip(order, weight)))
    return out


def data(n=400):
    rng = random.Random(6)
    return [(i, rng.choice([None, 1.0, rng.random()]), float(i % 3), rng.choice([None, float(rng.randrange(50))])) for i in range(n)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_captured_as_row_by_row(spark, partitions):
    rows = data()
    df = spark.createDataFrame(rows, "k long, x double, y double, m double").repartition(3)
    got = {(r["rule"], r["resample"]): (r["captured"], r["total"]) for r in paired.captured(df, "k", {"a": "x", "b": "y"}, "m", 0.1, 20, partitions=partitions).collect()}
    assert got == plain(rows, 0.1, 20)


def test_differences_and_a_rule_against_itself(spark):
    df = spark.createDataFrame(data(), "k long, x double, y double, m double")
    out = {r["difference"]: r for r in paired.rule_differences(df, "k", {"a": "x", "b": "y", "money": "m"}, [("a", "a"), ("a", "b"), ("money", "b")], "m", 0.1, 50).collect()}
    assert tuple(out["a_minus_a"])[1:] == (0.0, 0.0, 0.0, 50)
    assert out["money_minus_b"]["low"] > 0 and out["a_minus_b"]["low"] <= out["a_minus_b"]["point"] <= out["a_minus_b"]["high"]


def test_no_rows_and_no_money(spark):
    for rows in ([], [(1, 0.5, 0.5, 0.0), (2, 0.1, 0.1, None)]):
        df = spark.createDataFrame(rows, "k long, x double, y double, m double")
        r = paired.rule_differences(df, "k", {"a": "x", "b": "y"}, [("a", "b")], "m", 0.1, 5).collect()
        assert [tuple(x)[:4] for x in r] == [("a_minus_b", None, None, None)]


def test_weights_are_poisson():
    w = paired.resample_weights(np.random.default_rng(1).integers(0, paired.PRIME, 20_000), paired.resample_maps(30, 5))[:, :-1]
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert abs(np.corrcoef(w.T)[np.triu_indices(30, 1)]).max() < 0.06
