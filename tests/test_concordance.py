import random

import numpy as np
import pytest

from remitspark.operators.concordance import concordance, weighted_inversions


def plain(rows):
    comparable = concordant = tied = 0
    rows = [r for r in rows if None not in r]
    for t, e, s in rows:
        for u, f, v in rows:
            if e and (t < u or (t == u and not f)):
                comparable += 1
                concordant += s > v
                tied += s == v
    return comparable, concordant, tied, (concordant + tied / 2) / comparable if comparable else None


def test_inversions_as_counted_pair_by_pair():
    rng = random.Random(3)
    for n in (0, 1, 2, 5, 64, 65, 200):
        key = np.array([rng.randrange(20) for _ in range(n)])
        early, late = (np.array([rng.randrange(4) for _ in range(n)]) for _ in range(2))
        want = sum(int(early[i] * late[j]) for j in range(n) for i in range(j) if key[j] < key[i])
        assert weighted_inversions(key, early, late) == want
    huge = np.array([2**40, 2**40])
    assert weighted_inversions(np.array([1, 0]), huge, huge) == 2**80


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_ties_in_time_and_score_hot_values_and_nulls(spark, partitions):
    rng = random.Random(partitions)
    rows = [(rng.choice([5, rng.randrange(30)]), rng.randrange(2), rng.choice([1.0, rng.randrange(12) / 4, rng.random()])) for _ in range(500)]
    rows += [(None, 1, 0.5), (3, None, 0.5), (3, 1, None)]
    df = spark.createDataFrame(rows, "t int, e int, s double").repartition(4)
    r = concordance(df, "t", "e", "s", partitions).collect()[0]
    want = plain(rows)
    assert tuple(r)[:3] == want[:3] and r["concordance"] == pytest.approx(want[3], abs=1e-15)


def test_nothing_to_compare(spark):
    for rows in ([], [(1, 0, 0.5), (2, 0, 0.1)], [(1, 1, 0.5)]):
        r = concordance(spark.createDataFrame(rows, "t int, e int, s double"), "t", "e", "s", 2).collect()[0]
        assert tuple(r) == (0.0, 0.0, 0.0, None)


def test_no_pair_join(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (2, 0, 0.1)], "t int, e int, s double")
    plan = concordance(df, "t", "e", "s", 2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
