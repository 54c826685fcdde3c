import math

import numpy as np
from pyspark.sql import functions as F

from remitspark.llm import topk

SCHEMA = "vec_id long, embedding array<double>, score string, rank string, q_block string"


def plain(rows, ask, k):
    v = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, a in v:
        if not ask(q):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in v if i != q and len(a) == len(b)))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted((q, r, i, max(min(s, topk.LONG), -topk.LONG)) for q, r, i, s in out)  # beyond a long: the nearest


def check(spark, rows, ask, column, k=5, **options):
    df = spark.createDataFrame([(i, e, "x", "y", "z") for i, e in rows], SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in topk.top_k(df, column, k=k, **options).collect())
    assert got == plain(rows, ask, k)


def test_as_brute_force_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-3, 4, 6) / 4).tolist()) for i in range(300)]
    rows += [(400 + i, [0.5] * 6) for i in range(150)]
    rows += [(600, None), (601, [None] + [1.0] * 5), (602, [float("nan")] * 6), (604, [float("inf")] * 6), (605, [1.0, 2.0]), (610, [1.0, 2.0]), (None, [1.0] * 6)]
    check(spark, rows, lambda i: i % 5 == 0, F.col("vec_id") % 5 == 0, block=16, bins=16)


def test_large_values_and_few_candidates(spark):
    rows = [(0, [1e6, -1e6]), (1, [2e7, 3.0]), (2, [-1e7, 1e7])]
    check(spark, rows, lambda i: True, F.lit(True), k=5)


def test_nothing_to_ask(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(df, F.lit(True)).count() == 0
    assert topk.top_k(spark.createDataFrame([(1, [1.0], "", "", "")], SCHEMA), F.lit(False)).count() == 0
