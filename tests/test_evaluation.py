import numpy as np
import pytest
from pyspark.sql import functions as F

from remitspark.operators import evaluation as e


def fold(spark, n=800, seed=5, ties=False):
    rng = np.random.default_rng(seed)
    p = rng.uniform(0.02, 0.6, n)
    if ties:
        p = np.round(p, 1)
    y = (rng.uniform(size=n) < p).astype(int)
    amount = np.round(rng.lognormal(7, 1, n), 2)
    data = [(int(i), int(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(y, p, amount))]
    return spark.createDataFrame(data, "k long, y int, s double, a double"), y, p, amount


def brute_auc(y, s, w=None):
    w = np.ones(len(y)) if w is None else w
    pos, neg = y == 1, y == 0
    diff = s[pos][:, None] - s[neg][None, :]
    pairs = w[pos][:, None] * w[neg][None, :]
    return ((diff > 0) * pairs + 0.5 * (diff == 0) * pairs).sum() / pairs.sum()


def brute_ap(y, s):
    total, out = y.sum(), 0.0
    for v in np.unique(s)[::-1]:
        at = s >= v
        out += (y[s == v].sum() / total) * (y[at].sum() / at.sum())
    return out


@pytest.mark.parametrize("ties", [False, True])
def test_ranking_metrics_match_brute_force(spark, ties):
    df, y, s, _ = fold(spark, ties=ties)
    r = e.ranking_metrics(df, "y", "s").first()
    assert r["roc_auc"] == pytest.approx(brute_auc(y, s), abs=1e-12)
    assert r["pr_auc"] == pytest.approx(brute_ap(y, s), abs=1e-12)
    assert r["brier"] == pytest.approx(((y - s) ** 2).mean(), abs=1e-12)
    assert r["pr_auc_lift"] == pytest.approx(brute_ap(y, s) / y.mean(), abs=1e-12)


def test_one_class_has_no_ranking(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.2)], "y int, s double")
    r = e.ranking_metrics(df, "y", "s").first()
    assert r["roc_auc"] is None and r["brier"] is not None


def test_slices_mark_thin_ones(spark):
    df, y, s, _ = fold(spark)
    sliced = df.withColumn("g", F.expr("if(k < 20, 'thin', if(k % 2 = 0, 'a', 'b'))"))
    got = {r["slice"]: r for r in e.slice_metrics(sliced, "y", "s", "g").collect()}
    assert got["thin"]["too_thin_to_score"] and got["thin"]["roc_auc"] is None and got["thin"]["n"] == 20
    even = np.array([k >= 20 and k % 2 == 0 for k in range(800)])
    assert got["a"]["roc_auc"] == pytest.approx(brute_auc(y[even], s[even]), abs=1e-12)


def test_constant_scorer_captures_about_its_fraction(spark):
    df, *_ = fold(spark)
    got = e.dollars_captured(df.withColumn("s", F.lit(0.5)), "y", "s", "a", "k", 0.10).first()
    assert got["worked"] == 80 and 0.0 <= got["share"] < 0.3


def test_no_positive_dollars_gives_null(spark):
    df = spark.createDataFrame([(1, 0, 0.1, 5.0)], "k long, y int, s double, a double")
    assert e.dollars_captured(df, "y", "s", "a", "k").first()["share"] is None
    with pytest.raises(ValueError):
        e.dollars_captured(df, "y", "s", "a", "k", 0.0)


def test_calibration_has_full_bins_and_tells_true_from_doubled(spark):
    df, *_ = fold(spark, 6000)
    bins = e.calibration_bins(df, "y", "s", "k").collect()
    assert len(bins) == 10 and min(b["n"] for b in bins) >= 599
    assert e.calibration_error(e.calibration_bins(df, "y", "s", "k")).first()["ece"] < 0.03
    doubled = df.withColumn("s", F.expr("s * 2"))
    assert e.calibration_error(e.calibration_bins(doubled, "y", "s", "k")).first()["ece"] > 0.1


@pytest.mark.parametrize("ties", [False, True])
def test_cost_threshold_matches_brute_force(spark, ties):
    df, y, s, a = fold(spark, ties=ties)
    grid = e.threshold_grid(df, "y", "s", "a")
    got = e.cost_threshold(grid, 200.0, 0.3).first()
    value = np.where(y == 1, 0.3 * a - 200.0, -200.0)
    cuts = np.unique(np.quantile(s, np.linspace(0, 1, 200)))
    best = max(cuts, key=lambda t: value[s >= t].sum())
    assert got["threshold"] == pytest.approx(best, abs=1e-12)
    assert got["net_benefit"] == pytest.approx(value[s >= best].sum(), rel=1e-9)
    assert got["flagged"] == (s >= best).sum()


def test_larger_multiplier_flags_no_less(spark):
    df, *_ = fold(spark)
    sweep = e.multiplier_sweep(e.threshold_grid(df, "y", "s", "a"), 100.0, [0.01, 0.1, 1.0]).orderBy("multiplier").collect()
    shares = [r["flagged_share"] for r in sweep]
    assert shares == sorted(shares)


def test_capacity_threshold_applies_to_another_fold(spark):
    df, y, s, a = fold(spark)
    cut = e.capacity_threshold(df, "s", 0.1)
    assert cut == pytest.approx(np.quantile(s, 0.9), abs=1e-12)
    r = e.apply_threshold(df, "y", "s", "a", cut, 25.0).first()
    assert r["flagged"] == (s >= cut).sum() and r["caught"] == y[s >= cut].sum()


def test_break_even_and_multiplier(spark):
    df, y, _, a = fold(spark)
    r = e.break_even(df, "y", "a", 25.0).first()
    assert r["break_even_multiplier"] == pytest.approx(25.0 / (y.mean() * a.mean()))
    assert e.value_multiplier(0.5, 0.25) == 0.125


@pytest.mark.parametrize("ties", [False, True])
def test_bootstrap_auc_equals_weighted_brute_force(spark, ties):
    df, y, s, _ = fold(spark, 400, ties=ties)
    keys = np.array([r["h"] for r in df.orderBy("k").select(F.xxhash64("k").alias("h")).collect()])
    w = e.resample_weights(keys, 20, 11)
    got = {r["b"]: r["auc"] for r in e.bootstrap_auc(df, "y", "s", "k", 20, 11).collect()}
    for b in range(20):
        assert got[b] == pytest.approx(brute_auc(y, s, w[:, b]), abs=1e-10)


def test_resample_weights_look_poisson():
    w = e.resample_weights(np.arange(20_000), 50, 3)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03


def test_paired_difference_with_itself_is_zero(spark):
    df, *_ = fold(spark, 300)
    twin = df.withColumn("t", F.col("s"))
    r = e.paired_auc_difference(twin, "y", "s", "t", "k", 30).first()
    assert (r["point"], r["low"], r["high"]) == (0.0, 0.0, 0.0)
    c = e.paired_capture_difference(twin, "s", "t", "a", "k", 0.1, 30).first()
    assert (c["low"], c["high"]) == (0.0, 0.0)


def test_interval_contains_the_point_and_capture_is_a_share(spark):
    df, y, s, _ = fold(spark, 600)
    r = e.interval(e.bootstrap_auc(df, "y", "s", "k", 100), "auc").first()
    assert r["low"] < brute_auc(y, s) < r["high"] and r["draws"] == 100
    shares = [x["share"] for x in e.capture_resamples(df, "s", "a", "k", 0.1, 20).collect()]
    assert len(shares) == 20 and all(0 < v < 1 for v in shares)


def test_capture_resamples_match_brute_force(spark):
    from remitspark.functions.hashing import hash_long

    df, _, s, a = fold(spark, 300, ties=True)
    rows = df.orderBy("k").select(F.xxhash64("k").alias("x"), hash_long(7, "k").alias("h")).collect()
    keys, tie = np.array([r["x"] for r in rows]), np.array([r["h"] for r in rows])
    w = e.resample_weights(keys, 10, 7)
    got = {r["b"]: r["share"] for r in e.capture_resamples(df, "s", "a", "k", 0.1, 10, 7).collect()}
    order = np.lexsort((keys, tie, -s))
    for b in range(10):
        ww, aa = w[order, b], a[order]
        cut = max(1.0, np.rint(ww.sum() * 0.1))
        before = np.cumsum(ww) - ww
        inside = np.clip(cut - before, 0, ww)
        assert got[b] == pytest.approx((inside * aa).sum() / (ww * aa).sum(), rel=1e-10)


def test_value_bands_learned_on_fit_rows(spark):
    fit = spark.range(1, 101).selectExpr("cast(id as double) as v")
    out = e.value_bands(fit, spark.createDataFrame([(-5.0,), (26.0,), (95.0,), (1000.0,), (None,)], "v double"), "v", [0, 0.25, 0.5, 0.75, 0.9, 1])
    assert [r["value_band"] for r in out.orderBy(F.col("v").asc_nulls_last()).collect()] == [0, 1, 4, 4, None]


def test_concentration(spark):
    df = spark.range(1, 101).selectExpr("id as a")
    r = e.concentration(df, "a", 10).first()
    assert (r["top_k"], r["total"]) == (955.0, 5050.0)
