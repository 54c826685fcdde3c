import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from remitspark.operators import boosting, modeling


@pytest.fixture(scope="module")
def few(spark):
    """Few-valued slots, a one-hot group, a constant slot: every split that Spark's trees may choose is known here too."""
    rng = np.random.default_rng(4)
    n = 3000
    group = rng.integers(0, 5, n)
    x = np.c_[rng.integers(0, 12, n), np.eye(5)[group], rng.integers(-3, 4, n) / 2, np.ones(n), rng.random(n) < 0.3]
    p = 1 / (1 + np.exp(1.5 - 0.2 * x[:, 0] - 1.1 * (group == 2) + 0.5 * x[:, 6] * x[:, 8]))
    rows = [(i, float(t), Vectors.dense(v)) for i, (v, t) in enumerate(zip(x.tolist(), (rng.random(n) < p).astype(int)))]
    return spark.createDataFrame(rows, ["k", "y", "features"]).repartition(3).cache()


def scores(model, rows):
    got = model.transform(rows).select("k", vector_to_array("probability")[1].alias("p")).collect()
    return np.array([r["p"] for r in sorted(got, key=lambda r: r["k"])])


def test_without_draws_the_trees_are_those_of_spark(few):
    mine = modeling.fit_boosted(few, "y", trees=12, depth=3, step=0.1, subsample=1.0, columns=1.0, min_rows=20)
    theirs = GBTClassifier(labelCol="y", maxIter=12, maxDepth=3, stepSize=0.1, subsamplingRate=1.0, featureSubsetStrategy="all", minInstancesPerNode=20).fit(few)
    assert mine.getNumTrees == 12
    assert scores(mine, few) == pytest.approx(scores(theirs, few), abs=1e-5)


def test_a_fit_does_not_depend_on_how_rows_are_dealt(few):
    fit = lambda rows: modeling.fit_boosted(rows, "y", trees=7, depth=3, key="k")
    state = lambda m: m.getOrDefault(m.state)
    assert state(fit(few)) == state(fit(few.orderBy("features").coalesce(1))) == state(fit(few.repartition(9)))


def test_sums_worked_out_anew_change_nothing(few):
    options = dict(trees=7, depth=3, step=0.1, subsample=0.8, columns=0.8, min_rows=20, seed=3)
    a, b = (boosting.fit_trees(few, "y", "k", **options, refresh=r) for r in (2, 100))
    assert a.getOrDefault(a.state) == b.getOrDefault(b.state)


def test_a_saved_model_scores_alike(few, tmp_path):
    model = modeling.fit_boosted(few, "y", trees=3, key="k")
    model.write().overwrite().save(f"file://{tmp_path}/m")
    assert (scores(boosting.BoostedTrees.load(f"file://{tmp_path}/m"), few) == scores(model, few)).all()


def test_slots_of_which_one_is_set_share_a_field(few):
    layout = boosting.layout_of(few.select(vector_to_array("features").alias("x")))
    assert layout.owner[7] == -1 and len(set(layout.owner[1:6])) == 1 and layout.member[1:6] == [1, 2, 3, 4, 5]
    assert layout.codes == 1  # 4 + 3 + 3 + 1 bits
    x = np.array([r[0].toArray() for r in few.select("features").collect()])
    codes = layout.pack(x)
    for s, cuts in enumerate(layout.cuts):
        for b, cut in enumerate(cuts):
            assert (layout.right(codes, s, b) == (x[:, s] > cut)).all()


def test_many_values_are_cut_at_exact_quantiles_and_few_rows_are_not_split(spark):
    rows = spark.range(1001).selectExpr("id as k", "cast(id < 400 as int) as y", "array(cast(id as double), 0D) as x")
    layout = boosting.layout_of(rows)
    assert layout.cuts[0].tolist() == pytest.approx([1000 * k / 32 for k in range(1, 32)]) and not len(layout.cuts[1])
    small = spark.createDataFrame([(i, i % 2, Vectors.dense([float(i % 2)])) for i in range(30)], ["k", "y", "features"])
    model = modeling.fit_boosted(small, "y", trees=1, subsample=1.0, columns=1.0)
    assert not model.trees[0][0].splits and scores(model, small) == pytest.approx(0.5)
    with pytest.raises(ValueError, match="no rows"):
        modeling.fit_boosted(small.limit(0), "y", trees=1)
    one = modeling.fit_boosted(small.where("y = 1"), "y", trees=2, subsample=1.0)  # one label, no slot with two values
    assert [t.splits for t, _ in one.trees] == [{}, {}] and (scores(one, small) > 0.8).all()
