"""Baselines: every interval is held out once."""

import itertools

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from heliospark.operators import learning, trees
from heliospark.plans import catalogue, fixtures

SF = "/root/testdata/sf0.001"


def test_all_intervals_are_predicted(spark):
    s = fixtures.series(spark, SF)
    got = catalogue.QUERIES["ml_logistic"](spark, SF).collect()
    assert sorted(r.seq for r in got) == sorted(r.seq for r in s.collect())
    assert {(r.seq, r.fold) for r in got} == {(r.seq, r.independent_interval_id) for r in s.collect()}
    for _, rows in itertools.groupby(sorted(got, key=lambda r: (r.event_id, r.timestamp, r.seq)), key=lambda r: r.event_id):
        run = 0
        for r in rows:
            run = run + 1 if r.probability >= 0.5 else 0
            assert (r.raw_predicted, r.predicted) == (run > 0, run >= 3)


@pytest.mark.parametrize("kind", ["logistic", "forest", "boosted"])
def test_selection_and_importances(spark, kind):
    rows = [(f"I{i % 4}", i // 4 % 2, float(i // 4 % 2 * 10 + i % 3), 1.0 if i % 4 else float(i), float(i % 5), None if i % 2 else 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "i string, t int, a double, c double, n double, e double")
    got = learning.held_out_importances(df, kind, ["a", "c", "n", "e"], "t", "i").collect()
    # c is constant without I0, e is too rare or constant everywhere
    assert {f: sorted(r.feature for r in got if r.fold == f) for f in ("I0", "I1", "I2", "I3")} == {"I0": ["a", "n"]} | dict.fromkeys(("I1", "I2", "I3"), ["a", "c", "n"])
    for f in ("I0", "I1", "I2", "I3"):
        mine = {r.feature: r for r in got if r.fold == f}
        assert sum(r.normalized_importance for r in mine.values()) == pytest.approx(1) and mine["a"].normalized_importance > 0.5
        assert all((r.signed_coefficient is None) == (kind != "logistic") for r in mine.values())


def test_forest_queries_return_all_folds(spark):
    sf = SF.replace("0.001", "0.01")
    s = fixtures.series(spark, sf)
    got = catalogue.QUERIES["ml_forest"](spark, sf).collect()
    assert sorted(r.seq for r in got) == sorted(r.seq for r in s.collect()) and {r.fold for r in got} == {"I1", "I2", "I3", "I4"}
    assert all(0 <= r.probability <= 1 for r in got)
    found = catalogue.QUERIES["ml_forest_importance"](spark, sf).collect()
    for f in ("I1", "I2", "I3", "I4"):
        assert sum(r.normalized_importance for r in found if r.fold == f) == pytest.approx(1)


def test_forest_does_not_depend_on_the_order_of_rows(spark):
    s = fixtures.series(spark, SF)
    fits = [learning.fit(d, "forest", ["x", "y"], "target") for d in (s, s.repartition(7))]
    assert fits[0].importances == fits[1].importances
    a, b = ({r.seq: r.probability for r in learning.predict(f, s).collect()} for f in fits)
    assert a == b


def test_forest_bundle(spark, tmp_path):
    s = fixtures.series(spark, SF).withColumnRenamed("y", "y.z")
    s = s.withColumnRenamed("y.z", "y")
    features = learning.refit(s, "forest", ["x", "y"], "target", str(tmp_path))
    want = {r.seq: r.probability for r in learning.predict(learning.fit(s, "forest", features, "target"), s).collect()}
    got = {r.seq: r.probability for r in learning.score_bundle(spark, str(tmp_path), s).collect()}
    assert got == want


def slow_split(x, y, w, n, leaf):
    """The best split of all by trying each value of each feature."""
    def impurity(m):
        one, zero = (w * y)[m].sum(), (w * (1 - y))[m].sum()
        return 2 * one * zero / (one + zero) if one + zero else 0.0

    best = (0.0, None, None)
    for f in range(x.shape[1]):
        for v in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= v
            if min(left.sum(), (~left).sum()) >= leaf:
                gain = impurity(np.ones(len(y), bool)) - impurity(left) - impurity(~left)
                if gain > best[0] + 1e-9:
                    best = (gain, f, v)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_first_split_is_the_best_and_leaves_are_large_enough(seed):
    r = np.random.default_rng(seed)
    x = r.integers(0, 40, (300, 3)).astype(float)
    y = ((x[:, 1] + r.normal(0, 8, 300)) > 25).astype(int)
    tree = trees.grow(x, y, np.random.default_rng(9), 3, 5)
    drawn = np.bincount(np.random.default_rng(9).integers(0, 300, 300), minlength=300)
    m = drawn > 0
    weight = drawn * (drawn.sum() / (2 * np.bincount(y, drawn, 2)))[y]
    _, f, v = slow_split(x[m], y[m], weight[m], drawn[m], 5)
    assert tree.feature[0] == f and np.array_equal(x[m][:, f] <= tree.threshold[0], x[m][:, f] <= v)
    at = np.zeros(m.sum(), int)
    for _ in range(50):
        inner = tree.feature[at] >= 0
        at = np.where(inner, tree.child[at] + (x[m][np.arange(m.sum()), np.maximum(tree.feature[at], 0)] > tree.threshold[at]), at)
    sizes = np.bincount(at, minlength=len(tree.feature))
    assert (sizes[tree.feature < 0] >= 5).all() and sizes[tree.feature >= 0].sum() == 0
    assert np.allclose(tree.scores(x[m]), tree.value[at])
    for leaf in np.flatnonzero(tree.feature < 0):
        assert tree.value[leaf] == pytest.approx((weight * y)[m][at == leaf].sum() / weight[m][at == leaf].sum())


def test_boosting_on_sums_is_boosting_on_rows(spark):
    """Trees are those of Spark on all rows, leaves of at least so many rows included."""
    r = np.random.default_rng(5)
    rows = [(float(a), float(b), int(r.random() < (0.8 if a + b % 3 > 5 else 0.2))) for a, b in zip(np.minimum(r.geometric(0.3, 6000), 12), r.integers(0, 7, 6000))]
    train = spark.createDataFrame(rows, "a double, b double, t int")
    fitted = learning.fit(train, "boosted", ["a", "b"], "t")
    n = {y: sum(x[2] == y for x in rows) for y in (0, 1)}
    plain = train.withColumn("label", F.col("t").cast("double")).withColumn("weight", F.when(F.col("t") == 1, len(rows) / (2 * n[1])).otherwise(len(rows) / (2 * n[0])))
    whole = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(plain)
    want = learning.predict(PipelineModel([learning.learner("boosted").fit(whole)]), whole.distinct())
    got = {(x.a, x.b): x.probability for x in learning.predict(fitted, train.distinct()).collect()}
    assert got == pytest.approx({(x.a, x.b): x.probability for x in want.collect()}, abs=1e-6)


def test_sums_of_rows(spark):
    """Few rows stand for many: sums are the same, and so is who has at least 20."""
    r = np.random.default_rng(7)
    rows = [(float(a), float(b), int(r.random() < 0.2)) for a, b in zip(np.minimum(r.geometric(0.3, 6000), 12), r.integers(0, 7, 6000))]
    train = spark.createDataFrame(rows, "a double, b double, t int")
    counts = train.groupBy("a", "b").agg(F.count_if(F.col("t") == 1).alias("_1"), F.count_if(F.col("t") == 0).alias("_0"))
    few = {}
    for x in learning.added_up(counts, ["a", "b"], {1.0: 3.0, 0.0: 0.5}, 20).collect():
        few.setdefault((x.a, x.b), []).append((x.label, x.weight))
    assert set(few) == {(a, b) for a, b, _ in rows}
    for x in counts.collect():
        mine = few[x.a, x.b]
        assert len(mine) == x._1 + x._0 if x._1 + x._0 < 20 else 20 <= len(mine) <= 21
        assert [sum(w for y, w in mine if y == k) for k in (1, 0)] == pytest.approx([3 * x._1, x._0 / 2])


@pytest.mark.parametrize("n", [1, 200, 256, 5000])
def test_bins(spark, n):
    """A bin for each value, or as many as may be, of about as many rows."""
    df = spark.range(n).select((F.col("id") / 3).alias("v"))
    cut = learning.binned(df, ["v"], 255)
    sizes = [r["count"] for r in cut.transform(df).groupBy("v_bin").count().collect()]
    assert len(sizes) == n if n < 255 else 250 <= len(sizes) <= 255
    assert max(sizes) <= 2 * max(1, n / 255)


def test_rows_are_scored_once(spark):
    """Runs read the scored rows twice; the scores are kept."""
    out = catalogue.QUERIES["ml_forest"](spark, SF)
    assert "InMemoryTableScan" in out._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_part_are_scored_in_many_tasks(spark):
    """A part of the input may hold all rows; each takes as long as all trees."""
    s = fixtures.series(spark, SF).coalesce(1)
    out = learning.predict(learning.fit(s, "forest", ["x", "y"], "target"), s)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) <= 2 * s.count() / len(sizes)


def test_trees_are_walked_to_their_leaves():
    """Row by row, missing and endless values too: a missing one goes left."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 3)).round(2)
    t = trees.grow(x, (x[:, 0] + rng.normal(size=2000) > 0).astype(int), rng, 1, 5)
    asked = rng.normal(size=(300, 3))
    asked[::7, 0], asked[::11, 1], asked[::13, 2] = np.nan, np.inf, -np.inf
    want = []
    for r in asked:
        at = 0
        while t.feature[at] >= 0:
            at = t.child[at] + int(r[t.feature[at]] > t.threshold[at])
        want.append(t.value[at])
    assert len(t.feature) > 50 and t.scores(asked).tolist() == want and len(t.scores(asked[:0])) == 0


def board(spark):
    """2,000 cells of 20 rows each, of either class by turns: 10,000 draws hit too few rows of a cell for a leaf."""
    rows = [(float(i % 100), float(i // 100 % 20), (i % 100 + i // 100 % 20) % 2) for i in range(40_000)]
    return spark.createDataFrame(rows, "a double, b double, t int")


@pytest.mark.parametrize("values", [None, 2_000])
def test_forest_learns_from_all_rows(spark, monkeypatch, tmp_path, values):
    """Also where cells are too many for one task, and are dealt."""
    monkeypatch.setitem(learning.FOREST, "trees", 8)
    if values:
        monkeypatch.setattr(trees, "CELL_VALUES", values)
    df = board(spark)
    fitted = learning.fit(df, "forest", ["a", "b"], "t")
    assert fitted.trees.count() == 8 if values is None else fitted.trees.count() > 16
    got = learning.predict(fitted, df.distinct()).collect()
    assert len(got) == 2000 and np.mean([abs(r.probability - r.t) for r in got]) < 0.02
    assert sum(fitted.importances) == pytest.approx(1) and min(fitted.importances) > 0.1
    fitted.save(spark, str(tmp_path))
    again = learning.predict(trees.Forest.load(spark, str(tmp_path)), df.distinct()).collect()
    assert {(r.a, r.b): r.probability for r in again} == {(r.a, r.b): r.probability for r in got}


def test_dealt_forest_does_not_depend_on_the_order_of_rows(spark, monkeypatch):
    monkeypatch.setitem(learning.FOREST, "trees", 3)
    monkeypatch.setattr(trees, "CELL_VALUES", 2_000)
    df = board(spark).withColumn("a", F.when(F.col("a") != 7, F.col("a")))
    fits = [learning.fit(d, "forest", ["a", "b"], "t") for d in (df, df.repartition(7))]
    assert fits[0].importances == fits[1].importances
    a, b = ({(r.a, r.b): r.probability for r in learning.predict(f, df.distinct()).collect()} for f in fits)
    assert a == b and len(a) == 2000


def test_a_bootstrap_has_as_many_draws_as_rows():
    """Drawn by cells, rows are hit as often as when drawn one by one."""
    zero, one = np.array([1, 0, 3, 40]), np.array([0, 2, 5, 1])
    got, want = [], []
    for i in range(4000):
        z, o, hit = trees.bootstrap(zero, one, 52, np.random.default_rng([1, i]), 30)
        assert z.sum() + o.sum() == 52 and not z[1] and not o[0]
        got.append([*z, *o, *hit])
        drawn = np.bincount(np.random.default_rng([2, i]).integers(0, 52, 52), minlength=52)
        cells = np.split(drawn, np.cumsum([1, 3, 40, 2, 5]))
        z, o = [cells[0].sum(), 0, cells[1].sum(), cells[2].sum()], [0, cells[3].sum(), cells[4].sum(), cells[5].sum()]
        want.append([*z, *o, (cells[0] > 0).sum(), (cells[3] > 0).sum(), (cells[1] > 0).sum() + (cells[4] > 0).sum(), min(30, (cells[2] > 0).sum() + (cells[5] > 0).sum())])
    got, want = np.array(got), np.array(want)
    assert np.allclose(got.mean(0), want.mean(0), atol=0.35) and np.allclose(got.std(0), want.std(0), atol=0.2)
    assert np.allclose(got[:, 8:].mean(0), want[:, 8:].mean(0), atol=0.1)


def test_bins_of_a_forest_are_of_all_rows(spark):
    """One a value where few; else of equal shares, by exact ranks; the median begins one, and stands for what is missing."""
    r = np.random.default_rng(4)
    x = np.round(np.exp(r.normal(size=20_000)) * 1e6 - 5e5)
    rows = [(float(v), None if i % 3 == 0 else float(i % 8), float("nan") if i % 2 else None, float("inf") if i % 4 == 0 else -1.0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "`a.x` double, b double, c double, d double")
    grid = trees.Grid.of(df, ["a.x", "b", "c", "d"])
    assert grid == trees.Grid.of(df.repartition(9), ["a.x", "b", "c", "d"])
    b = [v for _, v, _, _ in rows if v is not None]
    assert grid.filled == [np.median(x), np.median(b), 0.0, -1.0]
    assert grid.starts[1] == sorted({*map(float, range(8)), float(np.median(b))}) and len(grid.starts[0]) in (255, 256)
    got = [r._cell for r in grid.celled(df).select("_cell").collect()]
    sizes = np.bincount([c[0] for c in got])
    assert sizes.max() <= 2 * 20_000 / 255 and len(sizes) == len(grid.starts[0])
    want = np.searchsorted(np.array(grid.starts[0]), x, "right") - 1
    assert sorted(c[0] for c in got) == sorted(want) and len({c[3] for c in got}) == 2 and {c[2] for c in got} == {1}


@pytest.mark.parametrize("fitted_in_parts", [False, True])
def test_many_cells_are_scored_in_slices(spark, monkeypatch, fitted_in_parts):
    """A small forest may be asked for more cells than a task holds; scores are the same to the bit."""
    monkeypatch.setitem(learning.FOREST, "trees", 11)
    if fitted_in_parts:
        monkeypatch.setattr(trees, "CELL_VALUES", 2_000)
    df = board(spark)
    fitted = learning.fit(df, "forest", ["a", "b"], "t")
    scored = []
    for values in (10_000, 300):
        monkeypatch.setattr(trees, "CELL_VALUES", values)
        scored.append({(r.a, r.b): r.probability for r in learning.predict(fitted, df.distinct()).collect()})
    assert scored[0] == scored[1] and len(scored[0]) == 2000


def test_no_task_scores_all_cells(spark, monkeypatch):
    monkeypatch.setitem(learning.FOREST, "trees", 3)
    df = board(spark)
    fitted = learning.fit(df, "forest", ["a", "b"], "t")
    monkeypatch.setattr(trees, "CELL_VALUES", 300)
    seen, real = [], trees.Forest._dealt
    monkeypatch.setattr(trees.Forest, "_dealt", lambda self, cells, whole, slices: seen.append(slices) or real(self, cells, whole, slices))
    learning.predict(fitted, df).count()
    assert seen == [14]
