"""Models from sums per fold against separate fits, flat trees, layouts, and the refit."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from shopsight.operators import features, logistic, models


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(12)
    n = 600
    x = np.c_[draw.normal(3, 2, n), draw.integers(0, 2, n), draw.normal(0, 50, n), np.full(n, 4.0), draw.exponential(1, n)]
    odds = 0.8 * (x[:, 0] - 3) + x[:, 1] - 0.02 * x[:, 2] - 0.7
    label = (draw.random(n) < 1 / (1 + np.exp(-odds))).astype(float)
    data = [(i, float(label[i]), x[i].tolist(), i % 4) for i in range(n)]
    frame = spark.createDataFrame(data, "ID_CLI long, label double, a array<double>, fold int")
    return frame.select("ID_CLI", "label", array_to_vector("a").alias("x"), "fold").cache()


@pytest.mark.parametrize("balanced", [False, True])
def test_regressions_of_all_folds_equal_separate_fits(rows, balanced):
    problems = [logistic.Problem(fold, c, balanced) for fold in (0, 2, None) for c in (0.001, 0.05, 1.0)]
    weights = logistic.fit_all(logistic.points(rows), problems)
    for problem, found in zip(problems, weights):
        train = rows if problem.fold is None else rows.where(F.col("fold") != problem.fold)
        scaler = features.Scaler.fit(train)
        model = models.fit_logistic(scaler.apply(train), scaler.n, problem.c, balanced)
        want = np.r_[model.coefficients.toArray() / scaler.std, model.intercept]
        x = np.array([r.x.toArray() for r in train.collect()])
        # a constant column and the intercept can share what they give; the scores can't
        assert x @ found[:-1] + found[-1] == pytest.approx(x @ want[:-1] + want[-1], abs=0.02)


def test_bayes_of_all_folds_equals_the_built_in_one(rows):
    some = rows.withColumn("x", array_to_vector(F.slice(models.vector_to_array("x"), 1, 3)))
    points = logistic.points(some)
    known = logistic.moments(points)
    assert known.folds == [0, 1, 2, 3] and known.n.sum() == 600
    got = {(r.fold, r.n, r.n_right) for r in models.fold_accuracy(some).collect()}
    for fold in range(4):
        train, test = some.where(F.col("fold") != fold), some.where(F.col("fold") == fold)
        right = models._scaled_fit(models.naive_bayes(), train, test).where("prediction = label").count()
        assert (fold, test.count(), right) in got


def test_cross_validation_by_sums_equals_fold_by_fold(rows, monkeypatch):
    fits = {"Logistic Regression": models.logistic(0.5), "Gaussian NB": models.naive_bayes()}
    summed = {(r.model, r.fold): r for r in models.cross_validate(rows, fits, folds=4).collect()}
    monkeypatch.setattr(logistic, "WIDEST", 2)
    for r in models.cross_validate(rows, fits, folds=4).collect():
        assert (r.accuracy, r.auc) == pytest.approx((summed[r.model, r.fold].accuracy, summed[r.model, r.fold].auc), abs=0.03)


def test_flat_trees_give_the_probabilities_of_the_trees(rows):
    model = models._forest(7, 6, 3).fit(rows.withColumnRenamed("x", "features"))
    flat = models.flat_trees(model)
    x = np.array([r.x.toArray() for r in rows.orderBy("ID_CLI").collect()])
    got = flat.leaves(x)
    for i, tree in enumerate(model.trees):
        want = [r[0][1] for r in tree.transform(rows.withColumnRenamed("x", "features")).orderBy("ID_CLI").select("probability").collect()]
        assert got[:, i] == pytest.approx(want)


def test_sweep_counts_every_prefix(rows):
    train, test = rows.where("fold < 3"), rows.where("fold = 3")
    sweep = {r.trees: r.accuracy for r in models.forest_sweep(train, test, trees=5, max_depth=4).collect()}
    scaler = features.Scaler.fit(models.training_layout(train))
    model = models._forest(5, 4, 1, "gini").fit(scaler.apply(models.training_layout(train)))
    scored = model.transform(scaler.apply(test))
    assert sorted(sweep) == [1, 2, 3, 4, 5]
    assert sweep[5] == pytest.approx(scored.where("prediction = label").count() / test.count())


def test_the_same_forest_on_any_number_of_partitions(rows, spark):
    x = np.array([r.x.toArray() for r in rows.collect()])
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for parts in (4, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        train = models.training_layout(rows.repartition(parts)).withColumnRenamed("x", "features")
        found.append(models.flat_trees(models._forest(6, 8, 0).fit(train)).leaves(x))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert np.array_equal(*found)


def test_layout_grows_with_the_rows(rows, monkeypatch):
    monkeypatch.setattr(models, "_ROWS_PER_TASK", 50)
    assert models.training_layout(rows).rdd.getNumPartitions() == 12


def test_refit_with_the_best_strength(rows):
    grid = models.grid_search(rows, [0.0001, 0.01, 1.0], folds=4)
    best, predict = models.use_best(grid, rows)
    assert best == grid.collect()[0].C
    scaler = features.Scaler.fit(rows)
    want = models.logistic(best)(models.training_layout(scaler.apply(rows)), scaler.n)(scaler.apply(rows))
    got = {r.ID_CLI: r.score for r in predict(rows).collect()}
    assert got == pytest.approx({r.ID_CLI: r.score for r in want.collect()}, abs=1e-6)
