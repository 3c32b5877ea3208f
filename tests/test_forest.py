"""Trees grown in tasks against the built-in ones."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from shopsight.operators import evaluate, forest, models


def made(n, seed):
    draw = np.random.default_rng(seed)
    x = np.c_[draw.integers(0, 30, n), draw.integers(0, 2, (n, 3)), draw.integers(0, 5, n) * 0.25, np.full(n, 4.0)].astype(float)
    odds = 0.1 * (x[:, 0] - 15) + 2 * x[:, 1] * x[:, 2] - x[:, 4]
    return x, (draw.random(n) < 1 / (1 + np.exp(-2 * odds))).astype(float)


@pytest.fixture(scope="module")
def rows(spark):
    x, y = made(1500, 3)
    data = [(i, float(b), a.tolist(), i % 3) for i, (a, b) in enumerate(zip(x, y))]
    return models.training_layout(spark.createDataFrame(data, "ID_CLI long, label double, a array<double>, part int").select(
        "ID_CLI", "label", array_to_vector("a").alias("features"), "part")).persist()


def scores(df):
    return df.select("ID_CLI", "label", "prediction", "score").toPandas().set_index("ID_CLI").sort_index()


@pytest.mark.parametrize("depth", [3, 30])
def test_one_tree_equals_the_built_in_tree(rows, depth):
    ours = scores(forest.fit(rows, 1500, 6, 1, depth, 0)(rows))
    theirs = scores(models._probability(DecisionTreeClassifier(impurity="entropy", maxDepth=depth).fit(rows))(rows))
    # splits of equal gain may be told apart by rounding alone
    same = np.isclose(ours["score"], theirs["score"], atol=1e-6)
    assert same.mean() > (0.999 if depth == 3 else 0.9) and (ours["prediction"] == theirs["prediction"]).mean() > 0.97


def test_many_rows_need_no_trees_on_the_driver(rows, monkeypatch):
    train, test = rows.where("part < 2"), rows.where("part = 2")
    theirs = models.random_forest(30, 8)(train, 1000)(test).select("label", "score", F.lit(1).alias("g"))
    want = evaluate.roc_auc_by(theirs, ["g"], "label", "score").first().auc

    def refuse(self, table):
        raise AssertionError("grown on the driver")

    monkeypatch.setattr(models, "_ROWS_PER_TASK", 500)
    monkeypatch.setattr(RandomForestClassifier, "fit", refuse)
    monkeypatch.setattr(DecisionTreeClassifier, "fit", refuse)
    predict = models.random_forest(30, 8)(train, 1000)
    one = scores(predict(test))
    found = evaluate.roc_auc_by(predict(test).withColumn("g", F.lit(1)), ["g"], "label", "score").first().auc
    assert found == pytest.approx(want, abs=0.02) and ((one["score"] > 0.5) == (one["prediction"] == 1)).all()
    monkeypatch.setattr(forest, "_GROUP_BYTES", 4000)  # several groups of trees, and the same forest again
    assert scores(models.random_forest(30, 8)(train, 1000)(test))["score"].tolist() == pytest.approx(one["score"].tolist())
    assert scores(models.decision_tree(4)(train, 1000)(test))["score"].between(0, 1).all()


def test_nodes_in_chunks_and_merged_leaves(monkeypatch):
    x, y = made(800, 5)
    cuts = forest.cuts(x)
    assert [len(c) for c in cuts] == [29, 1, 1, 1, 4, 0]
    assert len(forest.cuts(np.random.default_rng(0).random((500, 1)))[0]) == 31
    packed, bins = forest.binned(x, cuts), np.array([len(c) + 1 for c in cuts])

    def tree():
        return forest.grow(packed, y.astype(np.uint8), np.ones(800), bins, 6, 30, np.random.default_rng(0))

    whole = tree()
    monkeypatch.setattr(forest, "_CELLS", 64)
    assert np.array_equal(whole, tree())
    inner = whole["left"] >= 0
    low = whole["left"][inner]
    leaves = ~inner[low] & ~inner[low + 1]
    assert ((whole["chance"][low] > 0.5) != (whole["chance"][low + 1] > 0.5))[leaves].all()
    # every leaf holds the share of its rows, or a parent's of merged leaves
    chance = forest.chances(whole, packed)
    for value in np.unique(chance)[:20]:
        assert y[chance == value].mean() == pytest.approx(value, abs=1e-6)
