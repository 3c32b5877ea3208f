"""Churn classifiers, cross-validation, sweeps and the propensity table.

A classifier is a function ``fit(train, n) -> predict``. Training rows have ID_CLI, label and
the scaled vector ``features``; ``predict`` adds prediction and score to a frame of the same form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    LogisticRegressionModel,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopsight.operators import forest
from shopsight.operators import logistic as by_sums
from shopsight.operators.evaluate import binary_metrics, confusion, roc_auc_by
from shopsight.operators.features import Scaler, decile_ranks
from shopsight.operators.neighbours import nearest, votes
from shopsight.session import materialize, scratch_path

Predict = Callable[[DataFrame], DataFrame]
Fit = Callable[[DataFrame, int], Predict]

# Inverse regularisation strengths of the grid search.
C_GRID = [0.0001, 0.001, 0.01, 0.02, 0.05]


def _probability(model) -> Predict:
    return lambda df: model.transform(df).withColumn("score", vector_to_array("probability")[1])


def _margin(model) -> Predict:
    return lambda df: model.transform(df).withColumn("score", vector_to_array("rawPrediction")[1])


@dataclass(frozen=True)
class Logistic:
    """L2 logistic regression; strength C over n rows is a penalty of 1 / (C n)."""

    c: float = 1.0
    balanced: bool = False

    def __call__(self, train: DataFrame, n: int) -> Predict:
        return _probability(fit_logistic(train, n, self.c, self.balanced))


def logistic(c: float = 1.0, balanced: bool = False) -> Fit:
    return Logistic(c, balanced)


def fit_logistic(train: DataFrame, n: int, c: float = 1.0, balanced: bool = False):
    estimator = LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=100, tol=_LOGISTIC_TOLERANCE)
    if balanced:
        sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
        weight = F.lit(1.0)
        for label, size in sizes.items():
            weight = F.when(F.col("label") == label, n / (len(sizes) * size)).otherwise(weight)
        train = train.withColumn("weight", weight)
        estimator = estimator.setWeightCol("weight")
    return estimator.fit(train)


def _gathered(train: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows in no more tasks than their number needs.

    A linear machine passes over its rows for every step, so each spare task costs its start a hundred times. Its
    sums don't depend on the layout but for rounding.
    """
    return train.coalesce(max(1, -(-n // _ROWS_PER_TASK)))


def linear_svm(c: float = 1.0) -> Fit:
    def fit(train: DataFrame, n: int) -> Predict:
        return _margin(LinearSVC(
            regParam=1.0 / (c * n), standardization=False, maxIter=100, tol=_SVM_TOLERANCE).fit(_gathered(train, n)))
    return fit


def kernel_svm(c: float = 1.0, components: int = 200, seed: int = 0) -> Fit:
    """Radial-kernel machine as random Fourier features and a linear machine; approximate by design."""
    def fit(train: DataFrame, n: int) -> Predict:
        width = train.select("features").first()["features"].size
        fourier = _fourier_map(width, components, seed)
        model = LinearSVC(
            regParam=1.0 / (c * n), standardization=False, maxIter=100, tol=_SVM_TOLERANCE).fit(fourier(_gathered(train, n)))
        return lambda df: _margin(model)(fourier(df))
    return fit


def _fourier_map(width: int, components: int, seed: int) -> Predict:
    """x to sqrt(2/D) cos(Wx + b), W drawn for a kernel of scale 1/width."""
    draw = np.random.default_rng(seed)
    weights = draw.normal(0.0, np.sqrt(2.0 / width), (width, components))
    shift = draw.uniform(0.0, 2 * np.pi, components)

    @F.pandas_udf("array<double>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            waves = np.cos(np.stack(x.to_numpy()) @ weights + shift) * np.sqrt(2.0 / components) if len(x) else []
            yield pd.Series(list(waves), dtype=object)

    return lambda df: df.withColumn("features", array_to_vector(project(vector_to_array("features"))))


def knn(k: int = 5) -> Fit:
    def fit(train: DataFrame, n: int) -> Predict:
        point = vector_to_array("features").alias("x")
        known = train.select(F.col("ID_CLI").alias("train_id"), point, "label")

        def predict(df: DataFrame) -> DataFrame:
            near = nearest(df.select(F.col("ID_CLI").alias("query_id"), point), known, k)
            voted = votes(near, [k]).select(
                F.col("query_id").alias("ID_CLI"), F.col("prediction").cast("double"), "score")
            return df.join(voted, "ID_CLI")
        return predict
    return fit


@dataclass(frozen=True)
class Bayes:
    """Gaussian naive Bayes."""

    def __call__(self, train: DataFrame, n: int) -> Predict:
        return _probability(NaiveBayes(modelType="gaussian").fit(train))


def naive_bayes() -> Fit:
    return Bayes()


def decision_tree(max_depth: int = 30, seed: int = 0) -> Fit:
    return _grown_or(1, max_depth, seed, DecisionTreeClassifier(impurity="entropy", maxDepth=max_depth, seed=seed))


def random_forest(trees: int = 100, max_depth: int = 30, seed: int = 0) -> Fit:
    return _grown_or(trees, max_depth, seed, _forest(trees, max_depth, seed))


def _grown_or(trees: int, max_depth: int, seed: int, built_in) -> Fit:
    """The built-in trees for rows of one task or for more than packed rows may take, else trees grown in tasks."""
    def fit(train: DataFrame, n: int) -> Predict:
        if n > _ROWS_PER_TASK:
            width = train.select("features").first()["features"].size
            if n * width <= forest.MOST_PACKED:
                return forest.fit(train, n, width, trees, max_depth, seed)
        return _probability(built_in.fit(train))
    return fit


def _forest(trees: int, max_depth: int, seed: int, impurity: str = "entropy") -> RandomForestClassifier:
    # with the nodes of the rows kept beside them, tasks are not sent the trees grown so far; the trees are the same
    return RandomForestClassifier(impurity=impurity, numTrees=trees, maxDepth=max_depth, seed=seed, cacheNodeIds=True)


def first_round() -> dict[str, Fit]:
    """The classifiers of the cross-validated comparison."""
    return {
        "Logistic Regression": logistic(balanced=True),
        "SVC": linear_svm(),
        "Kernel SVM": kernel_svm(),
        "KNN": knn(5),
        "Gaussian NB": naive_bayes(),
        "Decision Tree Classifier": decision_tree(),
        "Random Forest": random_forest(100),
    }


def second_round() -> dict[str, Fit]:
    """The tuned classifiers of the holdout comparison."""
    return {
        "Logistic Regression": logistic(),
        "SVC": linear_svm(),
        "Kernel SVM": kernel_svm(),
        "KNN": knn(22),
        "Gaussian NB": naive_bayes(),
        "Decision Tree Classifier": decision_tree(),
        "Random Forest": random_forest(72),
    }


# Where the optimisers stop.
_LOGISTIC_TOLERANCE = 1e-4
_SVM_TOLERANCE = 1e-3

TRAINING_PARTITIONS = "spark.shopsight.trainingPartitions"
_ROWS_PER_TASK = 50_000


def training_layout(df: DataFrame, key: str = "ID_CLI") -> DataFrame:
    """Rows dealt out and ordered by key over a number of partitions that follows from their number alone.

    Bagging draws per partition, so the trees depend on the layout; this one is the same for any
    input order, any number of input or shuffle partitions and any cluster, and grows with the rows.
    A setting may name another number.
    """
    named = df.sparkSession.conf.get(TRAINING_PARTITIONS, None)
    parts = int(named) if named else max(8, -(-df.count() // _ROWS_PER_TASK))
    return df.repartition(parts, key).sortWithinPartitions(key)


def _scaled_fit(fit: Fit, train: DataFrame, test: DataFrame, scaler: Scaler | None = None) -> DataFrame:
    """Scale by the training rows, fit, and predict the test rows."""
    scaler = scaler or Scaler.fit(train)
    return fit(scaler.apply(train), scaler.n)(scaler.apply(test))


def _score_all(spark: SparkSession, tasks: Sequence[tuple[str, int, Fit, DataFrame, DataFrame, Scaler | None]],
               parallelism: int) -> DataFrame:
    """Fit every (model, fold, fit, train, test, scaler) and gather the test scores as one table.

    The fits run side by side from a few driver threads, as the built-in tuner does. Each writes its
    scores to a folder of its own, so all of them are evaluated together by a few grouped jobs.
    """
    path = scratch_path(spark, "scores")

    def one(place: int) -> None:
        _, _, fit, train, test, scaler = tasks[place]
        _scaled_fit(fit, train, test, scaler).select("label", "prediction", "score").write.parquet(f"{path}/task={place}")

    with ThreadPool(parallelism) as pool:
        pool.map(inheritable_thread_target(spark)(one), range(len(tasks)), chunksize=1)
    return _named(spark.read.schema("label double, prediction double, score double, task int").parquet(path),
                  "task", [(name, fold) for name, fold, *_ in tasks])


def _named(scored: DataFrame, place: str, names: Sequence[tuple[str, int]]) -> DataFrame:
    """Scores with the model and fold that stand at their place."""
    table = F.array(*[F.struct(F.lit(name).alias("model"), F.lit(fold).alias("fold")) for name, fold in names])
    return scored.select(table[F.col(place)].alias("t"), "label", "prediction", "score").select(
        "t.*", "label", "prediction", "score")


def _scores_by_sums(points: DataFrame, known: by_sums.Moments, classifiers: dict[str, Fit], folds: Sequence[int]) -> DataFrame:
    """Scores of logistic regressions and naive Bayes in every fold: one scan per Newton step for all of them."""
    names = [(name, fold) for name in classifiers for fold in folds]
    problems = [by_sums.Problem(fold, fit.c, fit.balanced) for fit in classifiers.values() if isinstance(fit, Logistic) for fold in folds]
    weights = iter(by_sums.fit_all(points, problems, known) if problems else ())
    odds = [(fold, by_sums.linear_score(next(weights)) if isinstance(classifiers[name], Logistic)
             else by_sums.bayes_score(known, fold)) for name, fold in names]
    return _named(by_sums.scored(points, odds), "place", names)


def cross_validate(rows: DataFrame, classifiers: dict[str, Fit], folds: int = 10,
                   parallelism: int = 8) -> DataFrame:
    """Accuracy, balanced accuracy and AUC per (model, fold); ``rows`` has a fold column.

    The scaler is fitted inside every fold. Scalers, logistic regressions and naive Bayes come from
    sums per fold while the features are no more than ``WIDEST``; other models are fitted fold by fold.
    """
    rows = training_layout(rows).persist()
    first = rows.select("x").first()
    few = first is not None and first["x"].size <= by_sums.WIDEST
    summed = {name: fit for name, fit in classifiers.items() if few and isinstance(fit, (Logistic, Bayes))}
    scaler: dict[int, Scaler] = {}
    scored = None
    if few:
        points = by_sums.points(rows).persist()
        known = by_sums.moments(points)
        for fold in known.folds:
            n, *_, std = known.without(fold)
            scaler[fold] = Scaler(int(n.sum()), std.tolist())
        if summed:
            scored = materialize(_scores_by_sums(points, known, summed, known.folds), "scores")
        points.unpersist()
    tasks = [(name, fold, fit, rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold), scaler.get(fold))
             for name, fit in classifiers.items() if name not in summed for fold in range(folds)]
    if tasks:
        rest = _score_all(rows.sparkSession, tasks, parallelism)
        scored = rest if scored is None else scored.unionByName(rest)
    rows.unpersist()
    by = ("model", "fold")
    return binary_metrics(confusion(scored, by=by), by).select(*by, "accuracy", "balanced_accuracy").join(
        roc_auc_by(scored, by, "label", "score"), list(by))


def fold_accuracy(rows: DataFrame) -> DataFrame:
    """Rows and right predictions of Gaussian naive Bayes per fold: (fold, n, n_right, accuracy)."""
    points = by_sums.points(rows)
    known = by_sums.moments(points)
    scored = _scores_by_sums(points, known, {"Gaussian NB": naive_bayes()}, known.folds)
    hit = (F.col("prediction") == F.col("label")).cast("long")
    return scored.groupBy("fold").agg(F.count("*").alias("n"), F.sum(hit).alias("n_right")).withColumn(
        "accuracy", F.col("n_right") / F.col("n"))


def cv_summary(scores: DataFrame) -> DataFrame:
    """Mean and deviation over the folds in percent, best AUC first."""
    def percent(value: Column) -> Column:
        return F.bround(value * 100, 2)
    return scores.groupBy("model").agg(
        percent(F.avg("auc")).alias("auc_mean"), percent(F.stddev_pop("auc")).alias("auc_std"),
        percent(F.avg("accuracy")).alias("accuracy_mean"),
        percent(F.stddev_pop("accuracy")).alias("accuracy_std")).orderBy(F.desc("auc_mean"), "model")


def holdout(train: DataFrame, test: DataFrame, classifiers: dict[str, Fit], parallelism: int = 8) -> DataFrame:
    """Test metrics per model, best precision first."""
    train = training_layout(train)
    scaler = Scaler.fit(train)
    tasks = [(name, 0, fit, train, test, scaler) for name, fit in classifiers.items()]
    scored = _score_all(train.sparkSession, tasks, parallelism)
    return binary_metrics(confusion(scored, by=["model"]), ["model"]).select(
        "model", "accuracy", "precision", "recall", "f1", "f2"
    ).orderBy(F.desc("precision"), F.desc("recall"), F.desc("f2"), "model")


def grid_search(rows: DataFrame, grid: Sequence[float] = C_GRID, folds: int = 10,
                parallelism: int = 8) -> DataFrame:
    """Mean balanced accuracy per C over the folds, best first, then the smallest C."""
    scores = cross_validate(rows, {str(c): logistic(c) for c in grid}, folds, parallelism)
    return scores.groupBy(F.col("model").cast("double").alias("C")).agg(
        F.avg("balanced_accuracy").alias("balanced_accuracy")).orderBy(F.desc("balanced_accuracy"), "C")


def use_best(grid: DataFrame, rows: DataFrame) -> tuple[float, Predict]:
    """The best C of :func:`grid_search` and a regression of that strength on all rows, ready to predict."""
    best = grid.orderBy(F.desc("balanced_accuracy"), "C").first()["C"]
    rows = training_layout(rows)
    scaler = Scaler.fit(rows)
    predict = logistic(best)(scaler.apply(rows), scaler.n)
    return best, lambda df: predict(scaler.apply(df))


@dataclass(frozen=True)
class Trees:
    """An ensemble as flat arrays: feature, threshold, left and right child and P(1) of every node, roots first to last.

    A node takes 32 bytes and the nodes number at most twice the training rows times the trees; leaves
    are their own children.
    """

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    chance: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """P(1) per row and tree; all rows go down all trees a level at a time."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        row = np.arange(len(x))[:, None]
        while True:
            down = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            if np.array_equal(down, at):
                return self.chance[at]
            at = down


def flat_trees(model) -> Trees:
    """The node arrays of a fitted tree ensemble, read from its stored form."""
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "forest")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").select(
        "treeID", "id", "leftChild", "rightChild", "impurityStats", F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"))
    table = nodes.toPandas().sort_values(["treeID", "id"]).reset_index(drop=True)
    own = np.arange(len(table))
    start = table.groupby("treeID")["id"].transform("size").to_numpy()
    roots = np.flatnonzero(table["id"].to_numpy() == 0)
    first = np.repeat(roots, start[roots])
    left, right = table["leftChild"].to_numpy(), table["rightChild"].to_numpy()
    inner = left >= 0
    weight = np.stack(table["impurityStats"].to_numpy())
    return Trees(roots, np.where(inner, table["feature"], 0), np.where(inner, table["threshold"].fillna(0.0), 0.0).astype(float),
                 np.where(inner, first + left, own), np.where(inner, first + right, own), weight[:, 1] / weight.sum(axis=1))


def forest_sweep(train: DataFrame, test: DataFrame, trees: int = 99, max_depth: int = 30,
                 seed: int = 1) -> DataFrame:
    """Test accuracy of the first 1..trees trees of one forest, fitted once.

    All trees are evaluated in one pass over the test rows, which hands out one count per prefix and task.
    """
    train = training_layout(train)
    scaler = Scaler.fit(train)
    model = _forest(trees, max_depth, seed, "gini").fit(scaler.apply(train))
    sent = train.sparkSession.sparkContext.broadcast(flat_trees(model))

    def count(batches):
        flat, hits, n = sent.value, 0, 0
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.iloc[start:start + 1024]
                share = np.cumsum(flat.leaves(np.stack(part["x"].to_numpy())), axis=1) / np.arange(1, len(flat.roots) + 1)
                hits = hits + ((share > 0.5) == (part["label"].to_numpy() == 1)[:, None]).sum(axis=0)
                n += len(part)
        if n:
            yield pd.DataFrame({"trees": np.arange(1, len(flat.roots) + 1), "hits": hits, "n": n})

    points = scaler.apply(test).select("label", vector_to_array("features").alias("x"))
    return points.mapInPandas(count, "trees int, hits long, n long").groupBy("trees").agg(
        (F.sum("hits") / F.sum("n")).alias("accuracy"))


@dataclass(frozen=True)
class Fitted:
    """A fitted logistic regression with its scaler and feature names."""

    names: list[str]
    scaler: Scaler
    model: LogisticRegressionModel

    @staticmethod
    def fit(train: DataFrame, names: Sequence[str], c: float = 1.0) -> Fitted:
        train = training_layout(train)
        scaler = Scaler.fit(train)
        return Fitted(list(names), scaler, fit_logistic(scaler.apply(train), scaler.n, c))

    def save(self, path: str) -> None:
        """Write the model, and one row with what its input needs, below ``path``."""
        spark = SparkSession.getActiveSession()
        self.model.write().save(f"{path}/model")
        spark.createDataFrame([(self.names, self.scaler.n, self.scaler.std)], _FITTED).write.parquet(f"{path}/input")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Fitted:
        row = spark.read.schema(_FITTED).parquet(f"{path}/input").first()
        return Fitted(row["names"], Scaler(row["n"], row["std"]), LogisticRegressionModel.load(f"{path}/model"))

    def predict(self, df: DataFrame) -> DataFrame:
        return _probability(self.model)(self.scaler.apply(df))


_FITTED = "names array<string>, n long, std array<double>"


def propensity(fitted: Fitted, test: DataFrame) -> DataFrame:
    """Predictions and churn probability in percent for the held-out customers."""
    return fitted.predict(test).select(
        "ID_CLI", F.col("label").cast("int").alias("CHURN"), F.col("prediction").cast("int").alias("predictions"),
        F.bround(F.col("score") * 100, 2).alias("propensity_to_churn"))


def propensity_deciles(scored: DataFrame) -> DataFrame:
    """Adds the decile of the score, 1 for the highest."""
    return decile_ranks(scored, "propensity_to_churn", "ID_CLI")


def coefficients(fitted: Fitted) -> DataFrame:
    """Logistic coefficients by feature name, largest first: one row per feature."""
    rows = [(name, float(value)) for name, value in zip(fitted.names, fitted.model.coefficients)]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, coef double").orderBy(F.desc("coef"), "feature")
