import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopsight.operators import evaluate, features, models, neighbours, stats
from shopsight.plans import pipelines, queries


def test_dummies_drop_the_first_level(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "ID_CLI long, c string")
    assert {r.ID_CLI: r.c_b for r in features.dummies(df, ["c"]).collect()} == {1: 1, 2: 0, 3: 0}


def test_standardise_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    rows = features.standardise(df, ["a", "b"]).orderBy("a").collect()
    assert [r.a for r in rows] == pytest.approx([-1.2247448714, 0, 1.2247448714])
    assert [r.b for r in rows] == [0, 0, 0]
    scaler = features.Scaler.fit(df.select(array_to_vector(F.array("a", "b")).alias("x")))
    assert scaler.std == pytest.approx([np.std([1, 2, 3]), 1.0])


def test_design_has_no_limit_of_levels(spark):
    df = spark.range(20_000).selectExpr("id as ID_CLI", "cast(id % 2 as int) as CHURN", "id as v",
                                        "if(id = 7, null, concat('level_', id)) as c")
    plan = features.design(df, ["v"], ["c"])
    assert len(plan.names) == 1 + 19_998 and "c_level_0" not in plan.names
    rows = {r.ID_CLI: r.x for r in plan.rows.where("ID_CLI in (0, 7, 19)").collect()}
    assert [rows[i].numNonzeros() for i in (0, 7, 19)] == [0, 1, 2]
    assert rows[19].size == len(plan.names) and rows[19][plan.names.index("c_level_19")] == 1


def test_trees_do_not_depend_on_the_shuffle(spark):
    rows = [(i, float(i % 3 == 0), Vectors.dense([float(i % 7), float(i * 37 % 101)])) for i in range(600)]
    df = spark.createDataFrame(rows, T.StructType([
        T.StructField("ID_CLI", T.LongType()), T.StructField("label", T.DoubleType()), T.StructField("x", VectorUDT())]))
    before, scores = spark.conf.get("spark.sql.shuffle.partitions"), []
    for parts in ("4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found = models._scaled_fit(models.random_forest(10, 5), models.training_layout(df.repartition(int(parts))), df)
        scores.append({r.ID_CLI: r.score for r in found.select("ID_CLI", "score").collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert scores[0] == scores[1]


def test_fits_send_no_trees_and_start_no_spare_tasks(spark, monkeypatch):
    rows = [(i, float(i * 37 % 101 > 50), Vectors.dense([float(i % 7), float(i * 37 % 101) / 50])) for i in range(300)]
    df = spark.createDataFrame(rows, T.StructType([
        T.StructField("ID_CLI", T.LongType()), T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())]))
    train = df.repartition(8, "ID_CLI").sortWithinPartitions("ID_CLI").persist()
    kept = models._forest(5, 6, 0)
    assert kept.getCacheNodeIds()
    assert kept.fit(train).toDebugString == kept.copy().setCacheNodeIds(False).fit(train).toDebugString
    tasks, fit = [], models.LinearSVC.fit
    monkeypatch.setattr(models.LinearSVC, "fit", lambda self, table: tasks.append(table.rdd.getNumPartitions()) or fit(self, table))
    few = models.linear_svm()(train, 300)(df).select("ID_CLI", "score").toPandas().set_index("ID_CLI")["score"]
    models.kernel_svm(components=10)(train, 300)
    monkeypatch.setattr(models, "_ROWS_PER_TASK", 30)  # ten tasks by the rows: the eight stay
    many = models.linear_svm()(train, 300)(df).select("ID_CLI", "score").toPandas().set_index("ID_CLI")["score"]
    assert tasks == [1, 1, 8] and many.to_dict() == pytest.approx(few.to_dict())
    train.unpersist()


def test_split_is_exact_stratified_and_repeatable(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1003)], "ID_CLI long, label int")
    first = features.stratified_split(df)
    counts = {(r.label, r.part): r["count"] for r in first.groupBy("label", "part").count().collect()}
    assert sum(n for (_, part), n in counts.items() if part == "test") == 903
    assert abs(counts[(1, "test")] - 251 * 0.9) < 1 and abs(counts[(0, "test")] - 752 * 0.9) < 1
    again = features.stratified_split(df.repartition(3))
    assert first.exceptAll(again).count() == 0 and first.count() == 1003
    folds = features.stratified_folds(df).groupBy("label", "fold").count().toPandas()
    assert folds.groupby("label")["count"].agg(lambda s: s.max() - s.min()).max() <= 1


def test_vif_and_correlations_equal_numpy(spark):
    rng = np.random.default_rng(0)
    data = pd.DataFrame(rng.normal(2, 1, (300, 4)), columns=list("abcd"))
    data["d"] += data["a"]
    data["w"] = rng.integers(1, 4, 300)
    df = spark.createDataFrame(data)
    wide = data.loc[data.index.repeat(data["w"]), list("abcd")]
    gram = wide.to_numpy().T @ wide.to_numpy()
    expected = dict(zip("abcd", np.diag(gram) * np.diag(np.linalg.inv(gram))))
    assert {r.variable: r.vif for r in stats.vif(df, list("abcd"), "w").collect()} == pytest.approx(expected)
    corr = wide.corr()
    got = {(r.var_x, r.var_y): r["corr"] for r in stats.correlation_pairs(df, list("abcd"), "w").collect()}
    assert got == pytest.approx({(x, y): corr.loc[x, y] for x, y in got}) and len(got) == 6
    with pytest.raises(Exception, match="depends on the others"):
        stats.vif(df.withColumn("e", F.col("a") * 2), ["a", "e"]).collect()


def test_neighbours_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "_BLOCK_ROWS", 40)
    rng = np.random.default_rng(5)
    points = rng.integers(0, 4, (130, 3)).astype(float)
    labels = rng.integers(0, 2, 130)
    df = spark.createDataFrame([(i, p.tolist(), int(l)) for i, (p, l) in enumerate(zip(points, labels))],
                               "train_id long, x array<double>, label int")
    near = neighbours.nearest(df.select(F.col("train_id").alias("query_id"), "x"), df, 5, leave_one_out=True)
    far = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(far, np.inf)
    expected = {(q, p + 1): t for q in range(130) for p, t in enumerate(np.argsort(far[q], kind="stable")[:5])}
    assert {(r.query_id, r.place): r.train_id for r in near.collect()} == expected
    votes = {r.query_id: r.prediction for r in neighbours.votes(near, [5]).collect()}
    assert votes == {q: int(sum(labels[expected[q, p]] for p in range(1, 6)) >= 3) for q in range(130)}


def test_curve_and_areas_equal_the_built_in_evaluator(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(rng.random() < s), float(s)) for g in "ab" for s in rng.integers(0, 50, 400) / 50]
    df = spark.createDataFrame(rows, "g string, label double, score double")
    built_in = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    areas = {r.g: r.auc for r in evaluate.roc_auc_by(df, ["g"], "label", "score").collect()}
    for g in "ab":
        part = df.where(F.col("g") == g)
        assert areas[g] == pytest.approx(built_in.evaluate(part))
        assert evaluate.roc_auc(evaluate.roc_curve(part, "label", "score")).first().auc == pytest.approx(areas[g])


def test_binary_metrics(spark):
    df = spark.createDataFrame([(1, 1)] * 4 + [(1, 0)] * 2 + [(0, 1)] + [(0, 0)] * 3, "label int, prediction int")
    m = evaluate.binary_metrics(evaluate.confusion(df)).first()
    assert (m.tp, m.fn, m.fp, m.tn, m.accuracy) == (4, 2, 1, 3, 0.7)
    assert m.f2 == pytest.approx(5 * 0.8 * (4 / 6) / (4 * 0.8 + 4 / 6))


def test_histogram_density_and_boxes(spark):
    values = [0.0, 1.0, 2.0, 2.0, 10.0]
    df = spark.createDataFrame([(1, v) for v in values], "g int, v double")
    bins = [r.n for r in stats.histogram(df, "v", 5).orderBy("bin").collect()]
    assert bins == np.histogram(values, 5)[0].tolist()
    grid = stats.density(df, "v", points=5, bandwidth=1.0).orderBy("point").collect()
    assert grid[0].density == pytest.approx(np.mean(np.exp(-0.5 * (0 - np.array(values)) ** 2)) / np.sqrt(2 * np.pi))
    box = stats.box_stats(df, "g", "v").first()
    assert (box.n, box.q1, box.median, box.q3, box.whisker_low, box.whisker_high) == (5, 1.0, 2.0, 2.0, 0.0, 2.0)


@pytest.fixture(scope="module")
def parts(spark, sf_dir):
    return pipelines.model_rows(spark, sf_dir)


def test_cross_validation_and_holdout(parts):
    _, train, test = parts
    fits = {"Logistic Regression": models.logistic(balanced=True), "Kernel SVM": models.kernel_svm(components=20),
            "KNN": models.knn(3), "Gaussian NB": models.naive_bayes(), "Random Forest": models.random_forest(5, 5)}
    scores = models.cross_validate(features.stratified_folds(test, folds=3), fits, folds=3)
    rows = scores.collect()
    assert len(rows) == 15 and all(0 <= r.auc <= 1 and 0 <= r.accuracy <= 1 for r in rows)
    assert models.cv_summary(scores).count() == 5
    held = models.holdout(train, test, {"SVC": models.linear_svm(), "Tree": models.decision_tree(5)}).collect()
    assert {r.model for r in held} == {"SVC", "Tree"} and all(0 <= r.f2 <= 1 for r in held)


def test_propensity_is_repeatable_and_ranked(parts, spark, sf_dir):
    names, train, test = parts
    fitted = models.Fitted.fit(train, names)
    scored = models.propensity(fitted, test)
    assert scored.exceptAll(models.propensity(models.Fitted.fit(train, names), test)).count() == 0
    ranked = models.propensity_deciles(scored).toPandas()
    assert len(ranked) == test.count() and set(ranked["Ranking"]) == set(range(1, 11))
    assert ranked["Ranking"].value_counts().agg(lambda s: s.max() - s.min()) <= 1
    best, rest = ranked[ranked.Ranking == 1], ranked[ranked.Ranking > 1]
    assert best.propensity_to_churn.min() >= rest.propensity_to_churn.max()
    counts = evaluate.confusion(scored, "CHURN", "predictions").collect()
    assert sum(r.n for r in counts) == len(ranked)
    assert sorted(r.feature for r in models.coefficients(fitted).collect()) == sorted(names)


def test_model_comes_back_from_its_files(parts, spark, tmp_path):
    names, train, test = parts
    fitted = models.Fitted.fit(train, names, 0.5)
    fitted.save(str(tmp_path / "churn"))
    again = models.Fitted.load(spark, str(tmp_path / "churn"))
    assert (again.names, again.scaler) == (fitted.names, fitted.scaler)
    assert models.coefficients(again).collect() == models.coefficients(fitted).collect()
    before, after = (models.propensity(f, test) for f in (fitted, again))
    assert before.exceptAll(after).count() == after.exceptAll(before).count() == 0


def test_four_queries_fit_one_model(spark, sf_dir, monkeypatch):
    fits = []
    fit = models.fit_logistic
    monkeypatch.setattr(models, "fit_logistic", lambda *a: fits.append(a) or fit(*a))
    monkeypatch.setattr(pipelines, "_STAGES", {})
    found = {key: queries.queries()[key](spark, sf_dir).collect()
             for key in ("propensity", "propensity_deciles", "confusion", "coefficients")}
    assert len(fits) == 1 and all(found.values())
    monkeypatch.setattr(pipelines, "_STAGES", {})
    assert queries.queries()["coefficients"](spark, sf_dir).collect() == found["coefficients"] and len(fits) == 2


def test_forest_prefixes(parts):
    _, train, test = parts
    sweep = models.forest_sweep(train, test, trees=4, max_depth=4).collect()
    assert sorted(r.trees for r in sweep) == [1, 2, 3, 4] and all(0 <= r.accuracy <= 1 for r in sweep)


def test_grid_is_sorted(parts):
    _, train, test = parts
    grid = models.grid_search(features.stratified_folds(test, folds=2), [0.01, 1.0], folds=2).collect()
    assert len(grid) == 2 and grid[0].balanced_accuracy >= grid[1].balanced_accuracy
