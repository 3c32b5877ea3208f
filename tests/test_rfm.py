from datetime import datetime
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shopsight.functions.ordered import column_quantiles, grouped_quantiles, row_numbers, running_totals
from shopsight.operators import cycle, features, rfm


def test_recency_counts_full_days(spark):
    rows = [(1, "a", Decimal("1.00"), datetime(2019, 4, 29, 20)), (2, "b", None, datetime(2019, 4, 30, 10))]
    base = {r.ID_CLI: r for r in rfm.rfm_base(spark.createDataFrame(
        rows, "ID_CLI long, ID_SCONTRINO string, IMPORTO_NETTO decimal(18,2), DATETIME timestamp_ntz")).collect()}
    assert (base[1].Recency, base[2].Recency, base[2].MonetaryValue) == (0, 0, 0)


def _scores(spark, values, **options):
    base = spark.createDataFrame([(i, v, v, float(v)) for i, v in enumerate(values)],
                                 "ID_CLI long, Recency int, Frequency int, MonetaryValue double")
    rows = rfm.rfm_scores(base, **options).orderBy("ID_CLI").collect()
    return [r.F for r in rows], [r.R for r in rows]


def test_quartiles_keep_ties_together(spark):
    up, down = _scores(spark, [1, 2, 2, 3, 5, 8, 13, 21, 21, 40])
    assert up == [1, 1, 1, 2, 2, 3, 3, 4, 4, 4]
    assert down == [5 - s for s in up]


def test_equal_edges_are_refused_or_merged(spark):
    with pytest.raises(Exception, match="equal quartile edges"):
        _scores(spark, [1, 1, 1, 1, 5])
    assert _scores(spark, [1, 1, 1, 1, 5], duplicates="drop")[0] == [1] * 5


@pytest.mark.parametrize("size", [1, 2, 7, 1999, 2000, 30000])
def test_quantiles_equal_pandas(spark, size):
    values = pd.Series(np.random.default_rng(size).lognormal(3, 1, size).round(1))
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    probs = [0.0, 0.25, 0.5, 0.8, 0.85, 1.0]
    edges = {r.prob: r.edge for r in column_quantiles(df, ["v"], probs).collect()}
    assert [edges[p] for p in probs] == pytest.approx([values.quantile(p) for p in probs])


def test_quantiles_by_a_hot_group(spark):
    rng = np.random.default_rng(1)
    data = pd.DataFrame({"g": np.where(rng.random(20000) < 0.7, 0, rng.integers(1, 9, 20000)),
                         "v": rng.integers(0, 5000, 20000).astype(float)})
    edges = grouped_quantiles(spark.createDataFrame(data), "g", "v", [0.25, 0.75]).collect()
    expected = data.groupby("g").v.quantile([0.25, 0.75]).to_dict()
    assert {(r.g, r.prob): r.edge for r in edges} == pytest.approx(expected)


def test_running_totals_over_heavy_ties(spark):
    values = [5] * 3000 + list(range(1000))
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int")
    got = running_totals(df, [F.col("v").desc(), F.col("i")], {"upto": F.col("v")}).orderBy(F.desc("v"), "i").collect()
    assert [r.upto for r in got] == list(np.cumsum(sorted(values, reverse=True)))
    places = row_numbers(df, [F.col("v"), F.col("i")]).orderBy("v", "i").collect()
    assert [r.position for r in places] == list(range(1, len(values) + 1))


@pytest.mark.parametrize("n", [2, 7, 23, 997])
def test_deciles_equal_equal_frequency_cut_of_ranks(spark, n):
    df = spark.createDataFrame([(i, i) for i in range(1, n + 1)], "v int, i int")
    got = [r.Ranking for r in features.decile_ranks(df, "v", "i").orderBy("i").collect()]
    if n >= 10:
        expected = pd.qcut(pd.Series(range(1, n + 1)), 10, labels=range(10, 0, -1)).astype(int).tolist()
        assert got == expected
    assert got[0] == 10 and got[-1] == 1


def test_labels_and_levels(spark):
    scores = spark.createDataFrame([(1, 4, 1, 1), (2, 1, 4, 4), (3, 2, 3, 4), (4, 1, 1, 1)], "ID_CLI long, R int, F int, M int")
    classes = rfm.rfm_classes(scores)
    assert {r.ID_CLI: r.RF_Class for r in rfm.rf_labels(classes).collect()} == {
        1: "Leaving", 2: "Top", 3: "Engaged", 4: "One Timer"}
    assert {r.ID_CLI: r.RF_Class for r in rfm.rf_labels(classes, "elapsed").collect()} == {
        1: "One Timer", 2: "Leaving Top", 3: "Engaged", 4: "Leaving"}
    levels = rfm.rfm_levels(rfm.rfm_segments(scores)).orderBy("ID_CLI").collect()
    assert [(r.RFM_Segment_Concat, r.RFM_Score, r.RFM_Level) for r in levels] == [
        ("411", 6, "Bronze"), ("144", 9, "Diamond"), ("234", 9, "Diamond"), ("111", 3, "Cheap")]


def test_next_purchase_and_churn(spark):
    day = datetime
    rows = [(1, day(2019, 1, 1)), (1, day(2019, 1, 1)), (1, day(2019, 1, 11)), (1, day(2019, 3, 1)), (2, day(2019, 1, 5))]
    tx = spark.createDataFrame(rows, "ID_CLI long, DATETIME timestamp_ntz").select(
        "ID_CLI", F.to_date("DATETIME").alias("DATA"), F.lit(1).alias("DIREZIONE"), F.lit("r").alias("ID_SCONTRINO"),
        F.lit(2).cast("decimal(18,2)").alias("IMPORTO_LORDO"))
    gaps = {r.ID_CLI: r for r in cycle.next_purchase(tx).collect()}
    assert (gaps[1].NUMERO_ACQUISTI, gaps[1].NEXT_PURCHASE_DAY) == (3, 49)
    assert (gaps[2].PENULTIMO_ACQUISTO, gaps[2].NEXT_PURCHASE_DAY) == (None, 0)
    labels = {r.ID_CLI: (r.CHURN, r.N_LINES, int(r.TOTAL_PURCHASE))
              for r in cycle.churn_labels(tx, F.lit("2019-03-01").cast("date")).collect()}
    assert labels == {1: (0, 4, 8), 2: (1, 1, 2)}
    assert cycle.label_lines(tx, cycle.churn_labels(tx, F.lit("2019-03-01").cast("date"))).count() == 5


def test_whole_pipeline_properties(spark, sf_dir):
    from shopsight.plans import pipelines

    levels = rfm.rfm_levels(rfm.rfm_segments(pipelines.scored_customers(spark, sf_dir)))
    row = levels.agg(F.min("RFM_Score").alias("a"), F.max("RFM_Score").alias("b"),
                     F.count("*").alias("n"), F.countDistinct("ID_CLI").alias("d")).first()
    assert row.a >= 3 and row.b <= 12 and row.n == row.d
    summary = pipelines.rfm_summary(spark, sf_dir)
    assert abs(sum(r.Percent for r in summary.collect()) - 100) < 0.1
