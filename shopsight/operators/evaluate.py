"""Classification metrics as grouped counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopsight.functions.columns import one_value
from shopsight.functions.ordered import running_totals


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction",
              by: Sequence[str] = ()) -> DataFrame:
    """Rows per (label, prediction), within the ``by`` columns if any."""
    return df.groupBy(*by, F.col(label).cast("int").alias("label"),
                      F.col(prediction).cast("int").alias("prediction")).agg(F.count("*").alias("n"))


def binary_metrics(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, error rate, balanced accuracy, precision, recall, F1 and F2 from confusion counts."""
    def cell(label: int, prediction: int) -> Column:
        hit = (F.col("label") == label) & (F.col("prediction") == prediction)
        return F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))

    cells = counts.groupBy(*by).agg(
        cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(0.0)

    n = tp + fp + fn + tn
    return cells.withColumns({
        "n": n, "accuracy": ratio(tp + tn, n), "error_rate": ratio(fp + fn, n),
        "balanced_accuracy": (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2,
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "f1": ratio(tp * 2, tp * 2 + fn + fp), "f2": ratio(tp * 5, tp * 5 + fn * 4 + fp),
    })


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, from the highest down.

    ``area`` is the trapezoid between a point and the one before; its sum is the AUC. Rows without a
    score are left out; a rate without rows of its class is null.
    """
    positive = (F.col(label) == 1).cast("long")
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(
        F.sum(positive).alias("p"), F.sum(1 - positive).alias("q"))
    totals = one_value(counts, F.struct(F.sum("p").alias("p"), F.sum("q").alias("q")))
    running = running_totals(counts, [F.col("threshold").desc()], {"tp": F.col("p"), "fp": F.col("q")})
    area = F.col("q") * (F.col("tp") * 2 - F.col("p")) / 2
    return running.withColumn("t", totals).select(
        "threshold", F.try_divide("fp", "t.q").alias("fpr"), F.try_divide("tp", "t.p").alias("tpr"),
        F.try_divide(area, F.col("t.p") * F.col("t.q")).alias("area"))


def roc_auc(curve: DataFrame) -> DataFrame:
    return curve.agg(F.sum("area").alias("auc"))


def roc_auc_by(df: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """Area under the curve per group, all groups in one ordered pass.

    The running counts go over the whole table in group order; what earlier groups counted is taken
    off again, so no group is sorted in a single task.
    """
    positive = (F.col(label) == 1).cast("long")
    counts = df.groupBy(*by, F.col(score).alias("threshold")).agg(
        F.sum(positive).alias("p"), F.sum(1 - positive).alias("q"))
    order = [*[F.col(c) for c in by], F.col("threshold").desc()]
    running = running_totals(counts, order, {"tp": F.col("p")})
    # within a group: sum of q * (tp before + p / 2), with tp counted from the group's own start
    return running.groupBy(*by).agg(
        F.sum("p").alias("P"), F.sum("q").alias("Q"), F.min(F.col("tp") - F.col("p")).alias("earlier"),
        F.sum(F.col("q") * (F.col("tp") * 2 - F.col("p")) / 2).alias("area"),
    ).select(*by, F.when(F.col("P") * F.col("Q") > 0, (
        F.col("area") - F.col("earlier") * F.col("Q")) / (F.col("P") * F.col("Q"))).alias("auc"))
