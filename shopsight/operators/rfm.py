"""Recency, frequency and monetary segmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopsight.functions.columns import one_value, whole_days
from shopsight.functions.ordered import column_quantiles
from shopsight.operators.profile import with_share

_EDGES = (0.0, 0.25, 0.5, 0.75, 1.0)

# The segment name of each recency-frequency class.
RF_LABELS = {
    "Medium-High": "Top",
    "Low-Medium": "Engaged",
    "High-High": "Leaving Top",
    "Low-High": "Top",
    "Low-Low": "One Timer",
    "Medium-Medium": "Engaged",
    "High-Medium": "Leaving",
    "Medium-Low": "One Timer",
    "High-Low": "Leaving",
}

# The lowest score of each level.
LEVELS = {"Diamond": 9, "Gold": 8, "Silver": 7, "Bronze": 6, "Copper": 5, "Tin": 4}
LOWEST_LEVEL = "Cheap"


def rfm_base(active: DataFrame, unit: str = "line") -> DataFrame:
    """Full days since the last purchase, number of lines (or receipts) and net total per client."""
    snapshot = one_value(active, F.max("DATETIME"))
    frequency = F.count("ID_SCONTRINO") if unit == "line" else F.countDistinct("ID_SCONTRINO")
    return active.where("ID_CLI is not null").groupBy("ID_CLI").agg(
        F.max("DATETIME").alias("last"), frequency.alias("Frequency"),
        F.coalesce(F.sum("IMPORTO_NETTO"), F.lit(0)).alias("MonetaryValue"),
    ).select("ID_CLI", whole_days(snapshot, "last").alias("Recency"), "Frequency", "MonetaryValue")


def rfm_scores(base: DataFrame, duplicates: str = "raise") -> DataFrame:
    """Quartile scores 1..4 per measure, right-closed with ties together; recency counts down.

    ``base`` is read several times, so a stored table serves best. Equal quartile edges are refused, as they leave a class empty; ``duplicates='drop'`` merges them.
    """
    measures = {"R": "Recency", "F": "Frequency", "M": "MonetaryValue"}
    edges = column_quantiles(base, list(measures.values()), _EDGES)
    wide = edges.agg(*[
        F.sort_array(F.collect_list(F.when(F.col("name") == m, F.col("edge")))).alias(m)
        for m in measures.values()])
    scores = {k: _score(m, duplicates, countdown=k == "R") for k, m in measures.items()}
    return base.withColumn("_edges", one_value(wide, F.struct(*measures.values()))).withColumns(
        scores).drop("_edges")


def _score(measure: str, duplicates: str, countdown: bool) -> Column:
    edges = F.col(f"_edges.{measure}")
    distinct = F.array_distinct(edges)
    inner = F.slice(distinct, 2, F.greatest(F.size(distinct) - 2, F.lit(0)))
    above = F.size(F.filter(inner, lambda e: F.col(measure).cast("double") > e))
    score = (F.size(inner) + 1 - above if countdown else above + 1).cast("int")
    if duplicates == "drop":
        return score
    clash = F.raise_error(F.lit(f"equal quartile edges in {measure}; use duplicates='drop'"))
    return F.when(F.size(distinct) < 5, clash.cast("int")).otherwise(score)


def class_of(score: str) -> Column:
    """1 is Low, 2 and 3 are Medium, 4 is High."""
    return F.when(F.col(score) == 1, "Low").when(F.col(score) <= 3, "Medium").when(F.col(score) == 4, "High")


def rfm_classes(scores: DataFrame) -> DataFrame:
    return scores.withColumns({f"{k}_Class": class_of(k) for k in "RFM"})


def rf_labels(classes: DataFrame, recency_label: str = "score") -> DataFrame:
    """Recency-frequency class and its segment name.

    The names read a high recency as long ago, while score 4 means most recent: ``'score'`` looks the
    score class up as it is, ``'elapsed'`` turns it round first.
    """
    recency = F.col("R_Class")
    if recency_label == "elapsed":
        recency = F.when(recency == "High", "Low").when(recency == "Low", "High").otherwise(recency)
    labels = F.create_map(*[F.lit(x) for pair in RF_LABELS.items() for x in pair])
    return classes.withColumn("Combine_Class", F.concat_ws("-", recency, F.col("F_Class"))).withColumn(
        "RF_Class", labels[F.col("Combine_Class")])


def rf_matrix(labelled: DataFrame) -> DataFrame:
    """Clients per recency-frequency class with their percent; at most nine rows."""
    counts = labelled.groupBy("Combine_Class", "RF_Class").agg(F.count("*").alias("n"))
    return with_share(counts, "n", "share").select(
        "Combine_Class", "RF_Class", "n", F.bround(F.col("share") * 100, 2).alias("percent"))


def rfm_segments(scores: DataFrame) -> DataFrame:
    """Concatenated segment such as 432, and the score sum."""
    return scores.withColumns({
        "RFM_Segment_Concat": F.concat(*[F.col(k).cast("string") for k in "RFM"]),
        "RFM_Score": F.col("R") + F.col("F") + F.col("M"),
    })


def rfm_levels(segments: DataFrame) -> DataFrame:
    level = F.lit(LOWEST_LEVEL)
    for name, lowest in sorted(LEVELS.items(), key=lambda item: item[1]):
        level = F.when(F.col("RFM_Score") >= lowest, name).otherwise(level)
    return segments.withColumn("RFM_Level", level)


def segment_count(segments: DataFrame) -> DataFrame:
    return segments.agg(F.countDistinct("RFM_Segment_Concat").alias("n_segments"))


def level_summary(levels: DataFrame) -> DataFrame:
    """Mean recency, frequency and spend, size and percent per level, smallest first."""
    mean = {m: F.bround(F.sum(m).cast("double") / F.count(m), 1) for m in ("Recency", "Frequency", "MonetaryValue")}
    sizes = levels.groupBy("RFM_Level").agg(
        mean["Recency"].alias("RecencyMean"), mean["Frequency"].alias("FrequencyMean"),
        mean["MonetaryValue"].alias("MonetaryMean"), F.count("*").alias("Count"))
    return with_share(sizes, "Count", "share").select(
        "RFM_Level", "RecencyMean", "FrequencyMean", "MonetaryMean", "Count",
        F.bround(F.col("share") * 100, 2).alias("Percent")).orderBy("Count", "RFM_Level")
