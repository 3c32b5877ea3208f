"""Purchase cycle: days to the next purchase and the churn label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shopsight.functions.columns import one_value


def next_purchase(tx: DataFrame) -> DataFrame:
    """First, last and second-last purchase day, number of days and the last gap (0 for one-day clients).

    One shuffle. What is gathered per client is its set of distinct calendar days, so the array is
    as long as the calendar of the data at most, however many lines the client has.
    """
    days = tx.where("ID_CLI is not null").groupBy("ID_CLI").agg(
        F.sort_array(F.collect_set("DATA"), asc=False).alias("days")).where(F.size("days") > 0)
    last, before = F.get("days", F.lit(0)), F.get("days", F.lit(1))
    return days.select(
        "ID_CLI", F.element_at("days", -1).alias("PRIMO_ACQUISTO"), last.alias("ULTIMO_ACQUISTO"),
        F.size("days").alias("NUMERO_ACQUISTI"), before.alias("PENULTIMO_ACQUISTO"),
        F.coalesce(F.datediff(last, before), F.lit(0)).alias("NEXT_PURCHASE_DAY"))


def gap_counts(gaps: DataFrame) -> DataFrame:
    """Clients per gap length. One row per number of days: bounded by the calendar of the data."""
    return gaps.groupBy("NEXT_PURCHASE_DAY").agg(F.count("*").alias("n"))


def gap_percentiles(gaps: DataFrame, percents: Sequence[int] = (80, 85, 90)) -> DataFrame:
    """Gap lengths below which the given percent of clients bought again; exact, on the gap counts."""
    edges = F.percentile("NEXT_PURCHASE_DAY", F.array(*[F.lit(p / 100) for p in percents]), F.col("n"))
    return gap_counts(gaps).agg(edges.alias("edges")).select(F.explode(F.arrays_zip(
        F.array(*[F.lit(p) for p in percents]).alias("percent"), F.col("edges").alias("days"))).alias("p")
    ).select("p.percent", "p.days")


def gap_curve(gaps: DataFrame) -> DataFrame:
    """Cumulative share of clients by gap length."""
    counts = gap_counts(gaps)
    running = W.orderBy("NEXT_PURCHASE_DAY").rowsBetween(W.unboundedPreceding, 0)
    return counts.withColumn("n_upto", F.sum("n").over(running)).withColumn(
        "share", F.col("n_upto") / one_value(counts, F.sum("n")))


def churn_labels(tx: DataFrame, cutoff: Column, with_receipts: bool = False) -> DataFrame:
    """Last day, gross total and churn flag (last day before the cutoff) per client, in one shuffle.

    ``N_LINES`` carries the number of lines, so line-weighted figures need no join back to the lines.
    """
    extra = []
    if with_receipts:
        extra = [F.countDistinct(F.when(F.col("DIREZIONE") != -1, F.col("ID_SCONTRINO"))).alias("NUMBER_OF_PURCHASE")]
    return tx.where("ID_CLI is not null").groupBy("ID_CLI").agg(
        F.max("DATA").alias("LAST_PURCHASE_DATE"), F.sum("IMPORTO_LORDO").alias("TOTAL_PURCHASE"),
        F.count("*").alias("N_LINES"), *extra,
    ).withColumn("CHURN", F.when(F.col("LAST_PURCHASE_DATE") < cutoff, 1).otherwise(0))


def label_lines(tx: DataFrame, labels: DataFrame) -> DataFrame:
    """Every line with its client's label.

    Every labelled client has lines, so an inner join loses nothing; with the lines on the left,
    adaptive execution can split a client that holds a large share of them.
    """
    return tx.join(labels.drop("N_LINES"), "ID_CLI")
