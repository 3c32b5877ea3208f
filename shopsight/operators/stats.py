"""Correlation, collinearity and the tables behind the figures."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations, combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopsight.functions.columns import one_value
from shopsight.functions.ordered import grouped_quantiles, salted_join


def _weighted_corr(x: Column, y: Column, w: Column) -> Column:
    """Pearson correlation of pairwise complete rows, each counted ``w`` times."""
    both = x.isNotNull() & y.isNotNull()
    x, y = x.cast("double"), y.cast("double")

    def total(value: Column) -> Column:
        return F.sum(F.when(both, w * value))

    n, sx, sy = total(F.lit(1.0)), total(x), total(y)
    spread = (n * total(x * x) - sx * sx) * (n * total(y * y) - sy * sy)
    return F.when(spread > 0, (n * total(x * y) - sx * sy) / F.sqrt(spread))


def correlation_pairs(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """Pearson correlation of every unordered pair of columns, from one aggregate."""
    w = F.col(weight) if weight else F.lit(1)
    pairs = list(combinations(columns, 2))
    row = df.agg(*[_weighted_corr(F.col(a), F.col(b), w).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[
        F.struct(F.lit(a).alias("var_x"), F.lit(b).alias("var_y"), F.col(f"p{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(cells).alias("p")).select("p.*")


def correlation_with(df: DataFrame, columns: Sequence[str], label: str, weight: str | None = None) -> DataFrame:
    """Correlation of each column with the label, split by sign, strongest positive first."""
    w = F.col(weight) if weight else F.lit(1)
    row = df.agg(*[_weighted_corr(F.col(c), F.col(label), w).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("corr")) for c in columns])
    return row.select(F.explode(cells).alias("p")).select("p.*").where("corr is not null and corr <> 1").withColumn(
        "sign", F.when(F.col("corr") > 0, "positive").otherwise("negative")
    ).orderBy(F.desc("corr"), "variable")


def vif(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """Variance inflation factors without an intercept: diag(G) * diag(inverse of G), G = X'X.

    The table gives one row of k(k+1)/2 sums; only that row reaches the small inversion.
    """
    names = list(columns)
    w = F.col(weight) if weight else F.lit(1)
    cells = list(combinations_with_replacement(range(len(names)), 2))
    value = [F.col(c).cast("double") for c in names]
    gram = df.dropna(subset=names).agg(
        F.array(*[F.sum(w * value[i] * value[j]) for i, j in cells]).alias("g"))

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sums in batch["g"]:
                g = np.zeros((len(names), len(names)))
                for (i, j), total in zip(cells, sums):
                    g[i, j] = g[j, i] = total
                if np.linalg.matrix_rank(g) < len(names):
                    raise ValueError("a column is constant zero or depends on the others")
                yield pd.DataFrame({"variable": names, "vif": np.diag(g) * np.diag(np.linalg.inv(g))})

    return gram.mapInPandas(invert, "variable string, vif double")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between minimum and maximum, the last one closed; empty bins are kept.

    A column with one value gets a range of half a unit to either side.
    """
    value = F.col(column).cast("double")
    half = F.when(F.min(value) == F.max(value), 0.5).otherwise(0.0)
    span = one_value(df, F.struct((F.min(value) - half).alias("lo"), (F.max(value) + half).alias("hi")))
    binned = df.where(F.col(column).isNotNull()).select(value.alias("v"), span.alias("s")).groupBy(
        F.least(F.floor((F.col("v") - F.col("s.lo")) * bins / (F.col("s.hi") - F.col("s.lo"))),
                F.lit(bins - 1)).alias("bin")
    ).agg(F.count("*").alias("n"))
    width = (F.col("s.hi") - F.col("s.lo")) / bins
    return df.sparkSession.range(bins).withColumnRenamed("id", "bin").withColumn("s", span).join(
        binned, "bin", "left"
    ).select("bin", (F.col("s.lo") + F.col("bin") * width).alias("bin_from"),
             (F.col("s.lo") + (F.col("bin") + 1) * width).alias("bin_to"),
             F.coalesce("n", F.lit(0)).alias("n"))


def density(df: DataFrame, column: str, points: int = 20, bandwidth: float | None = None) -> DataFrame:
    """Gaussian kernel density on an even grid from minimum to maximum; Scott bandwidth by default.

    Equal values are counted first. Each distinct value then adds its kernel to every grid point
    inside its own task, and the partial sums per grid point are combined before the shuffle.
    """
    value = F.col(column).cast("double")
    facts = one_value(df, F.struct(
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"),
        F.stddev_samp(value).alias("std")))
    width = F.lit(float(bandwidth)) if bandwidth else F.when(
        F.col("f.std") > 0, F.col("f.std") * F.pow(F.col("f.n"), F.lit(-0.2))
    ).otherwise(F.raise_error(F.lit("values without spread need a bandwidth")).cast("double"))
    counts = df.where(F.col(column).isNotNull()).groupBy(value.alias("v")).agg(F.count("*").alias("c"))
    spread = counts.withColumn("f", facts).withColumn("bw", width).withColumn(
        "point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    ).withColumn("x", F.col("f.lo") + F.col("point") * (F.col("f.hi") - F.col("f.lo")) / (points - 1))
    z = (F.col("x") - F.col("v")) / F.col("bw")
    kernel = F.col("c") * F.exp(z * z * -0.5) / (F.col("bw") * F.sqrt(F.lit(2.0) * F.pi()) * F.col("f.n"))
    return spread.groupBy("point", "x").agg(F.sum(kernel).alias("density"))


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles per group, and whiskers at the farthest values within 1.5 quartile ranges."""
    rows = df.select(F.col(group), F.col(value).cast("double").alias("v")).dropna()
    edges = grouped_quantiles(rows, group, "v", [0.25, 0.5, 0.75]).groupBy(group).agg(*[
        F.max(F.when(F.col("prob") == p, F.col("edge"))).alias(name)
        for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    reach = (F.col("q3") - F.col("q1")) * 1.5
    # one row per group and value, so that a group with many equal rows is joined once per value
    values = rows.groupBy(group, "v").agg(F.count("*").alias("c"))
    return salted_join(values, edges, group, "v").groupBy(group).agg(
        F.sum("c").alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(F.col("v") >= F.col("q1") - reach, F.col("v"))).alias("whisker_low"),
        F.max(F.when(F.col("v") <= F.col("q3") + reach, F.col("v"))).alias("whisker_high"))


def _label_share(df: DataFrame, weight: str | None) -> Column:
    return F.sum(weight) if weight else F.count("*")


def churn_rate(df: DataFrame, weight: str | None = "N_LINES") -> DataFrame:
    """Size and percent per churn label; counted per line by default, per customer without a weight."""
    sizes = df.groupBy(F.when(F.col("CHURN") == 0, "No").otherwise("Yes").alias("churn_label")).agg(
        _label_share(df, weight).alias("n"))
    return sizes.withColumn("churn_rate", F.col("n") / one_value(sizes, F.sum("n")) * 100)


def churn_by(df: DataFrame, column: str, weight: str | None = "N_LINES") -> DataFrame:
    """Counts per value and churn label side by side, with row percents."""
    amount = F.col(weight) if weight else F.lit(1)
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.sum(F.when(F.col("CHURN") == 0, amount).otherwise(0)).alias("No"),
        F.sum(F.when(F.col("CHURN") == 1, amount).otherwise(0)).alias("Yes"),
    ).withColumns({
        "No_percent": F.col("No") * 100.0 / (F.col("No") + F.col("Yes")),
        "Yes_percent": F.col("Yes") * 100.0 / (F.col("No") + F.col("Yes"))})
