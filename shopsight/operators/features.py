"""Feature table, dummies, scaling, splits and ranks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopsight.functions.columns import one_value
from shopsight.functions.ordered import row_numbers

# The columns profiled against churn, and those left after the collinearity check.
PROFILE_COLUMNS = ["LAST_TYP_CLI_FID", "LAST_STATUS_FID", "FIRST_ID_NEG", "NUM_FIDs", "W_PHONE", "TYP_CLI_ACCOUNT"]
NUMERIC_FEATURES = ["FIRST_ID_NEG", "W_PHONE", "TYP_CLI_ACCOUNT"]
CATEGORY_FEATURES = ["LAST_COD_FID", "EMAIL_PROVIDER", "TYP_JOB"]


def feature_table(loyalty: DataFrame, accounts: DataFrame, labels: DataFrame,
                  addresses: DataFrame | None = None, privacy: DataFrame | None = None) -> DataFrame:
    """One row per customer: cards, account and churn label, with address and consents on request.

    All inputs have one row per customer, and the label comes with its line count, so nothing fans
    out to the lines.
    """
    table = loyalty.join(accounts, "ID_CLI")
    if addresses is not None:
        table = table.join(addresses, "ID_ADDRESS")
    if privacy is not None:
        table = table.join(privacy, "ID_CLI")
    return table.drop("ID_ADDRESS").join(labels.select("ID_CLI", "CHURN", "N_LINES"), "ID_CLI")


MOST_COLUMNS = 1000  # dense flags that a table may get


def _levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in columns])).alias("p")
    return df.select(pairs).select("p.*").where("level is not null")


def level_dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The levels of each column with their place in its order, from 0: (variable, level, place)."""
    placed = row_numbers(_levels(df, columns).distinct(), [F.col("variable"), F.col("level")])
    first = placed.groupBy("variable").agg(F.min("position").alias("first"))  # one row per column
    return placed.join(F.broadcast(first), "variable").select(
        "variable", "level", (F.col("position") - F.col("first")).alias("place"))


def long_dummies(df: DataFrame, key: str, columns: Sequence[str], dictionary: DataFrame | None = None) -> DataFrame:
    """The flags that are set, one row each: (key, variable, level, place); the first level sets none.

    The levels stay a table that is joined to the rows, so their number has no bound. Levels that
    the dictionary lacks set no flag.
    """
    dictionary = dictionary if dictionary is not None else level_dictionary(df, columns)
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in columns])).alias("p")
    return df.select(key, cells).select(key, "p.*").join(dictionary.where("place > 0"), ["variable", "level"]).select(
        key, "variable", "level", "place")


def category_levels(df: DataFrame, columns: Sequence[str], most: int = MOST_COLUMNS) -> dict[str, list]:
    """The sorted levels of each column, in one job; null is no level. More than ``most`` are refused."""
    rows = _levels(df, columns).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} levels for a dense table; long_dummies keeps them as rows")
    return {c: sorted(r.level for r in rows if r.variable == c) for c in columns}


def dummies(df: DataFrame, columns: Sequence[str], levels: dict[str, list] | None = None) -> DataFrame:
    """0/1 columns per level, the first level of each column left out.

    The levels are the schema of the result, up to ``MOST_COLUMNS``; :func:`long_dummies` has no bound.
    """
    levels = levels or category_levels(df, columns)
    flags = [_flag(c, level).alias(f"{c}_{level}") for c in columns for level in levels[c][1:]]
    return df.select(*[c for c in df.columns if c not in columns], *flags)


def _flag(column: str, level: str) -> Column:
    return F.coalesce((F.col(column).cast("string") == level).cast("int"), F.lit(0))


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation per column, from one aggregate; constants become 0."""
    facts = one_value(df.agg(*[
        F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns
    ]), F.struct(*columns))
    scaled = {c: (F.col(c) - F.col(f"_s.{c}.mean"))
              / F.when(F.col(f"_s.{c}.std") > 0, F.col(f"_s.{c}.std")).otherwise(1.0) for c in columns}
    return df.withColumn("_s", facts).withColumns(scaled).drop("_s")


@dataclass(frozen=True)
class Design:
    """Model input: ``rows`` with ID_CLI, label and a vector ``x``; ``names`` of its entries."""

    rows: DataFrame
    names: list[str]


def design(table: DataFrame, numeric: Sequence[str] = NUMERIC_FEATURES,
           categories: Sequence[str] = CATEGORY_FEATURES) -> Design:
    """Numbers as they are, categories one-hot without their first level; ids stay outside the features.

    The vectors are sparse, so a row stays small however many levels there are. A missing category
    sets no flag, as the first level does.
    """
    typed = table.select(
        "ID_CLI", F.col("CHURN").cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in numeric],
        *[F.col(c).cast("string").alias(c) for c in categories])
    places, flags = ([f"_{kind}_{c}" for c in categories] for kind in ("place", "flags"))
    indexer = StringIndexer(inputCols=list(categories), outputCols=places, stringOrderType="alphabetDesc",
                            handleInvalid="keep").fit(typed)
    # places run from the last level to the first; the encoder drops the last place
    placed = indexer.transform(typed).withColumns({
        p: F.least(p, F.lit(max(0.0, len(levels) - 1.0))) for p, levels in zip(places, indexer.labelsArray)})
    encoded = OneHotEncoder(inputCols=places, outputCols=flags).fit(placed).transform(placed)
    rows = VectorAssembler(inputCols=[*numeric, *flags], outputCol="x").transform(encoded)
    names = [f"{c}_{level}" for c, levels in zip(categories, indexer.labelsArray) for level in levels[:-1]]
    return Design(rows.select("ID_CLI", "label", "x"), [*numeric, *names])


@dataclass(frozen=True)
class Scaler:
    """Row count and population deviations of the training rows.

    Rows are divided by the deviations but not centred, so sparse vectors stay sparse. No classifier
    sees the difference: each has a free intercept, splits by order, or measures distances.
    """

    n: int
    std: list[float]

    @staticmethod
    def fit(train: DataFrame) -> Scaler:
        """One aggregate over the training rows; its single row is as wide as the features."""
        summary = train.select(Summarizer.metrics("count", "variance").summary(
            F.col("x")).alias("s")).select("s.*").first()
        n = int(summary["count"])
        spread = np.sqrt(summary["variance"].toArray() * (n - 1) / n)
        return Scaler(n, np.where(spread > 0, spread, 1.0).tolist())

    def apply(self, df: DataFrame) -> DataFrame:
        factors = Vectors.dense((1.0 / np.array(self.std)).tolist())
        return ElementwiseProduct(scalingVec=factors, inputCol="x", outputCol="features").transform(df)


def _shuffled(label: str, key: str, seed: int) -> list[Column]:
    return [F.col(label), F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), F.col(key)]


def _place_in_class(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """A repeatable random place 1..n within each label class, as ``place``.

    Two classes mean two huge windows, so the place is the one in the whole table less the sizes of
    the classes before.
    """
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), F.col("n"))))
    return row_numbers(df, _shuffled(label, key, seed)).withColumn(
        "_sizes", one_value(sizes, entries)
    ).withColumn("place", F.col("position") - F.aggregate(
        F.filter("_sizes", lambda s: s["label"] < F.col(label)), F.lit(0).cast("long"), lambda a, s: a + s["n"]))


def stratified_split(df: DataFrame, label: str = "label", key: str = "ID_CLI", test_size: float = 0.9,
                     seed: int = 0) -> DataFrame:
    """Exact, repeatable split: ``part`` is test for ceil(n * test_size) rows, shared out by class.

    Every class gets the whole part of its share, and the rows left over go to the classes with the
    largest remainders.
    """
    placed = _place_in_class(df, label, key, seed)
    total = F.aggregate("_sizes", F.lit(0).cast("long"), lambda a, s: a + s["n"])
    wanted = F.ceil(F.round(total * test_size, 6))
    shares = F.transform("_sizes", lambda s: F.struct(
        (F.floor(s["n"] * wanted / total) - s["n"] * wanted / total).alias("short"),
        s["label"].alias("label"), F.floor(s["n"] * wanted / total).alias("whole")))
    left = wanted - F.aggregate("_shares", F.lit(0).cast("long"), lambda a, s: a + s["whole"])
    mine = F.filter("_shares", lambda s: s["label"] == F.col(label))[0]
    rank = F.size(F.filter("_shares", lambda s: s < F.col("_mine")))
    return placed.withColumn("_shares", shares).withColumn("_mine", mine).withColumn(
        "part", F.when(
            F.col("place") <= F.col("_mine.whole") + (rank < left).cast("int"), "test").otherwise("train")
    ).drop("_sizes", "_shares", "_mine", "position", "place")


def stratified_folds(df: DataFrame, label: str = "label", key: str = "ID_CLI", folds: int = 10,
                     seed: int = 0) -> DataFrame:
    """Fold numbers dealt out in turn within each class."""
    return _place_in_class(df, label, key, seed).withColumn(
        "fold", F.pmod(F.col("place"), F.lit(folds)).cast("int")).drop("_sizes", "position", "place")


def hash_folds(df: DataFrame, key: str = "ID_CLI", folds: int = 10, seed: int = 0) -> DataFrame:
    """Plain folds by a hash of the key; needs no shuffle."""
    return df.withColumn("fold", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int"))


def decile_ranks(df: DataFrame, value: str, key: str, deciles: int = 10, name: str = "Ranking") -> DataFrame:
    """Equal-frequency ranks of the row order by value, ties by key; the highest values get rank 1."""
    ranked = row_numbers(df, [F.col(value), F.col(key)], "_r").withColumn("_n", one_value(df, F.count("*")))
    cut = F.ceil((F.col("_r") - 1) * deciles / F.greatest(F.col("_n") - 1, F.lit(1)))
    return ranked.withColumn(name, (deciles + 1 - F.greatest(F.lit(1), cut)).cast("int")).drop("_r", "_n")
