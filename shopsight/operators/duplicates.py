"""Duplicate reports and removal.

Everything is counted before it is shuffled further: a row that occurs a billion times travels as
one row with a count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shopsight.functions.ordered import repeat_rows
from shopsight.session import materialize

_COPIES = "_copies"

# The columns that identify a sold article; amounts are what may conflict.
SALE_KEY = ("ID_SCONTRINO", "ID_CLI", "ID_NEG", "ID_ARTICOLO", "COD_REPARTO", "DIREZIONE", "DATETIME")


def count_copies(df: DataFrame) -> DataFrame:
    """Distinct rows with the number of times each occurs."""
    return df.groupBy(*df.columns).agg(F.count("*").alias(_COPIES))


def identical_rows(df: DataFrame) -> DataFrame:
    """Every copy of every row that occurs more than once."""
    return repeat_rows(count_copies(df).where(F.col(_COPIES) > 1), _COPIES)


def drop_price_conflicts(tx: DataFrame, key: Sequence[str] = SALE_KEY) -> DataFrame:
    """Keep exact copies whole; of the other rows keep those that are alone on their sale key.

    Copies are counted first, so a sale key holds one row per price, and the window over it spills if there
    are very many. Rows that come in order of their receipts are not shuffled again. What is kept is written
    once, as a row with its count, before the copies are unrolled.
    """
    counted = count_copies(tx)
    lone = F.sum(F.when(F.col(_COPIES) == 1, 1).otherwise(0)).over(W.partitionBy(*key))
    kept = counted.withColumn("_lone", lone).where((F.col(_COPIES) > 1) | (F.col("_lone") == 1)).drop("_lone")
    return repeat_rows(materialize(kept, "kept"), _COPIES)


def duplicate_report(df: DataFrame, subsets: dict[str, Sequence[str] | None]) -> DataFrame:
    """Rows beyond the first per subset of columns (None: all columns): (subset, duplicates).

    The subsets are counted on the distinct rows with their copies, so the table is read and
    shuffled whole once, whatever the number of subsets; nulls count as values.
    """
    counted = count_copies(df)
    parts = []
    for name, columns in subsets.items():
        groups = counted if columns is None else counted.groupBy(*columns).agg(F.sum(_COPIES).alias(_COPIES))
        parts.append(groups.agg(F.coalesce(F.sum(F.col(_COPIES) - 1), F.lit(0)).alias("duplicates")).select(
            F.lit(name).alias("subset"), "duplicates"))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key, the least one by ``order``; combines on the map side."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(key, "_row.*")


def key_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many rows of ``left`` have their key in ``right``: rows (found, n).

    ``left`` shrinks to its keys with counts before the join, so no key is hot in it.
    """
    keys = left.groupBy(key).agg(F.count("*").alias("n"))
    known = right.select(F.col(key).alias("_key")).where("_key is not null").distinct()
    return (
        keys.join(known, F.col(key) == F.col("_key"), "left")
        .groupBy(F.col("_key").isNotNull().cast("int").alias("found")).agg(F.sum("n").alias("n"))
    )
