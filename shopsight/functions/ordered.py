"""Order statistics over whole tables that never pull the table into one task.

A window without a partition key, or ``percentile`` on a column with many distinct values, puts
everything into one task. The three helpers here split that work by range or by a rank bracket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shopsight.session import materialize

_PART = "_part"
_RANGE_ROWS = 1_000_000


def running_totals(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """Running sums (row included) along a total order.

    Rows are range-partitioned on the order, each range gets its own running sum, and the sums of
    the earlier ranges are added: one row per range, and a range holds about ``_RANGE_ROWS`` rows at most. ``order`` has to be unique per row; ties on a leading column are then split between
    ranges by the later ones, so one heavy value cannot fill a single range. The ranges are
    written out, because both branches must see the same cut points.
    """
    # as many ranges as the rows need, so that a range keeps its size when the table grows
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // _RANGE_ROWS))
    inputs = {f"_in_{name}": value for name, value in sums.items()}
    ranged = materialize(
        df.withColumns(inputs).repartitionByRange(parts, *order).withColumn(_PART, F.spark_partition_id()),
        "ranges",
    )
    earlier = W.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = ranged.groupBy(_PART).agg(*[F.sum(f"_in_{n}").alias(f"_sum_{n}") for n in sums]).select(
        _PART, *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_off_{n}") for n in sums]
    )
    inside = W.partitionBy(_PART).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        ranged.join(F.broadcast(offsets), _PART)
        .withColumns({n: F.col(f"_off_{n}") + F.sum(f"_in_{n}").over(inside) for n in sums})
        .drop(_PART, *inputs, *[f"_off_{n}" for n in sums])
    )


def row_numbers(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """``row_number`` over the whole table, 1-based."""
    return running_totals(df, order, {name: F.lit(1).cast("long")})


_SALTS = 32


def salted_join(rows: DataFrame, lookup: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Inner join of many rows to one small row per key, where one key may hold most of the rows.

    Each lookup row is repeated once per salt and each row takes a salt from ``spread_by``.
    """
    salt = F.pmod(F.xxhash64(spread_by), F.lit(_SALTS)).cast("int")
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return rows.withColumn("_salt", salt).join(repeated, [key, "_salt"]).drop("_salt")


def grouped_quantiles(df: DataFrame, key: str, value: str, probs: Sequence[float],
                      accuracy: int = 1000, few_keys: bool = False) -> DataFrame:
    """Exact, linearly interpolated quantiles of ``value`` per ``key``: rows (key, prob, edge).

    A rank sketch first brackets each wanted rank within a few thousandths of the rows. The second
    pass counts everything below a bracket as one number and keeps only the distinct values inside
    it, so the ordered part handles a sliver of the table, however large or skewed a key is.
    ``few_keys`` states that the keys are a short fixed list and the brackets can be broadcast;
    otherwise the brackets are joined over salted keys, so a hot key is spread over many tasks.
    """
    slack = 2.0 / accuracy
    wanted = [float(p) for p in probs]
    lows = F.array(*[F.lit(max(0.0, p - slack)) for p in wanted])
    highs = F.array(*[F.lit(min(1.0, p + slack)) for p in wanted])
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).where(
        "k is not null and v is not null")
    brackets = rows.groupBy("k").agg(
        F.count("*").alias("n"),
        F.percentile_approx("v", lows, accuracy).alias("lows"),
        F.percentile_approx("v", highs, accuracy).alias("highs"),
        F.min("v").alias("least"), F.max("v").alias("most"),
    ).select("k", "n", "least", "most", F.explode(F.arrays_zip(
        F.array(*[F.lit(p) for p in wanted]).alias("p"), F.col("lows").alias("low"),
        F.col("highs").alias("high"))).alias("b")
    ).withColumn("all", F.col("n") * slack < 4).select(  # a bracket has to span a few ranks
        "k", "n", "b.p", F.expr("if(all, least, b.low)").alias("low"), F.expr("if(all, most, b.high)").alias("high"))
    if few_keys:
        matched = rows.join(F.broadcast(brackets), "k")
    else:
        matched = salted_join(rows, brackets, "k", "v")
    cells = (
        matched.where("v <= high")
        .groupBy("k", "n", "p", F.expr("if(v >= low, v, null)").alias("v"))
        .agg(F.count("*").alias("c"))
    )
    order = W.partitionBy("k", "p").orderBy(F.col("v").asc_nulls_first())
    upto = F.sum("c").over(order.rowsBetween(W.unboundedPreceding, 0))
    ranked = cells.withColumn("upto", upto).withColumns({
        "rank": F.col("p") * (F.col("n") - 1), "before": F.col("upto") - F.col("c")})
    inside = "v is not null and before <= {0}(rank) and {0}(rank) < upto"
    picked = ranked.groupBy("k", "p").agg(
        F.max(F.expr(f"if({inside.format('floor')}, v, null)")).alias("lo"),
        F.max(F.expr(f"if({inside.format('ceil')}, v, null)")).alias("hi"),
        F.first(F.expr("rank - floor(rank)")).alias("part"),
    )
    missed = F.raise_error(F.lit("a quantile fell outside its rank bracket; raise the accuracy"))
    return picked.select(
        F.col("k").alias(key), F.col("p").alias("prob"),
        F.when(F.col("lo").isNull() | F.col("hi").isNull(), missed.cast("double"))
        .otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("edge"),
    )


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact quantiles of several columns in one plan: rows (name, prob, edge)."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns
    ])).alias("x")).select("x.name", "x.value")
    return grouped_quantiles(long, "name", "value", probs, few_keys=True)


_COPY_CHUNK = 1 << 20


def repeat_rows(df: DataFrame, copies: str) -> DataFrame:
    """Each row as often as its ``copies`` column says, with that column dropped.

    A row with very many copies is cut in chunks that are spread over the cluster before they are
    unrolled, so a group of copies that makes up a large share of a table is no single task's work.
    """
    keep = [c for c in df.columns if c != copies]
    small = df.where(F.col(copies) <= _COPY_CHUNK).select(
        *keep, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias("_copy")).drop("_copy")
    chunked = df.where(F.col(copies) > _COPY_CHUNK).select(
        *keep, copies, F.explode(F.sequence(
            F.lit(0).cast("long"), F.expr(f"({copies} - 1) div {_COPY_CHUNK}"))).alias("_chunk"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.least(F.lit(_COPY_CHUNK), F.col(copies) - F.col("_chunk") * _COPY_CHUNK).cast("int")
    large = chunked.repartition(parts, *keep, "_chunk").select(
        *keep, F.explode(F.sequence(F.lit(1), size)).alias("_copy")).drop("_copy")
    return small.unionByName(large)
