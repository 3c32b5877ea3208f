"""Distributions, summaries and top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopsight.functions.columns import mean_of, one_value
from shopsight.functions.ordered import column_quantiles, running_totals


def null_profile(df: DataFrame) -> DataFrame:
    """Null count and any-null flag per column, from one aggregate."""
    counts = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    return _unpivot(counts, df.columns, "column_name", "n_nulls").withColumn(
        "any_null", (F.col("n_nulls") > 0).cast("int"))


def table_profile(df: DataFrame) -> DataFrame:
    """Name, type, row count and filled count per column."""
    counts = df.agg(F.count("*").alias("n_rows"), *[F.count(c).alias(c) for c in df.columns])
    kinds = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    return _unpivot(counts, df.columns, "column_name", "n_filled", "n_rows").withColumn(
        "data_type", kinds[F.col("column_name")])


def _unpivot(row: DataFrame, columns: Sequence[str], name: str, value: str, *keep: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns])
    return row.select(*keep, F.explode(pairs).alias("p")).select(*keep, f"p.{name}", f"p.{value}")


def overview(tx: DataFrame) -> DataFrame:
    """First and last day, receipts and clients of the whole table."""
    return tx.agg(
        F.min("DATA").alias("MIN_DATE"), F.max("DATA").alias("MAX_DATE"),
        F.countDistinct("ID_SCONTRINO").alias("TOT_TICs"), F.countDistinct("ID_CLI").alias("TOT_CLIs"),
    )


def zero_net_audit(tx: DataFrame) -> DataFrame:
    return tx.agg(F.count("*").alias("n_rows"),
                  F.count_if(F.col("IMPORTO_NETTO") == 0).alias("n_zero_net"))


def receipts_and_clients(tx: DataFrame, *keys: str, approximate: bool = False) -> DataFrame:
    """Distinct receipts and clients per key; null keys make no group."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    return tx.dropna(subset=list(keys)).groupBy(*keys).agg(
        count("ID_SCONTRINO").alias("TOT_TICs"), count("ID_CLI").alias("TOT_CLIs"))


def direction_distribution(tx: DataFrame) -> DataFrame:
    """Receipts as a share of both directions' sum, clients as a share of all clients."""
    by_direction = receipts_and_clients(tx, "DIREZIONE")
    tickets = one_value(by_direction, F.sum("TOT_TICs"))
    clients = one_value(tx, F.countDistinct("ID_CLI"))
    return by_direction.withColumns({
        "PERCENT_TICs": F.col("TOT_TICs") / tickets, "PERCENT_CLIs": F.col("TOT_CLIs") / clients})


def distribution_within_direction(tx: DataFrame, key: str) -> DataFrame:
    """Receipts and clients per key and direction, as shares of that direction's own totals."""
    totals = receipts_and_clients(tx, "DIREZIONE").withColumnsRenamed(
        {"TOT_TICs": "ALL_TICs", "TOT_CLIs": "ALL_CLIs"})
    return receipts_and_clients(tx, key, "DIREZIONE").join(totals, "DIREZIONE").select(
        key, "DIREZIONE", "TOT_TICs", "TOT_CLIs",
        (F.col("TOT_TICs") / F.col("ALL_TICs")).alias("PERCENT_TICs"),
        (F.col("TOT_CLIs") / F.col("ALL_CLIs")).alias("PERCENT_CLIs"))


def cards_per_client(loyalty: DataFrame) -> DataFrame:
    return loyalty.where("ID_CLI is not null").groupBy("ID_CLI").agg(
        F.countDistinct("ID_FID").alias("NUM_FIDs"), F.countDistinct("DT_ACTIVE").alias("NUM_DATEs"))


def card_distribution(loyalty: DataFrame) -> DataFrame:
    """Clients by number of cards and of activation dates, with their share of all clients."""
    return with_share(
        cards_per_client(loyalty).groupBy("NUM_FIDs", "NUM_DATEs").agg(F.count("*").alias("TOT_CLIs")),
        "TOT_CLIs", "PERCENT_CLIs")


def client_distribution(df: DataFrame, column: str) -> DataFrame:
    """Distinct clients per value of a column, with the share of the sum, largest first."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.countDistinct("ID_CLI").alias("TOT_CLIs"))
    return with_share(counts, "TOT_CLIs", "PERCENT_CLIs").orderBy(F.desc("PERCENT_CLIs"), column)


def with_share(df: DataFrame, amount: str, share: str) -> DataFrame:
    """``amount`` as a share of its column total."""
    return df.withColumn(share, F.col(amount) / one_value(df, F.sum(amount)))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts and percent per value, nulls left out, most frequent first."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn(
        "percent", F.col("n") / one_value(counts, F.sum("n")) * 100).orderBy(F.desc("n"), column)


def cumulative_counts(df: DataFrame, column: str, client: str = "ID_CLI") -> DataFrame:
    """Running share of the value counts, most frequent first, over the number of distinct clients."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    running = running_totals(counts, [F.col("n").desc(), F.col(column)], {"n_upto": F.col("n")})
    return running.withColumn("cumulative_share", F.col("n_upto") / one_value(df, F.countDistinct(client)))


def receipts_per_client(tx: DataFrame) -> DataFrame:
    """Distinct purchase receipts per client, clients without any left out."""
    return tx.where("DIREZIONE <> -1 and ID_CLI is not null").groupBy("ID_CLI").agg(
        F.countDistinct("ID_SCONTRINO").alias("TOT_SCONTRINI")).where("TOT_SCONTRINI > 0")


def clients_at_least(receipts: DataFrame, upto: int = 6) -> DataFrame:
    """Clients with at least 1..upto receipts, from one conditional aggregate."""
    counts = receipts.agg(*[
        F.count_if(F.col("TOT_SCONTRINI") >= k).alias(f"k{k}") for k in range(1, upto + 1)])
    pairs = F.array(*[F.struct(F.lit(k).alias("at_least"), F.col(f"k{k}").alias("n_clients"))
                      for k in range(1, upto + 1)])
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


def top_clients(receipts: DataFrame, n: int = 3) -> DataFrame:
    return receipts.orderBy(F.desc("TOT_SCONTRINI"), "ID_CLI").limit(n)


def number_summary(df: DataFrame, column: str) -> DataFrame:
    """count, mean, std, min, quartiles, max; the quartiles are exact."""
    edges = column_quantiles(df, [column], [0.25, 0.5, 0.75]).agg(*[
        F.max(F.when(F.col("prob") == p, F.col("edge"))).alias(name)
        for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    parts = one_value(edges, F.struct("q25", "q50", "q75"))
    value = F.col(column).cast("double")
    return df.agg(
        F.count(column).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    ).withColumn("q", parts).select("n", "mean", "std", "min", "q.q25", "q.q50", "q.q75", "max")


def category_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, unique, top and freq per column; the least value wins a tie for the top."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("x")).select("x.*").where("value is not null")
    per_value = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    best = F.struct(-F.col("n"), F.col("value"))
    return per_value.groupBy("column_name").agg(
        F.sum("n").alias("n"), F.count("*").alias("n_unique"),
        F.min_by("value", best).alias("top"), F.max("n").alias("freq"))


def rows_per_value(left: DataFrame, right: DataFrame, key: str, column: str, count: Column) -> DataFrame:
    """Rows of ``left`` per value of ``column`` in ``right``, both matched on ``key``.

    ``left`` is counted per key before the join: the join moves one row per key, not one per line.
    """
    per_key = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(count).alias("n"))
    return per_key.join(right.select(key, column), key).where(F.col(column).isNotNull()).groupBy(column).agg(
        F.sum("n").alias("n"))


def article_profile(lines: DataFrame) -> DataFrame:
    """Mean net and receipt share per article and department."""
    receipts = one_value(lines, F.countDistinct("ID_SCONTRINO"))
    return lines.dropna(subset=["ID_ARTICOLO", "COD_REPARTO"]).groupBy(
        "ID_ARTICOLO", F.col("COD_REPARTO").alias("REPARTO")
    ).agg(
        mean_of("IMPORTO_NETTO").alias("IMPORTO_MEDIO"), F.countDistinct("ID_SCONTRINO").alias("n"),
    ).select("ID_ARTICOLO", "REPARTO", "IMPORTO_MEDIO", (F.col("n") / receipts).alias("PERC_SCONTRINI")).dropna()


def articles_per_department(profile: DataFrame) -> DataFrame:
    return profile.groupBy("REPARTO").agg(F.count("*").alias("n_articles"))


def article_stats(lines: DataFrame) -> DataFrame:
    """Mean net, receipts and clients per article."""
    return lines.where("ID_ARTICOLO is not null").groupBy("ID_ARTICOLO").agg(
        mean_of("IMPORTO_NETTO").alias("IMPORTO_MEDIO"),
        F.countDistinct("ID_SCONTRINO").alias("NUMERO_ACQUISTI"),
        F.countDistinct("ID_CLI").alias("NUMERO_CLIENTI"))


def table_size(df: DataFrame) -> DataFrame:
    """Rows and columns."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))
