"""Typing, null handling and one-row-per-client consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopsight.functions.columns import decimal_comma
from shopsight.operators.duplicates import drop_price_conflicts

MISSING = "(missing)"
OTHER = "other"


def type_transactions(raw: DataFrame) -> DataFrame:
    """Text money and time to numbers and timestamps, plus the hour and the day."""
    return with_time_parts(
        raw.withColumns({
            "IMPORTO_LORDO": decimal_comma("IMPORTO_LORDO", "decimal(18,2)"),
            "SCONTO": decimal_comma("SCONTO", "decimal(18,2)"),
            "DATETIME": F.col("DATETIME").cast("timestamp_ntz"),
        })
    )


def with_time_parts(tx: DataFrame) -> DataFrame:
    return tx.withColumns({"ORA": F.hour("DATETIME"), "DATA": F.to_date("DATETIME")})


def with_net(tx: DataFrame) -> DataFrame:
    """Net amount = gross - discount."""
    return tx.withColumn("IMPORTO_NETTO", (F.col("IMPORTO_LORDO") - F.col("SCONTO")).cast("decimal(18,2)"))


def drop_negative_net(tx: DataFrame) -> DataFrame:
    """Rows with a negative net go; rows without a net stay."""
    return tx.where(F.col("IMPORTO_NETTO").isNull() | (F.col("IMPORTO_NETTO") >= 0))


def with_derived(tx: DataFrame) -> DataFrame:
    """Hour, day and net; they follow from the other columns, so shuffles can do without them."""
    return with_net(with_time_parts(tx.drop("ORA", "DATA", "IMPORTO_NETTO")))


def clean_transactions(typed: DataFrame) -> DataFrame:
    """Net amounts, negative nets dropped, price conflicts removed.

    Hour, day and net are left out of the shuffles and computed again at the end.
    """
    base = drop_negative_net(with_net(typed.drop("ORA", "DATA"))).drop("IMPORTO_NETTO")
    return with_derived(drop_price_conflicts(base))


def purchases(tx: DataFrame) -> DataFrame:
    return tx.where("DIREZIONE <> -1")


def active_lines(tx: DataFrame, cutoff: Column) -> DataFrame:
    """Lines strictly after the midnight that starts the cutoff day.

    The condition on the day follows from the one on the time; it is there for the scan to skip by.
    """
    return tx.where((F.col("DATA") >= cutoff) & (F.col("DATETIME") > cutoff.cast("timestamp_ntz")))


def basket_lines(tx: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """Purchase lines with a net that is not negative, from the cutoff day on."""
    lines = drop_negative_net(purchases(tx)).drop("DIREZIONE")
    return lines if cutoff is None else lines.where(F.col("DATA").isNull() | (F.col("DATA") >= cutoff))


def receipt_lines(tx: DataFrame, receipt: str, client: int, article: int) -> DataFrame:
    """Point lookup on receipt, client and article."""
    return tx.where((F.col("ID_SCONTRINO") == receipt) & (F.col("ID_CLI") == client)
                    & (F.col("ID_ARTICOLO") == article))


def zero_net_lines(tx: DataFrame) -> DataFrame:
    """Lines that a full discount brought to zero."""
    return tx.where("IMPORTO_NETTO = 0")


def fill_accounts(accounts: DataFrame) -> DataFrame:
    return accounts.fillna({"W_PHONE": 0, "EMAIL_PROVIDER": MISSING, "TYP_JOB": MISSING})


def cap_categories(df: DataFrame, column: str, keep: int = 20, other: str = OTHER) -> DataFrame:
    """The ``keep`` most frequent values stay, every other one becomes ``other``.

    The kept list has at most ``keep`` rows, which bounds the broadcast.
    """
    top = (
        df.groupBy(column).count().where(F.col(column).isNotNull())
        .orderBy(F.desc("count"), column).limit(keep).select(F.col(column).alias("_kept"))
    )
    return (
        df.join(F.broadcast(top), F.col(column) == F.col("_kept"), "left")
        .withColumn(column, F.coalesce("_kept", F.lit(other))).drop("_kept")
    )


def clean_accounts(accounts: DataFrame, keep: int = 20) -> DataFrame:
    return cap_categories(fill_accounts(accounts), "EMAIL_PROVIDER", keep)


def clean_addresses(addresses: DataFrame) -> DataFrame:
    """Exact duplicates dropped, then rows with any null; the null rows go first, before the shuffle."""
    return addresses.dropna("any").dropDuplicates()


def clean_privacy(privacy: DataFrame) -> DataFrame:
    flags = ("FLAG_PRIVACY_1", "FLAG_PRIVACY_2", "FLAG_DIRECT_MKT")
    return privacy.withColumns({f: F.col(f).cast("int") for f in flags})


def _card_order(date: Column) -> Column:
    return F.struct(date, F.col("ID_FID"))


def first_card(loyalty: DataFrame) -> DataFrame:
    """Earliest card per client; on one date the lowest card id. Clients without any date keep their lowest id."""
    dated = F.struct(F.col("DT_ACTIVE").isNull(), F.col("DT_ACTIVE"), F.col("ID_FID"))
    return loyalty.where("ID_CLI is not null").groupBy("ID_CLI").agg(
        F.min_by("ID_FID", dated).alias("ID_FID"), F.min_by("ID_NEG", dated).alias("FIRST_ID_NEG"),
        F.min("DT_ACTIVE").alias("FIRST_DT_ACTIVE"),
    )


def last_card(loyalty: DataFrame) -> DataFrame:
    """Latest card per client; on one date the highest card id. Null dates sort below every date."""
    dated = _card_order(F.col("DT_ACTIVE"))
    return loyalty.where("ID_CLI is not null").groupBy("ID_CLI").agg(
        F.max_by("ID_FID", dated).alias("ID_FID"), F.max_by("COD_FID", dated).alias("LAST_COD_FID"),
        F.max_by("TYP_CLI_FID", dated).alias("LAST_TYP_CLI_FID"),
        F.max_by("STATUS_FID", dated).alias("LAST_STATUS_FID"), F.max("DT_ACTIVE").alias("LAST_DT_ACTIVE"),
    )


def clean_loyalty(loyalty: DataFrame) -> DataFrame:
    """One row per client: last card's attributes, first card's shop and date, card count.

    One aggregate over one scan. ``min_by``/``max_by`` combine before each shuffle and the distinct
    card count shuffles by client and card first, so a client with very many cards is no hot task.
    """
    last = _card_order(F.col("DT_ACTIVE"))
    first = F.struct(F.col("DT_ACTIVE").isNull(), F.col("DT_ACTIVE"), F.col("ID_FID"))
    return loyalty.where("ID_CLI is not null").groupBy("ID_CLI").agg(
        F.max_by("ID_FID", last).alias("ID_FID"), F.max_by("COD_FID", last).alias("LAST_COD_FID"),
        F.max_by("TYP_CLI_FID", last).alias("LAST_TYP_CLI_FID"),
        F.max_by("STATUS_FID", last).alias("LAST_STATUS_FID"), F.max("DT_ACTIVE").alias("LAST_DT_ACTIVE"),
        F.min_by("ID_NEG", first).alias("FIRST_ID_NEG"), F.min("DT_ACTIVE").alias("FIRST_DT_ACTIVE"),
        F.countDistinct("ID_FID").alias("NUM_FIDs"),
    )
