"""The composed pipelines. Stages that several analyses read are written once as Parquet tables.

The stage boundary is the same as between a cleaning job and the analyses that follow it: every
reader then scans only the columns it needs instead of repeating the joins and the duplicate
removal. Tables live in the shared scratch folder and are remembered per session and input folder.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopsight.functions.columns import one_value
from shopsight.operators import basket, cleaning, cycle, features, models, profile, rfm
from shopsight.session import delete_folder, folder_version, materialize, scratch_path
from shopsight.sources import retail
from shopsight.sources.files import read_table, write_table

HOLDOUT_DAYS = 365
MIN_SUPPORT = 0.001
MIN_CONFIDENCE = 0.05

Stored = TypeVar("Stored")

_STAGES: dict[tuple[str, str, str, str], tuple[object, str]] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, store: Callable[[str], Stored]) -> Stored:
    """What ``store`` writes below a path and reads back, once per application, input folder, its content, and name.

    A folder whose files were written anew has another content, so its stages are built again.
    """
    key = (spark.sparkContext.applicationId, sf_dir, folder_version(spark, sf_dir), name)
    if key not in _STAGES:
        path = scratch_path(spark, name)
        _STAGES[key] = store(path), path
    return _STAGES[key][0]


def _stage(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that is written once, as :func:`_once` has it."""
    def store(path: str) -> DataFrame:
        df = build()
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    return _once(spark, sf_dir, name, store)


def release_stages(spark: SparkSession) -> int:
    """Delete the stages that this application has written; gives their number."""
    own = [key for key in _STAGES if key[0] == spark.sparkContext.applicationId]
    for key in own:
        delete_folder(spark, _STAGES.pop(key)[1])
    return len(own)


def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned transaction lines, stored in order of day.

    The analyses look at the last part of the calendar; with narrow day ranges per file, their
    filter on the day skips most of the row groups. The receipt in the range key splits a busy day.
    """
    def build() -> DataFrame:
        lines = cleaning.clean_transactions(retail.transactions(spark, sf_dir))
        sold = lines.drop("ORA", "DATA", "IMPORTO_NETTO").repartitionByRange(F.to_date("DATETIME"), "ID_SCONTRINO")
        return cleaning.with_derived(sold)
    return _stage(spark, sf_dir, "lines", build)


def cutoff_day(lines: DataFrame, days: int = HOLDOUT_DAYS) -> Column:
    """The day that starts the holdout: the last day of the data less ``days``.

    The subquery yields the day itself, so a comparison with it can be pushed to the scan.
    """
    return one_value(lines, F.date_sub(F.max("DATA"), days))


def clean_loyalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_loyalty(retail.loyalty(spark, sf_dir))


def clean_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_accounts(retail.accounts(spark, sf_dir))


def write_clean_tables(spark: SparkSession, sf_dir: str, target: str) -> dict[str, str]:
    """Clean all five tables and write them below ``target``."""
    tables = {
        "transactions": clean_lines(spark, sf_dir),
        "loyalty": clean_loyalty(spark, sf_dir),
        "accounts": clean_accounts(spark, sf_dir),
        "addresses": cleaning.clean_addresses(retail.addresses(spark, sf_dir)),
        "privacy": cleaning.clean_privacy(retail.privacy(spark, sf_dir)),
    }
    return {name: write_table(df, f"{target}/{name}") for name, df in tables.items()}


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days to the next purchase per client; stored, as summaries and percentiles pass over it again."""
    return _stage(spark, sf_dir, "gaps", lambda: cycle.next_purchase(clean_lines(spark, sf_dir)))


def churn_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = clean_lines(spark, sf_dir)
    return cycle.churn_labels(lines, cutoff_day(lines))


def rfm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = clean_lines(spark, sf_dir)
    return rfm.rfm_base(cleaning.active_lines(lines, cutoff_day(lines)))


def scored_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartile scores of the active customers.

    The quartiles pass over the measures more than once, so the one row per customer is stored
    rather than summed up from the lines again each time.
    """
    return rfm.rfm_scores(_stage(spark, sf_dir, "rfm_base", lambda: rfm_base(spark, sf_dir)))


def rfm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rfm.level_summary(rfm.rfm_levels(rfm.rfm_segments(scored_customers(spark, sf_dir))))


def lines_by_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed lines stored in order of receipt: a look-up skips all row groups but those around its receipt."""
    return _stage(spark, sf_dir, "by-receipt", lambda: retail.transactions(spark, sf_dir).repartitionByRange(
        "ID_SCONTRINO", "ID_ARTICOLO").sortWithinPartitions("ID_SCONTRINO", "ID_ARTICOLO"))


def purchase_lines(spark: SparkSession, sf_dir: str, days: int | None = None) -> DataFrame:
    """Purchase lines with the fine articles, of the last ``days`` days if given."""
    lines = clean_lines(spark, sf_dir)
    return cleaning.basket_lines(lines, None if days is None else cutoff_day(lines, days))


def article_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per article and department, stored for the box statistics, which need several passes."""
    return _stage(spark, sf_dir, "articles", lambda: profile.article_profile(purchase_lines(spark, sf_dir)))


def coarse_lines(spark: SparkSession, sf_dir: str, days: int | None = None) -> DataFrame:
    """Purchase lines with the part size as a coarse article, of the last ``days`` days if given."""
    parts = read_table(spark, f"{sf_dir}/part.parquet", "p_partkey", "p_size")
    lines = purchase_lines(spark, sf_dir, days)
    return lines.join(parts, lines.ID_ARTICOLO == parts.p_partkey).withColumn(
        "ID_ARTICOLO", F.col("p_size").cast("long")).drop("p_partkey", "p_size")


def _since(name: str, days: int | None) -> str:
    return name if days is None else f"{name}-{days}"


def itemsets(spark: SparkSession, sf_dir: str, days: int | None = None) -> DataFrame:
    def build() -> DataFrame:
        table = materialize(basket.baskets(coarse_lines(spark, sf_dir, days), MIN_SUPPORT), "baskets")
        return basket.frequent_itemsets(table, MIN_SUPPORT)
    return _stage(spark, sf_dir, _since("itemsets", days), build)


def rules(spark: SparkSession, sf_dir: str, days: int | None = None) -> DataFrame:
    return _stage(spark, sf_dir, _since("rules", days), lambda: basket.association_rules(
        itemsets(spark, sf_dir, days), MIN_CONFIDENCE))


def top_rules(spark: SparkSession, sf_dir: str, n: int = 15, by: str = "lift", days: int | None = None) -> DataFrame:
    return basket.top_rules(rules(spark, sf_dir, days), n, by)


def rule_article_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price, receipts and clients of the articles in the best rules."""
    articles = basket.rule_articles(top_rules(spark, sf_dir))
    return profile.article_stats(basket.article_lines(coarse_lines(spark, sf_dir), articles))


def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles of the rule with the highest lift."""
    return basket.rule_articles(top_rules(spark, sf_dir, 1, "lift"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of features per customer."""
    return _stage(spark, sf_dir, "customers", lambda: features.feature_table(
        clean_loyalty(spark, sf_dir), clean_accounts(spark, sf_dir), churn_labels(spark, sf_dir)))


def model_rows(spark: SparkSession, sf_dir: str) -> tuple[list[str], DataFrame, DataFrame]:
    """Feature names, training rows (a tenth) and test rows."""
    plan = features.design(customers(spark, sf_dir))
    split = _stage(spark, sf_dir, "split", lambda: features.stratified_split(plan.rows))
    train, test = (split.where(F.col("part") == part).drop("part") for part in ("train", "test"))
    return plan.names, train, test


def churn_model(spark: SparkSession, sf_dir: str) -> models.Fitted:
    """The churn model with its scaler and feature names: fitted and written once, then read."""
    def store(path: str) -> models.Fitted:
        names, train, _ = model_rows(spark, sf_dir)
        models.Fitted.fit(train, names).save(path)
        return models.Fitted.load(spark, path)
    return _once(spark, sf_dir, "churn-model", store)


def churn_propensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, test = model_rows(spark, sf_dir)
    return models.propensity(churn_model(spark, sf_dir), test)
