"""One registered query per operator, over the whole of the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopsight import schemas
from shopsight.functions.columns import decimal_comma, joined, one_value
from shopsight.operators import basket, cleaning, cycle, duplicates, evaluate, features, models, neighbours, profile
from shopsight.operators import rfm, stats
from shopsight.plans import pipelines as P
from shopsight.session import scratch_path
from shopsight.sources import files, retail

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    """Register a query under its function name; its columns get types that every engine prints alike."""
    _QUERIES[build.__name__] = lambda spark, sf_dir: portable(build(spark, sf_dir))
    return build


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def portable(df: DataFrame) -> DataFrame:
    """Decimals as doubles, days, times and arrays as text, flags as integers."""
    def cell(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        elif isinstance(f.dataType, T.ArrayType):
            c = joined(c)
        return c.alias(f.name)
    return df.select(*[cell(f) for f in df.schema])


def _rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# ---------------------------------------------------------------- sources and cleaning

@query
def csv_roundtrip(spark, sf_dir):
    path = files.write_csv(retail.raw_transactions(spark, sf_dir), scratch_path(spark, "csv"), sep=";",
                           encoding="ISO-8859-1", gzip=True)
    return files.read_csv(spark, path, schemas.RAW_TRANSACTIONS)


@query
def decimal_comma_parse(spark, sf_dir):
    return retail.raw_transactions(spark, sf_dir).select(
        "ID_SCONTRINO", "ID_ARTICOLO", "IMPORTO_LORDO", decimal_comma("IMPORTO_LORDO").alias("gross"),
        decimal_comma("SCONTO").alias("discount"))


_QUERIES["decimal_comma"] = _QUERIES.pop("decimal_comma_parse")


@query
def tx_typed(spark, sf_dir):
    return cleaning.type_transactions(retail.raw_transactions(spark, sf_dir))


@query
def tx_net(spark, sf_dir):
    return cleaning.drop_negative_net(cleaning.with_net(retail.transactions(spark, sf_dir)))


@query
def tx_identical(spark, sf_dir):
    return duplicates.identical_rows(cleaning.drop_negative_net(
        cleaning.with_net(retail.transactions(spark, sf_dir))))


@query
def tx_dedup(spark, sf_dir):
    return duplicates.drop_price_conflicts(retail.transactions(spark, sf_dir))


@query
def tx_clean(spark, sf_dir):
    return cleaning.clean_transactions(retail.transactions(spark, sf_dir))


@query
def accounts_clean(spark, sf_dir):
    return P.clean_accounts(spark, sf_dir)


@query
def addresses_clean(spark, sf_dir):
    return cleaning.clean_addresses(retail.addresses(spark, sf_dir))


@query
def privacy_clean(spark, sf_dir):
    return cleaning.clean_privacy(retail.privacy(spark, sf_dir))


@query
def loyalty_first(spark, sf_dir):
    return cleaning.first_card(retail.loyalty(spark, sf_dir))


@query
def loyalty_last(spark, sf_dir):
    return cleaning.last_card(retail.loyalty(spark, sf_dir))


@query
def first_per_key(spark, sf_dir):
    cards = retail.loyalty(spark, sf_dir).select("ID_CLI", "DT_ACTIVE", "ID_FID")
    return duplicates.first_per_key(cards, "ID_CLI", ["DT_ACTIVE", "ID_FID"])


@query
def loyalty_clean(spark, sf_dir):
    return P.clean_loyalty(spark, sf_dir)


@query
def provider_capped(spark, sf_dir):
    return P.clean_accounts(spark, sf_dir).select("ID_CLI", "EMAIL_PROVIDER")


@query
def null_profile(spark, sf_dir):
    return profile.null_profile(retail.accounts(spark, sf_dir))


@query
def table_profile(spark, sf_dir):
    return profile.table_profile(P.clean_lines(spark, sf_dir))


@query
def receipt_lookup(spark, sf_dir):
    """Lines of the receipt, client and article with the highest gross amount."""
    tx = P.lines_by_receipt(spark, sf_dir)
    key = one_value(tx, F.min_by(
        F.struct("ID_SCONTRINO", "ID_CLI", "ID_ARTICOLO"),
        F.struct(-F.col("IMPORTO_LORDO"), F.col("ID_SCONTRINO"), F.col("ID_CLI"), F.col("ID_ARTICOLO"))))
    return cleaning.receipt_lines(tx, key["ID_SCONTRINO"], key["ID_CLI"], key["ID_ARTICOLO"])


@query
def clean_tables(spark, sf_dir):
    """The five cleaned tables, written and read back: their rows and columns."""
    paths = P.write_clean_tables(spark, sf_dir, scratch_path(spark, "clean"))
    return _union([profile.table_size(files.read_table(spark, path)).withColumn("table_name", F.lit(name))
                   for name, path in paths.items()])


@query
def zero_net_audit(spark, sf_dir):
    return profile.zero_net_audit(cleaning.drop_negative_net(
        cleaning.with_net(retail.transactions(spark, sf_dir))))


@query
def zero_net_rows(spark, sf_dir):
    return cleaning.zero_net_lines(P.clean_lines(spark, sf_dir))


@query
def dup_report(spark, sf_dir):
    tables = {
        "transactions": (retail.transactions(spark, sf_dir), {"rows": None, "sale": duplicates.SALE_KEY}),
        "loyalty": (retail.loyalty(spark, sf_dir), {
            "rows": None, "ID_FID": ["ID_FID"], "ID_CLI": ["ID_CLI"], "ID_CLI, ID_FID": ["ID_CLI", "ID_FID"]}),
        "accounts": (retail.accounts(spark, sf_dir), {"rows": None, "ID_CLI": ["ID_CLI"]}),
        "addresses": (retail.addresses(spark, sf_dir), {"rows": None, "ID_ADDRESS": ["ID_ADDRESS"]}),
        "privacy": (retail.privacy(spark, sf_dir), {"rows": None, "ID_CLI": ["ID_CLI"]}),
    }
    reports = [duplicates.duplicate_report(df, subsets).withColumn("table_name", F.lit(name))
               for name, (df, subsets) in tables.items()]
    return _union(reports)


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


@query
def key_coverage(spark, sf_dir):
    loyalty, accounts = retail.loyalty(spark, sf_dir), retail.accounts(spark, sf_dir)
    addresses, privacy = retail.addresses(spark, sf_dir), retail.privacy(spark, sf_dir)
    checks = {
        "loyalty in accounts": (loyalty, accounts, "ID_CLI"),
        "accounts in addresses": (accounts, cleaning.clean_addresses(addresses), "ID_ADDRESS"),
        "loyalty in privacy": (loyalty, privacy, "ID_CLI"),
        "privacy in loyalty": (privacy, loyalty, "ID_CLI"),
    }
    return _union([duplicates.key_coverage(*check).withColumn("check_name", F.lit(name))
                   for name, check in checks.items()])


# ---------------------------------------------------------------- distributions

@query
def tx_overview(spark, sf_dir):
    return profile.overview(P.clean_lines(spark, sf_dir))


@query
def dist_direction(spark, sf_dir):
    return profile.direction_distribution(P.clean_lines(spark, sf_dir))


@query
def dist_hour(spark, sf_dir):
    return profile.distribution_within_direction(P.clean_lines(spark, sf_dir), "ORA")


@query
def dist_department(spark, sf_dir):
    return profile.distribution_within_direction(P.clean_lines(spark, sf_dir), "COD_REPARTO")


@query
def dist_article(spark, sf_dir):
    return profile.receipts_and_clients(P.clean_lines(spark, sf_dir), "ID_ARTICOLO", "DIREZIONE")


@query
def receipts_per_customer(spark, sf_dir):
    return profile.receipts_per_client(P.clean_lines(spark, sf_dir))


@query
def customers_at_least(spark, sf_dir):
    return profile.clients_at_least(profile.receipts_per_client(P.clean_lines(spark, sf_dir)))


@query
def top_customers(spark, sf_dir):
    return profile.top_clients(profile.receipts_per_client(P.clean_lines(spark, sf_dir)))


@query
def fid_distribution(spark, sf_dir):
    return profile.card_distribution(retail.loyalty(spark, sf_dir))


@query
def dist_loyalty(spark, sf_dir):
    cards = P.clean_loyalty(spark, sf_dir)
    return _union([
        profile.client_distribution(cards, c).select(
            F.lit(c).alias("variable"), F.col(c).cast("string").alias("value"), "TOT_CLIs", "PERCENT_CLIs")
        for c in ("LAST_COD_FID", "LAST_TYP_CLI_FID", "LAST_STATUS_FID", "NUM_FIDs")])


@query
def value_counts(spark, sf_dir):
    return profile.value_counts(cleaning.fill_accounts(retail.accounts(spark, sf_dir)), "EMAIL_PROVIDER")


@query
def provider_cumulative(spark, sf_dir):
    return profile.cumulative_counts(cleaning.fill_accounts(retail.accounts(spark, sf_dir)), "EMAIL_PROVIDER")


@query
def tier_activity(spark, sf_dir):
    return profile.rows_per_value(
        P.clean_lines(spark, sf_dir), P.clean_loyalty(spark, sf_dir), "ID_CLI", "LAST_COD_FID", "DATETIME")


# ---------------------------------------------------------------- purchase cycle

@query
def next_purchase(spark, sf_dir):
    return cycle.next_purchase(P.clean_lines(spark, sf_dir))


@query
def npd_summary(spark, sf_dir):
    return _rounded(profile.number_summary(P.gaps(spark, sf_dir), "NEXT_PURCHASE_DAY"), 6, "mean", "std")


@query
def npd_percentiles(spark, sf_dir):
    return _rounded(cycle.gap_percentiles(P.gaps(spark, sf_dir)), 6, "days")


@query
def npd_curve(spark, sf_dir):
    return cycle.gap_curve(P.gaps(spark, sf_dir))


@query
def histogram(spark, sf_dir):
    return _rounded(stats.histogram(P.gaps(spark, sf_dir), "NEXT_PURCHASE_DAY", 30), 6, "bin_from", "bin_to")


@query
def churn_label(spark, sf_dir):
    lines = P.clean_lines(spark, sf_dir)
    return cycle.churn_labels(lines, P.cutoff_day(lines), with_receipts=True)


@query
def churn_tx(spark, sf_dir):
    return cycle.label_lines(
        P.clean_lines(spark, sf_dir).drop("IMPORTO_LORDO", "SCONTO"), P.churn_labels(spark, sf_dir))


# ---------------------------------------------------------------- segmentation

@query
def active_lines(spark, sf_dir):
    lines = P.clean_lines(spark, sf_dir)
    return cleaning.active_lines(lines, P.cutoff_day(lines))


@query
def rfm_base(spark, sf_dir):
    return P.rfm_base(spark, sf_dir)


@query
def rfm_scores(spark, sf_dir):
    return P.scored_customers(spark, sf_dir)


@query
def rfm_classes(spark, sf_dir):
    return rfm.rfm_classes(P.scored_customers(spark, sf_dir)).select(
        "ID_CLI", "R_Class", "F_Class", "M_Class")


@query
def rfm_class_summary(spark, sf_dir):
    classes = rfm.rfm_classes(P.scored_customers(spark, sf_dir))
    return profile.category_summary(rfm.rf_labels(classes), ["R_Class", "F_Class", "M_Class", "RF_Class"])


@query
def rf_matrix(spark, sf_dir):
    return rfm.rf_matrix(rfm.rf_labels(rfm.rfm_classes(P.scored_customers(spark, sf_dir))))


@query
def rfm_segments(spark, sf_dir):
    return rfm.rfm_segments(P.scored_customers(spark, sf_dir)).select("ID_CLI", "RFM_Segment_Concat", "RFM_Score")


@query
def rfm_segment_count(spark, sf_dir):
    return rfm.segment_count(rfm.rfm_segments(P.scored_customers(spark, sf_dir)))


@query
def rfm_levels(spark, sf_dir):
    return rfm.rfm_levels(rfm.rfm_segments(P.scored_customers(spark, sf_dir))).select(
        "ID_CLI", "RFM_Score", "RFM_Level")


@query
def rfm_level_summary(spark, sf_dir):
    return P.rfm_summary(spark, sf_dir)


# ---------------------------------------------------------------- market basket

@query
def mba_lines(spark, sf_dir):
    lines = P.clean_lines(spark, sf_dir)
    return cleaning.basket_lines(lines, P.cutoff_day(lines))


@query
def article_profile(spark, sf_dir):
    return profile.article_profile(P.purchase_lines(spark, sf_dir))


@query
def articles_per_department(spark, sf_dir):
    return profile.articles_per_department(P.article_profile(spark, sf_dir))


@query
def article_support(spark, sf_dir):
    return basket.article_support(P.purchase_lines(spark, sf_dir))


@query
def support_buckets(spark, sf_dir):
    return basket.support_bands(basket.article_support(P.purchase_lines(spark, sf_dir)))


@query
def high_support_tx(spark, sf_dir):
    return basket.high_support_lines(P.purchase_lines(spark, sf_dir), P.MIN_SUPPORT)


@query
def outside_department(spark, sf_dir):
    return basket.outside_department(P.purchase_lines(spark, sf_dir))


@query
def box_stats(spark, sf_dir):
    return _rounded(stats.box_stats(P.article_profile(spark, sf_dir), "REPARTO", "IMPORTO_MEDIO"),
                    6, "q1", "median", "q3")


@query
def kde_grid(spark, sf_dir):
    kept = basket.high_support_lines(P.purchase_lines(spark, sf_dir), P.MIN_SUPPORT)
    return stats.density(profile.article_profile(kept), "IMPORTO_MEDIO").select(
        "point", F.round("x", 6).alias("x"), F.round(F.col("density") * 1e6, 6).alias("density_per_million"))


@query
def basket_long(spark, sf_dir):
    return basket.basket_long(basket.high_support_lines(P.purchase_lines(spark, sf_dir), P.MIN_SUPPORT))


@query
def basket_arrays(spark, sf_dir):
    return basket.baskets(P.purchase_lines(spark, sf_dir), P.MIN_SUPPORT)


@query
def freq_itemsets(spark, sf_dir):
    return P.itemsets(spark, sf_dir)


@query
def rules(spark, sf_dir):
    return _rounded(P.rules(spark, sf_dir), 9, "leverage", "conviction")


@query
def recent_itemsets(spark, sf_dir):
    """Itemsets of the lines from the cutoff day on, as the analysis cuts them first."""
    return P.itemsets(spark, sf_dir, P.HOLDOUT_DAYS)


@query
def recent_rules(spark, sf_dir):
    return _rounded(P.rules(spark, sf_dir, P.HOLDOUT_DAYS), 9, "leverage", "conviction")


@query
def recent_top_rules(spark, sf_dir):
    return P.top_rules(spark, sf_dir, days=P.HOLDOUT_DAYS).select(
        "NOME", "antecedents", "consequents", "support", "confidence", "lift")


@query
def rule_counts(spark, sf_dir):
    return basket.rule_counts(P.rules(spark, sf_dir))


@query
def strong_rules(spark, sf_dir):
    strong = basket.filter_rules(P.rules(spark, sf_dir), above_support=0.002, min_lift=1)
    return strong.select("antecedents", "consequents", "support", "confidence", "lift")


@query
def redundant_rules(spark, sf_dir):
    return basket.redundant_rules(P.rules(spark, sf_dir)).select("antecedents", "consequents", "confidence")


@query
def top_rules(spark, sf_dir):
    return P.top_rules(spark, sf_dir).select("NOME", "antecedents", "consequents", "support", "confidence", "lift")


@query
def rule_edges(spark, sf_dir):
    return basket.rule_edges(P.top_rules(spark, sf_dir))


@query
def rule_articles(spark, sf_dir):
    articles = basket.rule_articles(P.top_rules(spark, sf_dir))
    return basket.article_lines(P.coarse_lines(spark, sf_dir), articles)


@query
def article_stats(spark, sf_dir):
    return P.rule_article_stats(spark, sf_dir)


@query
def rule_lookup(spark, sf_dir):
    return basket.rule_lookup(
        P.top_rules(spark, sf_dir), basket.best_article(P.rule_article_stats(spark, sf_dir)))


@query
def rule_value(spark, sf_dir):
    amounts = [f"IMPORTO_MEDIO_{part}" for part in ("ANTECEDENTS", "CONSEQUENTS", "TOTALE")]
    return _rounded(basket.rule_value(
        P.top_rules(spark, sf_dir), P.rule_article_stats(spark, sf_dir)), 4, *amounts)


@query
def bundle_receipts(spark, sf_dir):
    return basket.bundle_receipts(P.coarse_lines(spark, sf_dir), P.bundle(spark, sf_dir))


@query
def bundle_interval(spark, sf_dir):
    return basket.bundle_interval(basket.bundle_gaps(P.coarse_lines(spark, sf_dir), P.bundle(spark, sf_dir)))


# ---------------------------------------------------------------- churn profile and features

@query
def feature_table(spark, sf_dir):
    return features.feature_table(P.clean_loyalty(spark, sf_dir), P.clean_accounts(spark, sf_dir),
                                  P.churn_labels(spark, sf_dir))


@query
def churn_rate(spark, sf_dir):
    return stats.churn_rate(P.customers(spark, sf_dir))


@query
def churn_by_tier(spark, sf_dir):
    return stats.churn_by(P.customers(spark, sf_dir), "LAST_COD_FID")


@query
def corr_matrix(spark, sf_dir):
    return _rounded(stats.correlation_pairs(
        P.customers(spark, sf_dir), features.PROFILE_COLUMNS, "N_LINES"), 6, "corr")


@query
def corr_with_churn(spark, sf_dir):
    return _rounded(stats.correlation_with(
        P.customers(spark, sf_dir), features.PROFILE_COLUMNS, "CHURN", "N_LINES"), 6, "corr")


@query
def vif(spark, sf_dir):
    return _rounded(stats.vif(P.customers(spark, sf_dir), features.NUMERIC_FEATURES, "N_LINES"), 6, "vif")


@query
def vif_profile(spark, sf_dir):
    """Collinearity of the six profiled columns, before one of them is dropped."""
    return _rounded(stats.vif(P.customers(spark, sf_dir), features.PROFILE_COLUMNS, "N_LINES"), 4, "vif")


@query
def dummies_long(spark, sf_dir):
    table = P.customers(spark, sf_dir).select("ID_CLI", "LAST_COD_FID", "TYP_JOB")
    return features.long_dummies(table, "ID_CLI", ["LAST_COD_FID", "TYP_JOB"])


@query
def dummies(spark, sf_dir):
    table = P.customers(spark, sf_dir).select("ID_CLI", "LAST_COD_FID", "TYP_JOB")
    return features.dummies(table, ["LAST_COD_FID", "TYP_JOB"])


@query
def standardise(spark, sf_dir):
    scaled = features.standardise(
        P.customers(spark, sf_dir).select("ID_CLI", *features.NUMERIC_FEATURES), features.NUMERIC_FEATURES)
    return _rounded(scaled, 6, *features.NUMERIC_FEATURES)


@query
def decile_rank(spark, sf_dir):
    customer = files.read_table(spark, f"{sf_dir}/customer.parquet", "c_custkey", "c_acctbal")
    return features.decile_ranks(customer, "c_acctbal", "c_custkey")


def _neighbours(spark, sf_dir, k):
    vectors = files.read_table(spark, f"{sf_dir}/embeddings.parquet", "vec_id", "embedding", "label")
    points = vectors.select("vec_id", F.col("embedding").alias("x"), "label")
    near = neighbours.nearest(points.withColumnRenamed("vec_id", "query_id"),
                              points.withColumnRenamed("vec_id", "train_id"), k, leave_one_out=True)
    return near, points.select(F.col("vec_id").alias("query_id"), "label")


@query
def knn_vote(spark, sf_dir):
    near, _ = _neighbours(spark, sf_dir, 22)
    return neighbours.votes(near, [22]).select("query_id", "k", "prediction")


@query
def knn_sweep(spark, sf_dir):
    near, truth = _neighbours(spark, sf_dir, 24)
    return neighbours.accuracy_by_k(neighbours.votes(near, range(1, 25)), truth)


@query
def binary_metrics(spark, sf_dir):
    marks = files.read_table(spark, f"{sf_dir}/labels.parquet", "quality", "toxic")
    return evaluate.binary_metrics(evaluate.confusion(marks, "quality", "toxic"))


@query
def roc_curve(spark, sf_dir):
    marks = files.read_table(spark, f"{sf_dir}/labels.parquet", "doc_id", "quality")
    sizes = files.read_table(spark, f"{sf_dir}/documents.parquet", "doc_id", "n_chars")
    return evaluate.roc_curve(marks.join(sizes, "doc_id"), "quality", "n_chars").select("threshold", "fpr", "tpr")


@query
def stratified_split(spark, sf_dir):
    table = P.customers(spark, sf_dir).select("ID_CLI", F.col("CHURN").alias("label"))
    return features.stratified_split(table)


def _bayes_folds(spark, sf_dir):
    table = P.customers(spark, sf_dir).select("ID_CLI", F.col("CHURN").cast("double").alias("label"), *features.NUMERIC_FEATURES)
    points = VectorAssembler(inputCols=features.NUMERIC_FEATURES, outputCol="x").transform(table)
    return models.fold_accuracy(features.stratified_folds(points.select("ID_CLI", "label", "x")))


@query
def cv_naive_bayes(spark, sf_dir):
    """Rows and right predictions of naive Bayes per fold."""
    return _bayes_folds(spark, sf_dir).select("fold", "n", "n_right")


@query
def fold_boxes(spark, sf_dir):
    """Box statistics of the fold scores."""
    scores = _bayes_folds(spark, sf_dir).select(F.lit("Gaussian NB").alias("model"), "accuracy")
    return _rounded(stats.box_stats(scores, "model", "accuracy"), 9, "q1", "median", "q3", "whisker_low", "whisker_high")


# ---------------------------------------------------------------- models (rows and properties only)

@query
def model_compare(spark, sf_dir):
    _, train, test = P.model_rows(spark, sf_dir)
    folded = models.cv_summary(models.cross_validate(features.hash_folds(train), models.first_round()))
    return folded.join(models.holdout(train, test, models.second_round()), "model")


@query
def cv_accuracy(spark, sf_dir):
    _, train, _ = P.model_rows(spark, sf_dir)
    scores = models.cross_validate(features.stratified_folds(train), {"Logistic Regression": models.logistic()})
    return scores.agg(F.avg("accuracy").alias("accuracy_mean"),
                      (F.stddev_pop("accuracy") * 2).alias("accuracy_2std"))


@query
def grid_search(spark, sf_dir):
    _, train, _ = P.model_rows(spark, sf_dir)
    return models.grid_search(features.stratified_folds(train))


@query
def forest_sweep(spark, sf_dir):
    _, train, test = P.model_rows(spark, sf_dir)
    return models.forest_sweep(train, test)


@query
def coefficients(spark, sf_dir):
    return models.coefficients(P.churn_model(spark, sf_dir))


@query
def propensity(spark, sf_dir):
    return P.churn_propensity(spark, sf_dir)


@query
def propensity_deciles(spark, sf_dir):
    return models.propensity_deciles(P.churn_propensity(spark, sf_dir))


@query
def confusion(spark, sf_dir):
    scored = P.churn_propensity(spark, sf_dir)
    return evaluate.confusion(scored, "CHURN", "predictions")
