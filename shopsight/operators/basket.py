"""Market basket: supports, baskets, frequent itemsets, rules and offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shopsight.functions.columns import joined, one_value
from shopsight.operators.cycle import next_purchase
from shopsight.session import materialize

# Lower bound (exclusive) and name of each support band, highest first.
SUPPORT_BANDS = [
    (0.01, "maggiore 1%"),
    (0.001, "0.1%-1%"),
    (0.0001, "0.01%-0.1%"),
    (0.00001, "0.001%-0.01%"),
    (0.000001, "0.0001%-0.001%"),
]
LOWEST_BAND = "minore 0.0001%"


def article_support(lines: DataFrame) -> DataFrame:
    """Distinct receipts per article over all receipts."""
    receipts = one_value(lines, F.countDistinct("ID_SCONTRINO"))
    return lines.where("ID_ARTICOLO is not null").groupBy("ID_ARTICOLO").agg(
        F.countDistinct("ID_SCONTRINO").alias("n_receipts")
    ).withColumn("support", F.col("n_receipts") / receipts)


def support_bands(support: DataFrame) -> DataFrame:
    """Articles per support band."""
    band = F.lit(LOWEST_BAND)
    for above, name in reversed(SUPPORT_BANDS):
        band = F.when(F.col("support") > above, name).otherwise(band)
    return support.groupBy(band.alias("band")).agg(F.count("*").alias("n_articles"))


def receipt_articles(lines: DataFrame) -> DataFrame:
    """Every article of every receipt once, written once: supports and baskets both read it, and the lines are met once."""
    return materialize(lines.select("ID_SCONTRINO", "ID_ARTICOLO").distinct(), "receipt-articles")


def high_support_articles(lines: DataFrame, min_support: float = 0.001) -> DataFrame:
    """Articles above the support threshold; whether a join broadcasts them is left to their measured size."""
    return article_support(lines).where(F.col("support") > min_support).select(F.col("ID_ARTICOLO").alias("item"))


def high_support_lines(lines: DataFrame, min_support: float = 0.001) -> DataFrame:
    """Lines of articles above the support threshold."""
    kept = high_support_articles(lines, min_support)
    return lines.join(kept, F.col("ID_ARTICOLO") == F.col("item"), "left_semi")


def basket_long(lines: DataFrame) -> DataFrame:
    """Units per receipt and article, and their 0/1 code."""
    return lines.where("ID_ARTICOLO is not null").groupBy("ID_SCONTRINO", "ID_ARTICOLO").agg(
        F.count("*").alias("units")).withColumn("present", (F.col("units") >= 1).cast("int"))


def baskets(lines: DataFrame, min_support: float = 0.001) -> DataFrame:
    """The sorted high-support articles of every receipt; receipts without any keep an empty basket.

    A basket never holds more than the high-support articles, of which there are at most
    (mean basket size / threshold), so no receipt grows without bound.
    """
    held = receipt_articles(lines)
    # an article comes once per receipt here, so counting needs no further distinct
    support = F.count("ID_SCONTRINO") / one_value(held, F.countDistinct("ID_SCONTRINO"))
    kept = held.where("ID_ARTICOLO is not null").groupBy(F.col("ID_ARTICOLO").alias("item")).agg(
        support.alias("support")).where(F.col("support") > min_support).select("item")
    return held.join(kept, F.col("ID_ARTICOLO") == F.col("item"), "left").groupBy("ID_SCONTRINO").agg(
        F.array_sort(F.collect_list("item")).alias("items"))


def frequent_itemsets(basket_table: DataFrame, min_support: float = 0.001) -> DataFrame:
    """Itemsets with at least the given support over all baskets, empty ones included.

    Counted level by level. Every frequent itemset that a basket holds is met once, with the basket's later
    items as ``rest``; an itemset and one of those items are a candidate of the next level. The candidates
    are summed up inside the tasks, so what is shuffled follows the number of itemsets and not of baskets.
    """
    total = basket_table.count()
    support = F.col("freq") / F.lit(total)

    def frequent(candidates: DataFrame, *by: str) -> DataFrame:
        return candidates.groupBy(*by).agg(F.count("*").alias("freq")).where(support >= min_support)

    rest = F.slice("rest", F.col("pos") + 2, F.greatest(F.size("rest"), F.lit(1)))
    met = basket_table.select(F.array_sort(F.array_distinct(F.array_compact("items"))).alias("rest"))
    level = materialize(frequent(met.select(F.explode("rest").alias("item")), "item").select(
        F.monotonically_increasing_id().alias("node"), F.array("item").alias("items"), "freq", "item"), "level")
    met = met.select("rest", F.posexplode("rest").alias("pos", "item")).join(level.select("node", "item"), "item").select(
        "node", rest.alias("rest")).where(F.size("rest") > 0)
    levels = level
    while not level.isEmpty():
        longer = frequent(met.select("node", F.explode("rest").alias("item")), "node", "item")
        level = materialize(longer.join(level.select("node", "items"), "node").select(
            F.monotonically_increasing_id().alias("next"), F.concat("items", F.array("item")).alias("items"), "freq",
            "item", "node"), "level")
        met = met.select("node", "rest", F.posexplode("rest").alias("pos", "item")).join(
            level.select("next", "node", "item"), ["node", "item"]).select(
            F.col("next").alias("node"), rest.alias("rest")).where(F.size("rest") > 0)
        level = level.drop("node").withColumnRenamed("next", "node")
        levels = levels.unionByName(level)
    return levels.select("items", "freq", F.lit(total).alias("n_receipts"), support.alias("support"),
                         F.size("items").alias("lunghezza"))


def association_rules(itemsets: DataFrame, min_confidence: float = 0.65) -> DataFrame:
    """Every split of every itemset in antecedents and consequents, kept from the given confidence on.

    Consequents grow by one item at a time. Confidence never rises when an item moves over to the
    consequents, so only those that two kept ones of the same itemset make together are looked at:
    a long itemset costs what its kept rules cost, not two to the power of its length.
    """
    counts = itemsets.select("items", "freq")
    left = counts.select(F.col("items").alias("antecedents"), F.col("freq").alias("freq_a"))
    whole = ["items", "freq", "n_receipts", "support"]

    def kept(splits: DataFrame) -> DataFrame:
        """Those splits whose antecedents are frequent enough for the confidence, written once."""
        return materialize(splits.withColumn("antecedents", F.array_except("items", "consequents")).join(
            left, "antecedents").where(F.col("freq").cast("double") / F.col("freq_a") >= min_confidence), "splits")

    longest = itemsets.agg(F.max(F.size("items")).alias("k")).first()["k"] or 0
    level = kept(itemsets.where(F.size("items") >= 2).select(*whole, F.explode("items").alias("c")).select(
        *whole, F.array("c").alias("consequents")))
    splits = level
    for size in range(2, longest):
        head, last = F.slice("consequents", 1, size - 2) if size > 2 else F.array().cast("array<string>"), F.element_at("consequents", -1)
        one = level.where(F.size("items") > size).select(*whole, "consequents", head.alias("head"), last.alias("last"))
        two = one.select("items", "head", F.col("last").alias("next"))
        grown = one.join(two, ["items", "head"]).where("last < next").select(
            *whole, F.concat("consequents", F.array("next")).alias("consequents"))
        level = kept(grown)
        if level.isEmpty():
            break
        splits = splits.unionByName(level)
    right = counts.select(F.col("items").alias("consequents"), F.col("freq").alias("freq_c"))
    f, n, fa, fc = (F.col(c).cast("double") for c in ("freq", "n_receipts", "freq_a", "freq_c"))
    return splits.withColumn("confidence", f / fa).join(right, "consequents").select(
        "antecedents", "consequents", (fa / n).alias("antecedent_support"),
        (fc / n).alias("consequent_support"), "support", "confidence",
        (f * n / (fa * fc)).alias("lift"), (F.col("support") - (fa / n) * (fc / n)).alias("leverage"),
        F.when(F.col("freq") == F.col("freq_a"), F.lit(float("inf")))
        .otherwise((1 - fc / n) / (1 - F.col("confidence"))).alias("conviction"))


def filter_rules(rules: DataFrame, above_support: float = 0.002, min_lift: float = 280) -> DataFrame:
    return rules.where((F.col("support") > above_support) & (F.col("lift") >= min_lift))


def rule_counts(rules: DataFrame) -> DataFrame:
    return rules.agg(F.count("*").alias("n_rules"), F.count_if(F.col("lift") >= 1).alias("n_lift_from_1"))


def redundant_rules(rules: DataFrame) -> DataFrame:
    """Rules beyond the first with the same consequents and confidence (first by antecedents).

    The first one per group comes from ``min_by``-style aggregation and the rest from a join, so a
    group that holds most rules is never sorted in one task.
    """
    named = rules.withColumns({"a": joined("antecedents"), "c": joined("consequents")})
    firsts = named.groupBy("c", "confidence").agg(F.min("a").alias("first_a"))
    return named.join(firsts, ["c", "confidence"]).where("a > first_a").select(*rules.columns)


def top_rules(rules: DataFrame, n: int = 15, by: str = "lift") -> DataFrame:
    """The best rules with their place and name; ties go by antecedents, then consequents."""
    order = [F.col(by).desc(), joined("antecedents"), joined("consequents")]
    best = rules.orderBy(*order).limit(n)
    return best.withColumn("place", F.row_number().over(W.orderBy(*order))).withColumn(
        "NOME", F.concat(F.lit("itemset"), F.col("place")))


def rule_edges(rules: DataFrame) -> DataFrame:
    """Edges antecedents to consequents of the rule network."""
    return rules.select(joined("antecedents").alias("src"), joined("consequents").alias("dst")).distinct()


def rule_articles(rules: DataFrame) -> DataFrame:
    """Distinct articles on either side of the rules."""
    return rules.select(F.explode(F.concat("antecedents", "consequents")).alias("ID_ARTICOLO")).distinct()


def article_lines(lines: DataFrame, articles: DataFrame) -> DataFrame:
    """Lines of the given articles."""
    return lines.join(articles, "ID_ARTICOLO", "left_semi")


def outside_department(lines: DataFrame, department: int = 3) -> DataFrame:
    return lines.where(F.col("COD_REPARTO") != department)


def best_article(stats: DataFrame) -> Column:
    """The article with the most receipts, the least id on a tie."""
    return one_value(stats, F.max_by("ID_ARTICOLO", F.struct("NUMERO_ACQUISTI", -F.col("ID_ARTICOLO"))))


def rule_lookup(rules: DataFrame, article: Column) -> DataFrame:
    """For one article: the antecedent sets that lead to it, and the articles it leads to."""
    marked = rules.withColumn("article", article)
    leading = marked.where(F.array_contains("consequents", F.col("article"))).select(
        "article", F.lit("influenced_by").alias("relation"), joined("antecedents").alias("items"))
    following = marked.where(F.array_contains("antecedents", F.col("article"))).select(
        "article", F.lit("influences").alias("relation"),
        F.explode("consequents").alias("items")).withColumn("items", F.col("items").cast("string"))
    return leading.unionByName(following).distinct()


def rule_value(rules: DataFrame, stats: DataFrame) -> DataFrame:
    """Mean prices summed over the antecedents, the consequents and both, per ranked rule."""
    sides = rules.select("place", F.explode(F.concat(
        F.transform("antecedents", lambda x: F.struct(F.lit("a").alias("side"), x.alias("item"))),
        F.transform("consequents", lambda x: F.struct(F.lit("c").alias("side"), x.alias("item"))),
    )).alias("x")).select("place", "x.side", "x.item")
    prices = stats.select(F.col("ID_ARTICOLO").alias("item"), "IMPORTO_MEDIO")
    zero = F.lit(0.0)
    sums = sides.join(prices, "item", "left").groupBy("place").agg(
        F.sum(F.when(F.col("side") == "a", F.coalesce("IMPORTO_MEDIO", zero)).otherwise(zero)).alias(
            "IMPORTO_MEDIO_ANTECEDENTS"),
        F.sum(F.when(F.col("side") == "c", F.coalesce("IMPORTO_MEDIO", zero)).otherwise(zero)).alias(
            "IMPORTO_MEDIO_CONSEQUENTS"),
    )
    return rules.join(sums, "place").select(
        "NOME", "antecedents", "consequents", "IMPORTO_MEDIO_ANTECEDENTS", "IMPORTO_MEDIO_CONSEQUENTS",
        (F.col("IMPORTO_MEDIO_ANTECEDENTS") + F.col("IMPORTO_MEDIO_CONSEQUENTS")).alias("IMPORTO_MEDIO_TOTALE"))


def bundle_receipts(lines: DataFrame, articles: DataFrame) -> DataFrame:
    """Receipts that hold every one of the given articles."""
    wanted = one_value(articles, F.countDistinct("ID_ARTICOLO"))
    return article_lines(lines, articles).groupBy("ID_SCONTRINO").agg(
        F.countDistinct("ID_ARTICOLO").alias("NUMERO_ARTICOLI")).where(F.col("NUMERO_ARTICOLI") == wanted)


def bundle_gaps(lines: DataFrame, articles: DataFrame) -> DataFrame:
    """Days between the last two purchases of the whole bundle, per client with at least two days."""
    whole = article_lines(lines, articles).join(
        bundle_receipts(lines, articles), "ID_SCONTRINO", "left_semi")
    return next_purchase(whole).where("NUMERO_ACQUISTI > 1")


def bundle_interval(gaps: DataFrame) -> DataFrame:
    return gaps.agg(F.count("*").alias("n_clients"), F.avg("NEXT_PURCHASE_DAY").alias("mean_days"))
