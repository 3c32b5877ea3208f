"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every run of ``WINDOW - GRAM + 1`` consecutive k-gram hashes the least is kept, so two texts that share a
span of WINDOW words share a kept hash. Documents and items meet on those hashes; the documents that meet an
item are then compared exactly, and hits extend to whole shared spans: the union of all shared windows.
Items with fewer words than a window are one window each; their own lengths (at most twelve) are looked up
as word sequences in all documents.

Defined results: a null text has no words, and a document or item without words is never hit. Items with
the same item_id are one item; a null item_id counts as an empty one. Every input row gives one row, also
where a doc_id repeats or is null. Words are compared as strings, not as hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopsight.llm import common as C

WINDOW, GRAM = 13, 8
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower()))
    return F.array_remove(F.split(lower, _SEPARATORS), "")


def _shifted(array: Column, by: int) -> Column:
    return F.slice(array, F.lit(by + 1), F.greatest(F.size(array) - by, F.lit(0)))


def _fingerprints(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep``, n_words, and prints: the distinct kept hashes of the words in ``words``."""
    def zipped(rows: DataFrame, by: int, combine) -> DataFrame:
        return rows.select(*keep, "n_words", F.zip_with("prints", _shifted(F.col("prints"), by), combine).alias("prints"))

    rows = rows.select(*keep, F.size("words").cast("long").alias("n_words"),
                       F.transform("words", lambda w: F.xxhash64(w)).alias("prints"))
    for step in (1, 2, 4):  # hashes of 2, 4 and GRAM = 8 words
        rows = zipped(rows, step, lambda a, b: F.xxhash64(a, b))
    for step in (1, 2, 2):  # least of 2, 4 and WINDOW - GRAM + 1 = 6 hashes
        rows = zipped(rows, step, lambda a, b: F.least(a, b))
    # the runs behind the last whole one are cut off; no window lies in them alone
    whole = F.greatest(F.col("n_words") - WINDOW + 1, F.lit(0)).cast("int")
    return rows.select(*keep, "n_words", F.array_distinct(F.slice("prints", F.lit(1), whole)).alias("prints"))


def _windows(length: Column | int) -> Column:
    """All runs of so many words, as strings."""
    length = F.lit(length) if isinstance(length, int) else length
    n = F.size("words")
    return F.when(n >= length, F.transform(
        F.sequence(F.lit(1), F.greatest(n - length + 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice("words", i, length))))


def contamination(docs: DataFrame, items: DataFrame, *, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (sorted as strings, comma-joined) and contaminated of every row.

    A word is hit if it lies in an occurrence of an item's window; a document is contaminated if at least
    one in ``share`` of its words is hit.
    """
    docs = C.query_columns(docs, doc_id="long", text="string").withColumn("mark", F.xxhash64("text"))
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                         word_array(F.col("text").cast("string")).alias("words"))
    long_items, short_items = items.where(F.size("words") >= WINDOW), items.where(
        (F.size("words") > 0) & (F.size("words") < WINDOW))
    found = C.stage(_fingerprints(docs.select("doc_id", "mark", word_array(F.col("text")).alias("words")),
                                  "doc_id", "mark"), "winnowed")

    item_prints = _fingerprints(long_items).select(F.explode("prints").alias("print")).distinct()
    met = C.stage(found.select("doc_id", "mark", F.explode("prints").alias("print")).join(item_prints, "print").select(
        F.col("doc_id").alias("id"), F.col("mark").alias("met")).distinct(), "met-documents")
    near = docs.join(met, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("met")), "left_semi")

    def hits(rows: DataFrame, some_items: DataFrame, length: int) -> DataFrame:
        ours = rows.withColumn("words", word_array(F.col("text"))).select(
            "doc_id", "mark", F.posexplode(_windows(length)).alias("begin", "window"))
        theirs = some_items.select("item_id", F.explode(_windows(length)).alias("window")).distinct()
        return ours.join(theirs, "window").select(
            "doc_id", "mark", "item_id", "begin", (F.col("begin") + length).alias("end"))

    all_hits = hits(near, long_items, WINDOW)
    for row in short_items.select(F.size("words").alias("n")).distinct().orderBy("n").collect():  # at most twelve
        all_hits = all_hits.union(hits(docs, short_items.where(F.size("words") == row["n"]), row["n"]))
    all_hits = C.stage(all_hits, "hits")

    spans = all_hits.groupBy("doc_id", "mark", "begin").agg(F.max("end").alias("end"))
    before = F.expr("max(end) OVER (PARTITION BY doc_id, mark ORDER BY begin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    lengths = spans.withColumn("covered", F.greatest(
        F.lit(0), F.col("end") - F.greatest(F.col("begin"), F.coalesce(before, F.lit(0))))).groupBy("doc_id", "mark").agg(
        F.sum("covered").alias("n_hit"))
    ids = all_hits.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    per_text = lengths.alias("a").join(ids.alias("b"), F.expr("a.doc_id <=> b.doc_id AND a.mark <=> b.mark")).select(
        F.col("a.doc_id").alias("id"), F.col("a.mark").alias("met"), "n_hit", "ids")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return found.join(per_text, F.expr("doc_id <=> id AND mark <=> met"), "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.concat_ws(",", "ids"), F.lit("")).alias("item_ids"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """The documents that are not contaminated, with all their columns; rows that share a doc_id go together."""
    bad = contamination(docs, items, **settings).where("contaminated").select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("__bad")), "left_anti")


ORACLE = """
WITH w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM {documents}
), items AS (
    SELECT item_id, words, least(len(words), 13) AS size FROM (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark)
    WHERE len(words) > 0
), theirs AS (
    SELECT DISTINCT item_id, size, unnest(list_transform(range(1, len(words) - size + 2),
        lambda i: array_to_string(words[i:i + size - 1], ' '))) AS win FROM items
), ours AS (
    SELECT doc_id, size, unnest(range(1, len(words) - size + 2)) AS pos,
        unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i:i + size - 1], ' '))) AS win
    FROM w, (SELECT DISTINCT size FROM items) WHERE len(words) >= size
), hits AS (
    SELECT o.doc_id, o.pos, o.size, t.item_id FROM ours o JOIN theirs t USING (size, win)
), hit_words AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
), judged AS (
    SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
        CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
    FROM w LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
)
"""
