"""Source divergence audit by chunk factorization.

Every task counts the whitespace chunks of each of its documents and adds them up per language and chunk:
documents, occurrences per source, and the row numbers of the documents while they are fewer than ``least``. All
counts of a chunk then meet in one task, where each globally distinct chunk is split into terms once and its terms
are joined back to the counts. What is shuffled is one row per slice of documents and chunk, not one per word, so a
frequent word travels as a number.

A language keeps the terms that at least ``least`` of its documents hold. The sum of the document counts of a
term's chunks bounds that number from above, the largest of them from below; only the terms between the bounds
need distinct documents, and all their chunks are rare, so at most ``least - 1`` row numbers a chunk are gathered.
Shares are whole billionths from integer division. Pairs of sources are summed over buckets of about ``BUCKET``
terms as a dense matrix of one language's sources, and the sums are added up: no join forms pairs.

Defined results: a null text, language or source is an empty one; a row is a document, also where rows repeat.
Empty texts hold no terms, but their source takes part in its language (with equal shares of 5 / 5V). A
language without kept terms has differences of 0 and no term rows; one with a single source has no pair rows.
Ties go by the UTF-8 order of the item. Chunks of any length are whole keys. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shopsight.llm import common as C

BUCKET = 1024  # terms in one matrix
SMOOTH, SCALE, TOP = 5, 1_000_000_000, 50
_TERM = re.compile(rb"[a-z\x80-\xff]+")  # of lower-cased UTF-8: letters and whatever isn't ASCII
_PARTS = "lang string, chunk string, docs long, sources array<string>, ns array<long>, ids array<long>"
_CHUNKS = "lang string, docs long, sources array<string>, ns array<long>, ids array<long>, terms array<string>, times array<long>"


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Place of each value in the list of distinct values, and that list."""
    found = values.dictionary_encode()
    if isinstance(found, pa.ChunkedArray):
        found = found.combine_chunks()
    return np.asarray(found.indices).astype(np.int64), found.dictionary


def _starts(*keys: np.ndarray) -> np.ndarray:
    """First rows of the runs of equal keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _lists(values: pa.Array, lengths: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32), mask=None if missing is None else np.r_[missing, False])
    return pa.ListArray.from_arrays(offsets, values)


def _slices(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows with about ``limit`` bytes of text; a longer text is a slice of its own."""
    upto = np.cumsum(np.asarray(pc.binary_length(batch["text"])).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + limit, "right")))
        yield batch.slice(first, last - first)
        first = last


def _chunk_counts(docs: DataFrame, least: int, limit: int = 24 << 20) -> DataFrame:
    """Partial counts per language and chunk, with occurrences per source; ``ids`` is null from ``least`` documents on.

    A row with a null chunk lists the sources of a language. ``limit`` bytes of text are counted together.
    """
    def run(batches):
        for batch in batches:
            for part in _slices(batch, limit):
                yield count(part)
        C.release_memory()

    def count(part):
        split = pc.ascii_split_whitespace(part["text"])
        chunk, chunks = _codes(split.flatten())
        doc = np.asarray(pc.list_parent_indices(split)).astype(np.int64)
        some = np.asarray(pc.not_equal(chunks, "")).astype(bool)[chunk]
        doc, chunk = doc[some], chunk[some]
        lang, langs = _codes(part["lang"])
        source, sources = _codes(part["source"])
        row = np.asarray(part["row"])
        width = max(1, len(chunks))
        pair, times = np.unique(doc * width + chunk, return_counts=True)  # one for each document and chunk
        doc, chunk = pair // width, pair % width
        order = np.lexsort((source[doc], chunk, lang[doc]))
        doc, chunk, times = doc[order], chunk[order], times[order]
        begin = _starts(lang[doc], chunk)
        size = np.diff(np.r_[begin, len(doc)])
        rare = np.repeat(size < least, size)
        cell = _starts(lang[doc], chunk, source[doc])
        per_key = np.diff(np.searchsorted(cell, np.r_[begin, len(doc)]))
        everywhere = np.unique(np.stack([lang, source]), axis=1)  # the groups, with or without chunks
        known, number = np.unique(everywhere[0], return_counts=True)
        more = np.zeros(len(known), np.int64)
        return pa.RecordBatch.from_pydict({
            "lang": langs.take(pa.array(np.r_[lang[doc[begin]], known])),
            "chunk": pa.concat_arrays([chunks.take(pa.array(chunk[begin])), pa.nulls(len(more), pa.string())]),
            "docs": pa.array(np.r_[size, more]),
            "sources": _lists(sources.take(pa.array(np.r_[source[doc[cell]], everywhere[1]])), np.r_[per_key, number]),
            "ns": _lists(pa.array(np.r_[np.add.reduceat(times, cell) if len(cell) else cell, 0 * everywhere[1]]),
                         np.r_[per_key, number]),
            "ids": _lists(pa.array(row[doc[rare]]), np.r_[np.where(size < least, size, 0), more], np.r_[size >= least, more == 0])})

    return docs.mapInArrow(run, _PARTS)


def _split_chunks(parts: DataFrame, least: int) -> DataFrame:
    """One row per language and chunk, with the chunk's terms; null terms on the rows that list sources.

    All rows of a chunk are in one task, one after the other, and it is split into terms once.
    """
    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            chunk, _ = _codes(table["chunk"].combine_chunks().fill_null(" "))  # no chunk is a space
            last = int(_starts(chunk)[-1])
            held = table.slice(last)
            if last:
                yield merge(table.slice(0, last))
        if held is not None:
            yield merge(held)
        C.release_memory()

    def merge(table):
        column = {name: table[name].combine_chunks() for name in table.column_names}
        chunk, chunks = _codes(column["chunk"].fill_null(" "))
        lang, _ = _codes(column["lang"])
        begin = _starts(chunk, lang)
        group = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(chunk)]))
        docs = np.add.reduceat(np.asarray(column["docs"]), begin)

        source, sources = _codes(column["sources"].flatten())
        owner = group[np.asarray(pc.list_parent_indices(column["sources"])).astype(np.int64)]
        cell, at = np.unique(owner * len(sources) + source, return_inverse=True)
        ns = np.zeros(len(cell), np.int64)
        np.add.at(ns, at, np.asarray(column["ns"].flatten()))
        per_group = np.bincount(cell // len(sources), minlength=len(begin))

        owner = group[np.asarray(pc.list_parent_indices(column["ids"])).astype(np.int64)]
        rare = (docs > 0) & (docs < least)
        ids = np.asarray(column["ids"].flatten())[rare[owner]]

        counts = []
        for one in chunks:  # each distinct chunk once
            have = dict.fromkeys(found := _TERM.findall(one.as_py().encode().lower()), 0)
            for term in found:
                have[term] += 1
            counts.append(have)
        lengths = np.array([len(c) for c in counts], np.int64)
        terms = _lists(pa.array([t for c in counts for t in c], pa.binary()).cast(pa.string()), lengths)
        times = _lists(pa.array([n for c in counts for n in c.values()], pa.int64()), lengths)
        of = pa.array(chunk[begin], mask=np.asarray(column["chunk"].is_null())[begin])
        return pa.RecordBatch.from_pydict({
            "lang": column["lang"].take(pa.array(begin)), "docs": pa.array(docs),
            "sources": _lists(sources.take(pa.array(cell % len(sources))), per_group), "ns": _lists(pa.array(ns), per_group),
            "ids": _lists(pa.array(ids), np.bincount(owner[rare[owner]], minlength=len(begin)), ~rare),
            "terms": terms.take(of), "times": times.take(of)})

    return parts.repartition("chunk").sortWithinPartitions("chunk", "lang").mapInArrow(run, _CHUNKS)


def _zero() -> Column:
    return F.lit(0).cast("long")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)), exact; null without terms."""
    above = (n + SMOOTH).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = total + SMOOTH * terms
    return F.when(terms > 0, F.lit(1) + F.call_function("div", above, F.greatest(below, F.lit(1)).cast("decimal(20,0)")))


def kept_counts(docs: DataFrame, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n) of the kept terms that a group holds, and (lang, source) of all groups."""
    docs = C.query_columns(docs, text="string", lang="string", source="string").fillna("").withColumn(
        "row", F.monotonically_increasing_id())  # read once: the counts are written before anything uses them
    chunks = C.stage(_split_chunks(_chunk_counts(docs, least), least), "chunks")
    groups = chunks.where("terms is null").select("lang", F.explode("sources").alias("source")).distinct()
    each = F.explode(F.arrays_zip("terms", "times")).alias("each")
    flat = chunks.where("size(terms) > 0").select("lang", "docs", "sources", "ns", "ids", each).select(
        "lang", "docs", "sources", "ns", "ids", F.col("each.terms").alias("term"), F.col("each.times").alias("times"))

    bounds = C.stage(flat.groupBy("lang", "term").agg(F.max("docs").alias("low"), F.sum("docs").alias("high")).where(
        F.col("high") >= least), "term-bounds")
    between = bounds.where(F.col("low") < least).select("lang", "term")
    found = flat.where("ids is not null").select("lang", "term", "ids").join(between, ["lang", "term"]).select(
        "lang", "term", F.explode("ids").alias("row")).distinct()
    counted = found.groupBy("lang", "term").count().where(F.col("count") >= least)
    kept = C.stage(bounds.where(F.col("low") >= least).select("lang", "term").union(counted.select("lang", "term")), "kept-terms")

    cell = F.explode(F.arrays_zip("sources", "ns")).alias("cell")
    held = flat.select("lang", "term", "times", "sources", "ns").join(kept, ["lang", "term"]).select("lang", "term", "times", cell)
    return C.stage(held.groupBy("lang", F.col("cell.sources").alias("source"), "term").agg(
        F.sum(F.col("cell.ns") * F.col("times")).alias("n")), "kept-counts"), groups


def divergence(docs: DataFrame, *, least: int = 30, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank of the differences between sources.

    ``pair``: summed differences of a source's term shares and those of each other source of the language.
    ``term``: the ``top`` terms that a source holds more of than its language does.
    """
    held, groups = kept_counts(docs, least)
    sizes = held.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(
        F.sum("n").alias("lang_total"), F.count("*").alias("terms"))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = C.stage(groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").select(
        "lang", "source", F.coalesce("total", _zero()).alias("total"), F.coalesce("lang_total", _zero()).alias("lang_total"),
        F.coalesce("terms", _zero()).alias("terms")), "group-totals")

    shares = held.join(groups, ["lang", "source"]).withColumn(
        "p", _share(F.col("n"), F.col("total"), F.col("terms")))
    pairs = _pair_sums(shares, groups)
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))

    whole = held.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    above = shares.join(whole, ["lang", "term"]).select(
        "lang", "source", F.col("term").alias("item"),
        (F.col("p") - _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))).alias("value")).where("value > 0")
    tops = above.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").union(columns(tops, "term"))


def _pair_sums(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: the differences of all ordered pairs of one language's sources."""
    buckets = F.greatest(F.lit(1).cast("long"), F.expr(f"(terms + {BUCKET - 1}) div {BUCKET}"))
    bucket = lambda c: F.pmod(F.xxhash64(c), buckets).cast("int")
    # every bucket knows all sources of its language, with the share of a term that a source lacks
    bases = groups.select("lang", "source", F.coalesce(_share(_zero(), F.col("total"), F.col("terms")), _zero()).alias("base"),
                          F.explode(F.sequence(F.lit(0), (buckets - 1).cast("int"))).alias("bucket"))
    cells = shares.select("lang", "source", "term", "p", bucket("term").alias("bucket"))

    def matrix(cells: pa.Table, bases: pa.Table) -> pa.Table:
        order = bases.sort_by("source")
        names, base = order["source"].to_pylist(), np.asarray(order["base"]).astype(np.int64)
        if cells.num_rows:
            place = {name: i for i, name in enumerate(names)}
            terms = cells["term"].combine_chunks().dictionary_encode()
            terms = np.asarray(terms.indices if isinstance(terms, pa.DictionaryArray) else terms.combine_chunks().indices)
            p = np.repeat(base[None, :], int(terms.max()) + 1, axis=0)
            p[terms, [place[s] for s in cells["source"].to_pylist()]] = np.asarray(cells["p"]).astype(np.int64)
        else:
            p = np.zeros((0, len(names)), np.int64)
        lang = order["lang"][0].as_py()
        sources, items, values = [], [], []
        for i, name in enumerate(names):
            apart = np.abs(p - p[:, i:i + 1]).sum(axis=0)
            for j, other in enumerate(names):
                if i != j:
                    sources.append(name)
                    items.append(other)
                    values.append(int(apart[j]))
        return pa.table({"lang": pa.array([lang] * len(sources), pa.string()), "source": pa.array(sources, pa.string()),
                         "item": pa.array(items, pa.string()), "value": pa.array(values, pa.int64())})

    parts = cells.groupBy("lang", "bucket").cogroup(bases.groupBy("lang", "bucket")).applyInArrow(
        matrix, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


ORACLE = r"""
WITH docs AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), found AS (
    SELECT id, lang, source, unnest(terms) AS term FROM docs
), kept AS (
    SELECT lang, term, count(*) AS n FROM found GROUP BY lang, term HAVING count(DISTINCT id) >= 30
), langs AS (
    SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY lang
), groups AS (
    SELECT DISTINCT lang, source FROM docs
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY lang, source, term
), totals AS (
    SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY g.lang, g.source
), shares AS (
    SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
        1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (t.total + 5 * l.v) AS p,
        1 + (1000000000 * (k.n + 5)::HUGEINT) // (l.total + 5 * l.v) AS q
    FROM totals t JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c USING (lang, source, term)
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, CAST(coalesce(d.value, 0) AS BIGINT) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
        FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) d
        ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
), tops AS (
    SELECT lang, source, term AS item, CAST(p - q AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
    SELECT lang, source, 'pair' AS part, item, value,
        row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
    UNION ALL
    SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM tops
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
