"""Document fingerprints by I-Match with randomised lexicon subsets.

The lexicon holds the terms whose share of documents lies in a band, that is, whose inverse document
frequency lies between two bounds. Document frequencies are counted over all documents; the lexicon is
collected, and its size has a bound that doesn't depend on the number of documents: terms per document
divided by the lower share. A document keeps its lexicon terms (all its terms, if fewer than ``few`` lie in
the band); its distinct sorted terms are hashed once per random subset of the lexicon. Subsets come in rates
1, 1/2, 1/4 and so on; a document of m terms uses the two rates around 1/m, so that a subset holds about one
of its terms whatever its length. The likeness of two fingerprints is the share of equal subset hashes among
those that are not empty on both sides, at the rates that they have in common.

Defined results: a null text is empty; a text without terms has a fingerprint of its bytes alone; equal
texts have equal fingerprints, and equal fingerprints have likeness 1. In :func:`edited_likeness` a null doc_id
comes first, rows that repeat a doc_id follow each other in a fixed order, and a single row is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.llm import common as C

SUBSETS = 40
WIDTH = 3  # bytes of a subset's hash
_SEEDS = np.random.default_rng(5).integers(1, 2**63, SUBSETS, dtype=np.uint64)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term hashes of each row, sorted, and their rows."""
    kind = np.zeros(256, np.uint8)
    kind[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1
    data = C.lower_ascii(data)
    starts, ends = C.runs(kind[data], offsets)
    value, rows = C.hashes(data, starts, ends), C.rows_of(starts, offsets)
    order = np.lexsort((value, rows))
    value, rows = value[order], rows[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
    return value[new], rows[new]


def lexicon(docs: DataFrame, low: float, high: float) -> np.ndarray:
    """Sorted hashes of the terms that at least ``low`` (and two) and at most ``high`` of the documents hold."""
    def count(batches):
        held, waiting = [], 0
        def merged():
            value = np.concatenate([v for v, _ in held])
            value, at = np.unique(value, return_inverse=True)
            return value, np.bincount(at, np.concatenate([n for _, n in held]), len(value)).astype(np.int64)
        for batch in batches:
            for _, data, offsets in C.text_chunks(batch["text"]):
                value, n = np.unique(terms(data, offsets)[0], return_counts=True)
                held.append((value, n))
                waiting += len(value)
                if waiting > 1 << 21 and len(held) > 1:
                    held = [merged()]
                    waiting = 0
        if held:
            value, n = merged()
            yield pa.RecordBatch.from_pydict({"term": pa.array(value.view(np.int64)), "df": pa.array(n)})

    n = docs.count()
    found = docs.select("text").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    found = found.where(F.col("df").between(max(2, low * n), max(2, high * n))).select("term").toArrow()
    return np.sort(np.array(found["term"], np.int64).view(np.uint64))


def fingerprints(texts: pa.Array, lexicon: np.ndarray, few: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Rate exponent of each text, and its subset hashes (texts x 2 x SUBSETS; 0 is an empty subset)."""
    level, out = np.zeros(len(texts), np.int64), np.zeros((len(texts), 2, SUBSETS), np.uint32)
    for first, data, offsets in C.text_chunks(texts):
        n = len(offsets) - 1
        value, rows = terms(data, offsets)
        if len(lexicon) and len(value):
            place = np.minimum(np.searchsorted(lexicon, value), len(lexicon) - 1)
            inside = lexicon[place] == value
        else:
            inside = np.zeros(len(value), bool)
        enough = np.bincount(rows[inside], minlength=n) >= few
        used = inside | ~enough[rows]
        value, rows = value[used], rows[used]
        size = np.bincount(rows, minlength=n)
        ends = np.cumsum(size)
        level[first:first + n] = rate = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
        limit = (np.uint64(2**64 - 1) >> rate.astype(np.uint64))[rows]
        for k in range(SUBSETS):
            drawn = C.mix(value ^ _SEEDS[k])
            tag = C.mix(drawn)
            for side in (0, 1):
                member = drawn <= (limit >> np.uint64(side))
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(member, tag, np.uint64(0)))])
                own = total[ends] - total[ends - size]
                count = np.concatenate([[0], np.cumsum(member)])
                filled = count[ends] > count[ends - size]
                out[first:first + n, side, k] = np.where(filled, 1 + (own % np.uint64(2**(8 * WIDTH) - 1)), 0)
        for row in np.flatnonzero(size == 0):
            digest = hashlib.sha256(data[offsets[row]:offsets[row + 1]].tobytes()).digest()
            out[first + row] = 1 + int.from_bytes(digest[:8], "big") % (2**(8 * WIDTH) - 1)
    return level, out


def as_text(level: np.ndarray, hashes: np.ndarray) -> list[str]:
    raw = hashes.astype(">u4").view(np.uint8).reshape(len(level), -1, 4)[:, :, 4 - WIDTH:]
    return [f"{n:02x}{row.tobytes().hex()}" for n, row in zip(level.tolist(), np.ascontiguousarray(raw))]


def likeness(level_a, a, level_b, b) -> np.ndarray:
    """Share of equal subset hashes, row by row."""
    equal, filled = np.zeros(len(a)), np.zeros(len(a))
    for side_a in (0, 1):
        for side_b in (0, 1):
            common = (level_a + side_a) == (level_b + side_b)
            x, y = a[:, side_a], b[:, side_b]
            equal += common * ((x == y) & (x > 0)).sum(axis=1)
            filled += common * ((x > 0) | (y > 0)).sum(axis=1)
    same = (level_a == level_b) & (a == b).all(axis=(1, 2))
    return np.where(same, 1.0, equal / np.maximum(filled, 1))


def neighbours(docs: DataFrame) -> DataFrame:
    """bucket, tail, doc_id and packed text: ordered, each bucket of doc_ids ends with the row that follows it (tail = 1)."""
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    edges = sorted(set(docs.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n)))
    edges = [int(e) for e in edges]
    splits = F.array(*[F.lit(e).cast("long") for e in edges]) if edges else F.expr("array()")
    # number of edges that are not above the id; a null id is in the first bucket
    bucket = F.coalesce(F.array_size(F.filter(splits, lambda e: e <= F.col("doc_id"))), F.lit(0))
    firsts = docs.select(bucket.alias("bucket"), "doc_id").groupBy("bucket").agg(
        F.min("doc_id").alias("low"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).orderBy("bucket").collect()

    def pack(batches):
        own = [r["bucket"] for r in firsts]
        before = {r["bucket"]: own[i - 1] for i, r in enumerate(firsts)}
        first = {r["bucket"]: None if r["nulls"] else r["low"] for r in firsts}
        limits = np.array(edges, np.int64)
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            place = [0 if i is None else int(np.searchsorted(limits, i, "right")) for i in ids]
            packed = [packer.compress(t.encode()) for t in batch["text"].fill_null("").to_pylist()]
            rows = [(b, 0, i, p) for b, i, p in zip(place, ids, packed)]
            rows += [(before[b], 1, i, p) for b, i, p in zip(place, ids, packed) if i == first[b]]
            yield pa.RecordBatch.from_pydict({name: pa.array(column, kind) for name, kind, column in zip(
                ("bucket", "tail", "doc_id", "packed"), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), zip(*rows))})

    return docs.mapInArrow(pack, "bucket int, tail int, doc_id long, packed binary").repartition(n, "bucket").sortWithinPartitions(
        "bucket", "tail", "doc_id", "packed")


def edited_likeness(docs: DataFrame, *, low: float = 0.0005, high: float = 0.1) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text ends, in place of its last quarter of code points, with the first as many of the next
    document by doc_id (after the last comes the first).
    """
    docs = C.query_columns(docs, doc_id="long", text="string")
    words = docs.sparkSession.sparkContext.broadcast(lexicon(docs, low, high))

    def pieces(batches) -> Iterator[tuple[list, list, list]]:
        """About a million bytes of rows at a time; the last row of a piece comes again as the first of the next."""
        unpacker, held, size = zstandard.ZstdDecompressor(), [], 0
        for batch in batches:
            for row in zip(*[batch[c].to_pylist() for c in ("bucket", "tail", "doc_id", "packed")]):
                text = unpacker.decompress(row[3]).decode()
                held.append((*row[:3], text))
                size += len(text)
                if size > 1 << 20 and len(held) > 1:
                    yield held
                    held, size = held[-1:], len(text)
        if len(held) > 1:
            yield held

    def compare(batches):
        for rows in pieces(batches):
            at = [i for i in range(len(rows) - 1) if rows[i][1] == 0 and rows[i][0] == rows[i + 1][0]]
            if not at:
                continue
            texts = [r[3] for r in rows]
            n = [len(texts[i]) for i in at]
            edited = [texts[i][:k - k // 4] + texts[i + 1][:k // 4] for i, k in zip(at, n)]
            level, hashes = fingerprints(pa.array(texts), words.value)
            level_e, hashes_e = fingerprints(pa.array(edited), words.value)
            here = np.array(at)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([rows[i][2] for i in at], pa.int64()), "n_chars": pa.array(n, pa.int64()),
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                "fingerprint": as_text(level[here], hashes[here]), "edited_fingerprint": as_text(level_e, hashes_e),
                "near_edited": likeness(level[here], hashes[here], level_e, hashes_e),
                "near_next": likeness(level[here], hashes[here], level[here + 1], hashes[here + 1])})

    return neighbours(docs).mapInArrow(
        compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")
