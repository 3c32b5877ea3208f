"""Token ids of documents in files of range-coded blocks.

Documents are range-partitioned and ordered by doc_id (nulls first; rows that repeat a doc_id by text), so
each task writes one file of consecutive documents. A file is a sequence of blocks. A block holds whole
documents: a header, the doc_ids and lengths (deflated), and the ids coded by :mod:`id_coder`; it starts
from an empty model and carries checksums, so any block can be read alone. Files get fresh names and only
those that a finished task reports are read, so a task that runs twice leaves a file that nobody reads.

Texts are split before the tokenizer sees them (at ASCII white space, which it drops and joins nothing across;
Latin-1 texts also between letters, digits and signs, as its own rule does), and words met before come from a
bounded cache of the process; when it is full, those that came once only go.

Defined results: null texts are empty; every document ends with ``end_id``, so an empty one has that id
alone; an empty table writes no file and reads back no row.
"""

from __future__ import annotations

import codecs
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.llm import common as C
from shopsight.llm import files, id_coder

VOCABULARY = 49_408
_BLOCK = "<4sIII"  # magic, documents, bytes of the deflated table, bytes of coded ids
MAGIC = b"TOK1"
_WORDS = 400_000  # words that a process keeps
_LATIN = re.compile("[\\x00-\\xff]*").fullmatch
_LETTERS, _DIGITS, _BLANKS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"  # lower-cased Latin-1
_PIECES = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_DIGITS}]|[^{_BLANKS}{_LETTERS}{_DIGITS}]+").findall


def _signs(byte_level) -> Iterator[tuple[int, str]]:
    """Each byte of Latin-1 texts in UTF-8 and the sign that stands for it before the merges."""
    yield 32, " "
    for i in range(256):
        if i != 32:
            yield from zip(chr(i).encode(), byte_level.pre_tokenize_str(chr(i))[0][0])


class _Places(dict):
    """Places of words; a word without one gets the next and is noted as new."""

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        self.new.append(word)
        return place


class Encoder:
    """The tokenizers library with a bounded cache of words.

    Latin-1 texts are cut where the vocabulary's own pre-tokenizer cuts them, so that the library sees each
    piece once, lower-cased, in one call for all new pieces. Other texts are cut at white space only; their words
    are kept behind a space, which no piece holds.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        model = Tokenizer.from_file(path).model
        model._resize_cache(0)  # it meets every piece once
        self.pieces = Tokenizer(model)
        self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        # the library's signs of all bytes; the blank stays, as it parts the pieces
        signs = dict(_signs(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)))
        self.signs = "".join(signs.get(i, "\ufffe") for i in range(256))
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.places = _Places()
        self.pool, self.starts, self.lengths = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.again = np.zeros(1 << 12, bool)  # met in a later batch than their first
        self.used = 0

    def _thin(self) -> None:
        """Forget the words that were not met again; all of them where that leaves more than half."""
        kept = np.flatnonzero(self.again[:len(self.places)])
        if 2 * len(kept) > _WORDS:
            return self.forget()
        words, starts, lengths = list(self.places), self.starts[kept], self.lengths[kept]
        self.places = _Places({words[k]: place for place, k in enumerate(kept.tolist())})
        begin = np.cumsum(lengths) - lengths
        self.used = int(lengths.sum())
        self.pool[:self.used] = self.pool[np.arange(self.used) + np.repeat(starts - begin, lengths)]
        self.starts[:len(kept)], self.lengths[:len(kept)] = begin, lengths
        self.again[:] = False

    def _ids(self, words: list[str], whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and the number of ids of each."""
        if whole:
            signs = codecs.charmap_decode(" ".join(words).encode(), "strict", self.signs)[0]
            ids = np.array(self.pieces.encode_batch_fast([signs], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.last[ids])
            if len(ends) == len(words):  # every piece ends with the one token that ends it
                return ids, np.diff(ends, prepend=-1)
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.int32, int(lengths.sum())), lengths

    def _learn(self, words: list[str]) -> None:
        """Keep the ids of the new words, in the order of their places."""
        whole = np.array([word[0] != " " for word in words], bool)
        pieces, others = [w for w in words if w[0] != " "], [w[1:] for w in words if w[0] == " "]
        for some, kind in ((pieces, True), (others, False)):
            if not some:
                continue
            found, sizes = self._ids(some, kind)
            while self.used + len(found) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used:self.used + len(found)] = found
            starts = self.used + np.cumsum(sizes) - sizes
            self.used += len(found)
            self._keep(len(self.places) - len(words) + np.flatnonzero(whole == kind), starts, sizes)

    def _keep(self, places: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        while len(self.places) > len(self.starts):
            self.starts, self.lengths, self.again = (
                np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.again))
        self.starts[places], self.lengths[places] = starts, lengths

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and the number of ids of each."""
        if len(self.places) > _WORDS:
            self._thin()
        split = [_PIECES(text.lower()) if _LATIN(text) and "<|" not in text else
                 [" " + word for word in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")]
                 for text in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        self.places.new, known = [], len(self.places)
        places = np.fromiter(map(self.places.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        self._learn(self.places.new)
        self.again[places] = True
        self.again[known:len(self.places)] = False
        lengths, starts = self.lengths[places], self.starts[places]
        ends = np.cumsum(lengths)
        within = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)
        flat = self.pool[np.repeat(starts, lengths) + within]
        totals = np.concatenate([[0], ends])
        at = totals[np.cumsum(counts)]
        return np.insert(flat, at, end_id).astype(np.int64), np.diff(at, prepend=0) + 1


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """The encoder of this process: tasks that follow each other share its words."""
    return Encoder(path)


def _block(doc_ids: list, ids: np.ndarray, lengths: np.ndarray) -> bytes:
    table = zlib.compress(np.array([[0 if d is None else d for d in doc_ids], [d is None for d in doc_ids], lengths],
                                   "<i8").tobytes())
    coded = id_coder.encode_block(ids, VOCABULARY)
    return struct.pack(_BLOCK, MAGIC, len(doc_ids), len(table), len(coded)) + table + coded


def write_ids(docs: DataFrame, tokenizer_path: str, *, end_id: int = 1, block_ids: int = 1 << 20) -> DataFrame:
    """Write all documents; gives one row per block: path, offset, length, start (ids before it) and order."""
    docs = C.query_columns(docs, doc_id="long", text="string")
    folder = files.new_folder(docs.sparkSession, "token-ids")

    def write(batches):
        from pyspark import TaskContext

        encoder, rows = _encoder(tokenizer_path), []
        uri = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tok"

        def blocks():
            held, waiting = [], 0
            offset = 0
            def close():
                nonlocal held, waiting, offset
                ids, lengths = (np.concatenate([x[k] for x in held]) for k in (1, 2))
                block = _block([d for x in held for d in x[0]], ids, lengths)
                rows.append((uri, offset, len(block), len(ids), len(lengths)))
                held, waiting, offset = [], 0, offset + len(block)
                return block
            for batch in batches:
                texts, names = batch["text"].fill_null(""), batch["doc_id"].to_pylist()
                for first in range(0, len(texts), 50):  # only these texts are Python strings at a time
                    ids, lengths = encoder.encode(texts.slice(first, 50).to_pylist(), end_id)
                    held.append((names[first:first + 50], ids, lengths))
                    waiting += len(ids)
                    if waiting >= block_ids:
                        yield close()
            if held:
                yield close()

        chunks = blocks()
        head = next(chunks, None)
        if head is None:
            return
        def all_chunks():
            yield head
            yield from chunks
        files.write(uri, all_chunks())
        C.release_memory()
        yield pa.RecordBatch.from_pydict(dict(zip(("path", "offset", "length", "n_ids", "n_docs"), map(list, zip(*rows)))))

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    written = C.stage(ordered.mapInArrow(write, "path string, offset long, length long, n_ids long, n_docs long"), "token-blocks")
    # names begin with the partition's number, so paths and offsets order the blocks; one row per block
    rows = written.select("path", "offset", "length", "n_ids").orderBy("path", "offset").collect()
    starts = np.r_[0, np.cumsum([r["n_ids"] for r in rows])].tolist()
    return docs.sparkSession.createDataFrame(
        [(r["path"], r["offset"], r["length"], start) for r, start in zip(rows, starts)],
        "path string, offset long, length long, start long")


def read_ids(blocks: DataFrame, *, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (unless left out) ids of every document, from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = files.place(row["path"])
                with fs.open_input_file(path) as source:
                    data = source.read_at(row["length"], row["offset"])
                magic, n_docs, n_table, n_coded = struct.unpack_from(_BLOCK, data)
                head = struct.calcsize(_BLOCK)
                if magic != MAGIC or len(data) != head + n_table + n_coded:
                    raise ValueError(f"{row['path']} has no whole block at {row['offset']}")
                names, missing, lengths = np.frombuffer(
                    zlib.decompress(data[head:head + n_table]), "<i8").reshape(3, n_docs)
                ids = id_coder.decode_block(data[head + n_table:])
                ends = np.cumsum(lengths)
                raw, sums = ids.astype("<u4"), []
                view = memoryview(raw).cast("B") if len(raw) else memoryview(b"")
                for begin, end in zip((ends - lengths).tolist(), ends.tolist()):
                    sums.append(zlib.crc32(view[4 * begin:4 * end]))
                out = {"doc_id": pa.array(names, pa.int64(), mask=missing.astype(bool)),
                       "start": pa.array(row["start"] + ends - lengths), "n_tokens": pa.array(lengths.astype(np.int64)),
                       "ids_crc32": pa.array(sums, pa.int64())}
                if with_ids:
                    out["ids"] = C.lists(ids.astype(np.int32), lengths)
                yield pa.RecordBatch.from_pydict(out)

    tasks = max(1, blocks.count())
    return blocks.repartition(tasks, "path", "offset").mapInArrow(read, schema)
