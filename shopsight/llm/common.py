"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopsight.session import scratch_dir


def release_memory() -> None:
    """Hand free memory back at the end of a task: its worker lives on beside those of the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(key: Column, folds: int) -> Column:
    """Fold number of a row: crc32 of its key as text (a null key counts as empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the shared checkpoint folder and read it back: it survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- words of Arrow text columns, as numpy arrays ---------------------------------------------

_BYTE_KEYS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, (n + 1).bit_length())
    if size not in _powers:
        _powers.clear()
        one = np.ones(1, np.uint64)
        _powers[size] = tuple(np.concatenate([one, np.cumprod(np.full(size, b, np.uint64))])
                              for b in (_BASE, _BASE_INVERSE))
    return _powers[size]


def text_chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a text column of about ``limit`` bytes: first row, bytes, row offsets. Null is empty.

    A text longer than the limit makes a slice of its own; no text is ever cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offset_buffer, data_buffer = column.buffers()
    if len(column) == 0:
        return
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data - np.uint8(65)) < np.uint8(26)).view(np.uint8) << np.uint8(5))


def runs(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal non-zero kind; a run never crosses a row."""
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.empty(len(kind) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
    change[offsets] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    keep = kind[starts] != 0
    return starts[keep], ends[keep]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, separated by space and the controls 9 to 13."""
    return runs(((data != 32) & ((data - np.uint8(9)) >= np.uint8(5))).view(np.uint8), offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, by prefix sums of a keyed polynomial."""
    power, inverse = _powers_to(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_KEYS[data] * power[:len(data)])])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row of each span, and so with empty rows skipped."""
    return np.searchsorted(offsets, starts, "right") - 1


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A list column from flat values and the length of each list."""
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(values))


# --- sums of long vectors over all partitions -------------------------------------------------


def sum_vectors(parts: DataFrame, length: int, blocks: int = 64) -> np.ndarray:
    """Sum rows (block int, sums binary of int64) of all tasks; the result has ``blocks * length`` numbers.

    Blocks are added up as they stream through their task, so memory doesn't grow with the tasks;
    what reaches the driver is of fixed size.
    """
    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch["block"].to_pylist(), batch["sums"]):
                part = np.frombuffer(sums.as_buffer(), np.int64)
                total[block] = total[block] + part if block in total else part.copy()
        if total:
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array(list(total), pa.int32()), "sums": pa.array([v.tobytes() for v in total.values()])})

    out = np.zeros((blocks, length), np.int64)
    for row in parts.repartition(blocks, "block").mapInArrow(add, "block int, sums binary").collect():
        out[row["block"]] += np.frombuffer(row["sums"], np.int64)
    return out.reshape(-1)


def vector_rows(total: np.ndarray, blocks: int = 64) -> pa.RecordBatch:
    """The rows that :func:`sum_vectors` takes from one task."""
    return pa.RecordBatch.from_pydict({
        "block": pa.array(range(blocks), pa.int32()),
        "sums": pa.array([x.tobytes() for x in total.astype(np.int64).reshape(blocks, -1)])})


def query_columns(df: DataFrame, **kinds: str) -> DataFrame:
    """Pick columns by name and cast them; clashing extra columns fall away."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in kinds.items()])
