"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every token has a sparse random index vector; a token's word vector is the sum of the index vectors of
its neighbours over all documents. Tokens are runs of word characters or of symbols, with their case;
a word that repeats one of the two tokens before it counts as the token REPEAT. Word vectors live in a
table of fixed width (hash buckets), so the sums of all tasks have a fixed size however large the corpus.
A document is the mean of its word vectors with its spread and length. The network is trained on a bounded
sample of labelled rows, and its probabilities are calibrated by a temperature on rows kept apart.

Defined results: null and empty texts are scored like any other (their pooled vector is zero); rows with
a null doc_id are scored too; without labels, or with labels of one class only, every score is the share
of label 1 with one added to either class. Repeated labels of a document count as often as they occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.llm import common as C

BUCKETS, WIDTH, NONZERO, REACH = 1 << 14, 32, 4, 2
FEATURES = WIDTH + 3


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each bucket's index vector."""
    random = np.random.default_rng(7)
    places = random.permuted(np.tile(np.arange(WIDTH), (BUCKETS, 1)), axis=1)[:, :NONZERO]
    return places, random.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each token. Bucket 0 stands for REPEAT."""
    kind = np.full(256, 2, np.uint8)
    kind[C.SPACES] = 0
    kind[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    kinds = kind[data]
    starts, ends = C.runs(kinds, offsets)
    rows = C.rows_of(starts, offsets)
    hashed = C.hashes(data, starts, ends)
    bucket = 1 + (hashed % np.uint64(BUCKETS - 1)).astype(np.int64)
    word = kinds[starts] == 1 if len(starts) else np.zeros(0, bool)
    repeat = np.zeros(len(starts), bool)
    for back in (1, 2):
        repeat[back:] |= (hashed[back:] == hashed[:-back]) & (rows[back:] == rows[:-back])
    bucket[repeat & word] = 0
    return bucket, rows


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Word vectors of all buckets from all documents; the sums are whole numbers, so reruns agree."""
    def count(batches):
        places, signs = index_vectors()
        total = np.zeros(BUCKETS * WIDTH)
        for batch in batches:
            for _, data, offsets in C.text_chunks(batch["text"]):
                bucket, rows = tokens(data, offsets)
                for reach in range(1, REACH + 1):
                    near = np.flatnonzero(rows[reach:] == rows[:-reach]) if len(rows) > reach else []
                    if not len(near):
                        continue
                    for at, other in ((bucket[near], bucket[near + reach]), (bucket[near + reach], bucket[near])):
                        for j in range(NONZERO):
                            total += np.bincount(at * WIDTH + places[other, j], signs[other, j], BUCKETS * WIDTH)
        yield C.vector_rows(total)

    sums = C.sum_vectors(docs.select("text").mapInArrow(count, "block int, sums binary"), BUCKETS * WIDTH // 64)
    vectors = sums.reshape(BUCKETS, WIDTH).astype(np.float64)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = vectors / np.maximum(norms, 1)
    seen = norms[:, 0] > 0
    if seen.any():
        vectors[seen] -= vectors[seen].mean(axis=0)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id and the pooled features of each document."""
    table = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches):
        vectors = table.value
        for batch in batches:
            out = np.zeros((batch.num_rows, FEATURES), np.float32)
            for first, data, offsets in C.text_chunks(batch["text"]):
                bucket, rows = tokens(data, offsets)
                if not len(bucket):
                    continue
                begin = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                n = np.diff(np.r_[begin, len(rows)])
                mean = np.add.reduceat(vectors[bucket], begin, axis=0) / n[:, None]
                at = first + rows[begin]
                out[at, :WIDTH] = mean
                out[at, WIDTH] = np.linalg.norm(mean, axis=1)
                out[at, WIDTH + 1] = np.add.reduceat((bucket == 0).astype(np.float32), begin) / n
                out[at, WIDTH + 2] = np.log1p(n) / 10
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"],
                "features": C.lists(out.reshape(-1), np.full(batch.num_rows, FEATURES))})

    return C.query_columns(docs, doc_id="long", text="string").mapInArrow(pool, "doc_id long, features array<float>")


class Network:
    """Inputs, one hidden layer of tanh units, one logistic output, a temperature."""

    def __init__(self, hidden: int = 24, epochs: int = 60, batch: int = 256, rate: float = 0.01, seed: int = 1):
        self.hidden, self.epochs, self.batch, self.rate, self.seed = hidden, epochs, batch, rate, seed
        self.constant: float | None = None
        self.temperature = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        self.constant = float((y.sum() + 1) / (len(y) + 2))
        if len(np.unique(y)) < 2:
            return self
        self.constant = None
        random = np.random.default_rng(self.seed)
        apart = random.random(len(y)) < 0.2
        if len(np.unique(y[~apart])) < 2 or len(np.unique(y[apart])) < 2:
            apart[:] = False
        self.mean, self.spread = x[~apart].mean(axis=0), x[~apart].std(axis=0) + 1e-3
        z, target = (x[~apart] - self.mean) / self.spread, y[~apart].astype(np.float64)
        width = z.shape[1]
        self.weights = [random.normal(0, width ** -0.5, (width, self.hidden)), np.zeros(self.hidden),
                        random.normal(0, self.hidden ** -0.5, self.hidden), np.zeros(1)]
        first, second = ([np.zeros_like(w) for w in self.weights] for _ in range(2))
        step = 0
        for epoch in range(self.epochs):
            rate = self.rate * 0.5 * (1 + np.cos(np.pi * epoch / self.epochs))
            order = random.permutation(len(z))
            for begin in range(0, len(z), self.batch):
                at = order[begin:begin + self.batch]
                a, b, c, d = self.weights
                active = np.tanh(z[at] @ a + b)
                error = (1 / (1 + np.exp(-(active @ c + d))) - target[at]) / len(at)
                back = np.outer(error, c) * (1 - active ** 2)
                step += 1
                for k, grad in enumerate((z[at].T @ back + 1e-4 * a, back.sum(axis=0), active.T @ error + 1e-4 * c,
                                          np.array([error.sum()]))):
                    first[k] = 0.9 * first[k] + 0.1 * grad
                    second[k] = 0.999 * second[k] + 0.001 * grad ** 2
                    self.weights[k] = self.weights[k] - rate * (first[k] / (1 - 0.9 ** step)) / (
                        np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
        if apart.any():
            logits, truth = self.logits(x[apart]), y[apart]
            scales = np.exp(np.linspace(-1.5, 2.5, 81))
            losses = [np.mean(np.logaddexp(0, np.where(truth == 1, -1, 1) * logits / s)) for s in scales]
            self.temperature = float(scales[int(np.argmin(losses))])
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(((x - self.mean) / self.spread) @ a + b) @ c + d

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def quality_scores(docs: DataFrame, labels: DataFrame, *, folds: int = 5, held_out_fold: int = 0,
                   threshold: float = 0.3, sample: int = 20_000) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    ``labels`` has doc_id and quality (0 or 1; null is no label). Labels of the held-out fold are never read.
    ``sample`` bounds the labelled rows that the network is fitted on, taken in an order by hash.
    """
    docs = C.query_columns(docs, doc_id="long", text="string")
    features = C.stage(pooled(docs, word_vectors(docs)), "quality-features")
    marks = C.query_columns(labels, doc_id="long", quality="int").where(
        F.col("quality").isNotNull() & (C.fold(F.col("doc_id"), folds) != held_out_fold))
    rows = (features.join(marks, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "features")
            .limit(sample).select("features", "quality").toArrow())
    x = np.array(rows["features"].combine_chunks().flatten() if rows.num_rows else [], np.float64)
    network = Network().fit(x.reshape(-1, FEATURES), np.array(rows["quality"], np.int64))

    def score(batches):
        for batch in batches:
            x = np.asarray(batch["features"].flatten(), np.float64).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "score": network.probabilities(x)})

    return features.mapInArrow(score, "doc_id long, score double").select(
        "doc_id", (C.fold(F.col("doc_id"), folds) == held_out_fold).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The documents that the classifier accepts, with all their columns; copies of a row share its fate."""
    kept = quality_scores(docs, labels, **settings).where("predicted = 1").select(
        F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__kept")), "left_semi")
