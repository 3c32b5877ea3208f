"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word beginnings is trained in numpy from confirmed toxic texts
(positives) and unlabelled text. With p the class prior, its risk is

    p * mean loss of positives as positive + max(0, mean loss of unlabelled as negative
                                                    - p * mean loss of positives as negative)

with logistic loss; where the second term falls below zero, the step is taken against it. The prior is the
share of toxic rows among the labelled rows of the training folds. A word or beginning is one feature of a
text, and another for each number of occurrences in REPEATS that it reaches: several forms of one stem tell more
than one. No feature is thrown away for being rare: each has an L1 penalty that falls with the evidence that
positives hold it more often than unlabelled texts (to ``shrink`` at ``deviations`` deviations); features without
such evidence have no weight.
The classifier is fitted on bounded samples (parameters), drawn in an order by
hash; every document is scored as a whole.

Defined results: null and empty texts have no features and get the score of the constant term; without toxic
rows to learn from every score is 0; rows that repeat a doc_id are scored by their own texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.llm import common as C

BITS = 22
BEGINNINGS = (4, 5, 6, 7, 8)  # bytes of a word's beginning
REPEATS = (2, 3, 4)  # occurrences in a text that are features of their own


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of all texts, ordered by row, and how many each row has."""
    word_byte = np.zeros(256, np.uint8)
    word_byte[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1
    found, counts = [], np.zeros(len(column), np.int64)
    for first, data, offsets in C.text_chunks(column):
        data = C.lower_ascii(data)
        starts, ends = C.runs(word_byte[data], offsets)
        longer = [starts[ends - starts > n] for n in BEGINNINGS]
        places = np.concatenate([starts, *longer])
        number = C.hashes(data, places, np.concatenate([ends, *[at + n for at, n in zip(longer, BEGINNINGS)]]))
        number[len(starts):] ^= np.uint64(0x5851F42D4C957F2D)
        number = (number >> np.uint64(64 - BITS)).astype(np.int64)
        rows = C.rows_of(places, offsets)
        once, times = np.unique(rows << BITS | number, return_counts=True)
        both = [once]
        for k in REPEATS:
            more = once[times >= k]
            number = C.mix((more & ((1 << BITS) - 1) | k << BITS).astype(np.uint64)) >> np.uint64(64 - BITS)
            both.append(more >> BITS << BITS | number.astype(np.int64))
        both = np.unique(np.concatenate(both))
        found.append((both & ((1 << BITS) - 1)).astype(np.int32))
        counts[first:first + len(offsets) - 1] = np.bincount(both >> BITS, minlength=len(offsets) - 1)
    return np.concatenate(found) if found else np.zeros(0, np.int32), counts


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[ends] - total[ends - counts]


def held(parts) -> np.ndarray:
    """How many texts hold each feature; ``parts`` are arrays of the features of whole texts."""
    total = np.zeros(1 << BITS, np.int32)
    for ids in parts:
        for first in range(0, len(ids), 1 << 20):
            at, times = np.unique(ids[first:first + (1 << 20)], return_counts=True)
            total[at] += times.astype(np.int32)
    return total


def penalties(pos: np.ndarray, n_pos: int, unl: np.ndarray, n_unl: int, shrink: float = 1e-3, deviations: float = 8,
              power: float = 3) -> np.ndarray:
    """L1 penalty of each feature: ``shrink * max(1, (deviations / z) ** power)``, where positives hold it more often
    than unlabelled texts by z deviations; infinite where they don't."""
    penalty = np.full(1 << BITS, np.inf)
    at = np.flatnonzero(pos)
    pos, unl, n_unl = pos[at], unl[at], max(1, n_unl)
    rate = np.clip((pos + unl) / (n_pos + n_unl), 1e-9, 1 - 1e-9)
    z = (pos / n_pos - unl / n_unl) / np.sqrt(rate * (1 - rate) * (1 / n_pos + 1 / n_unl))
    penalty[at[z > 0]] = shrink * np.maximum(1, (deviations / z[z > 0]) ** power)
    return penalty


def fit(positive: tuple, unlabelled: tuple, prior: float, *, epochs: int = 30, batch: int = 1024, rate: float = 0.3,
        seed: int = 3) -> np.ndarray:
    """Weights of all features, the constant term last."""
    n_pos, n = len(positive[1]), len(positive[1]) + len(unlabelled[1])
    penalty = penalties(held([positive[0]]), n_pos, held([unlabelled[0]]), n - n_pos)
    able = penalty < prior  # the positives pull a weight up by ``prior`` at most, so no other can become positive
    dense = np.flatnonzero(able)
    penalty = np.append(penalty[dense], 0)
    ids, rows = [], []
    for first, part in ((0, positive), (n_pos, unlabelled)):
        keep = able[part[0]]
        ids.append(np.searchsorted(dense, part[0][keep]))
        rows.append(np.repeat(np.arange(first, first + len(part[1]), dtype=np.int32), part[1])[keep])
    ids, rows = np.concatenate(ids), np.concatenate(rows)
    begin = np.searchsorted(rows, np.arange(n + 1))
    random = np.random.default_rng(seed)
    weights, squares = np.zeros(len(penalty)), np.full(len(penalty), 1e-6)
    weights[-1] = np.log(prior / (1 - prior))
    steps = max(1, -(-(n - n_pos) // batch))
    for epoch in range(epochs):
        pos, unl = random.permutation(n_pos), n_pos + random.permutation(n - n_pos)
        for k in range(steps):
            part_p = pos[np.arange(k * batch // 2, (k + 1) * batch // 2) % n_pos]
            part_u = unl[k * batch:(k + 1) * batch]
            if not len(part_u):
                continue
            at = np.concatenate([part_p, part_u])
            length = begin[at + 1] - begin[at]
            place = np.repeat(begin[at] - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
            own = ids[place]
            z = _sums(weights[own], length) + weights[-1]
            zp, zu = z[:len(part_p)], z[len(part_p):]
            chance = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            pull_p, pull_u = chance[:len(part_p)], chance[len(part_p):]
            rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            if rest >= 0:
                slope = np.concatenate([prior * (pull_p - 1 - pull_p) / len(part_p), pull_u / len(part_u)])
            else:
                slope = np.concatenate([prior * pull_p / len(part_p), -pull_u / len(part_u)])
            grad_at, inverse = np.unique(own, return_inverse=True)
            grad = np.bincount(inverse, np.repeat(slope, length), len(grad_at)) if len(own) else np.zeros(0)
            grad_at, grad = np.append(grad_at, len(weights) - 1), np.append(grad, slope.sum())
            squares[grad_at] += grad ** 2
            pace = rate / np.sqrt(squares[grad_at])
            moved = weights[grad_at] - pace * grad
            weights[grad_at] = np.sign(moved) * np.maximum(0, np.abs(moved) - pace * penalty[grad_at])
    found = np.zeros((1 << BITS) + 1)
    found[dense], found[-1] = weights[:-1], weights[-1]
    return found


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, folds: int = 4, held_out_fold: int = 2, threshold: float = 0.3,
                    positives: int = 8_000, unlabelled: int = 24_000) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    ``labels`` has doc_id and toxic (0 or 1; null is no label); labels of the held-out fold are never read.
    ``positives`` and ``unlabelled`` bound the texts that the classifier is fitted on.
    """
    docs = C.query_columns(docs, doc_id="long", text="string")
    train = C.fold(F.col("doc_id"), folds) != held_out_fold
    marks = C.query_columns(labels, doc_id="long", toxic="int").where(F.col("toxic").isNotNull() & train)
    toxic, labelled = marks.agg(F.count_if(F.col("toxic") == 1), F.count("*")).first()
    by_hash = F.xxhash64("doc_id")
    chosen = marks.where("toxic = 1").select("doc_id").distinct().orderBy(by_hash, "doc_id").limit(positives)
    others = docs.where(train).select("doc_id").distinct().join(
        marks.where("toxic = 1").select("doc_id"), "doc_id", "left_anti").orderBy(by_hash, "doc_id").limit(unlabelled)

    def extract(batches):
        for batch in batches:
            ids, counts = features(batch["text"])
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "kind": batch["kind"], "ids": C.lists(ids, counts)})

    # both sides of the union are bounded by parameters, so the table of names may be broadcast
    names = chosen.withColumn("kind", F.lit(1)).union(others.withColumn("kind", F.lit(0)))
    rows = docs.join(F.broadcast(names), "doc_id").select("doc_id", "kind", "text").mapInArrow(
        extract, "doc_id long, kind int, ids array<int>").toArrow()
    kinds, keys, ids, lengths = ([] for _ in range(4))
    for batch in rows.to_batches():
        kinds.append(np.asarray(batch["kind"]))
        keys.append(np.asarray(batch["doc_id"]))
        ids.append(np.asarray(batch["ids"].flatten()))
        lengths.append(np.asarray(batch["ids"].value_lengths()).astype(np.int64))
    n_pos, n_unl = (sum(int((kind == k).sum()) for kind in kinds) for k in (1, 0))
    prior = min(0.9, max(1e-4, toxic / labelled)) if labelled else 0.0
    if n_pos:
        pos, unl = (held(part[np.repeat(kind == k, length)] for part, kind, length in zip(ids, kinds, lengths)) for k in (1, 0))
        able = penalties(pos, n_pos, unl, n_unl) < prior  # the fit leaves the other features at zero
        for j, part in enumerate(ids):
            keep = able[part]
            sums = np.concatenate([[0], np.cumsum(keep)])
            ends = np.cumsum(lengths[j])
            ids[j], lengths[j] = part[keep], sums[ends] - sums[ends - lengths[j]]
        del rows, batch, part
        kind, key, flat, length = map(np.concatenate, (kinds, keys, ids, lengths))
        order = np.lexsort((key, -kind.astype(np.int64)))
        begin = np.cumsum(length) - length
        length, begin = length[order], begin[order]
        flat = flat[np.repeat(begin - np.cumsum(length) + length, length) + np.arange(len(flat))]
        cut = int(length[:n_pos].sum())
        weights = fit((flat[:cut], length[:n_pos]), (flat[cut:], length[n_pos:]), prior)
    else:
        weights = np.zeros((1 << BITS) + 1)
        weights[-1] = -np.inf
    table = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def score(batches):
        weights = table.value
        for batch in batches:
            ids, counts = features(batch["text"])
            z = _sums(weights[ids].astype(np.float64), counts) + weights[-1]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "score": pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))) * (z > -500))})

    return docs.mapInArrow(score, "doc_id long, score double").select(
        "doc_id", (C.fold(F.col("doc_id"), folds) == held_out_fold).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
