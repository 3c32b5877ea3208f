"""Document log-likelihood under a gated recurrent language model and under add-0.1 word counts.

Token counts come from all training documents. The most frequent words are the model's vocabulary; every
other word stands for its kind (made from its bytes), and the word itself then has its count's share of the
kind, with add-0.1 smoothing. So the model gives every text a probability, unknown words included. Counts of
the most frequent words (a fixed number) are sent to all tasks; the other words of each document meet the
table of counts in a join. Texts are split once for the counts and once to be stored as vocabulary numbers, from
which the network is fitted and all rows are scored.

The network is fitted on all training documents. They are dealt by hash into rounds and, within a round, into
groups whose number grows with the tokens; each group's task begins at the round's weights and passes over its
documents, and the round ends with the mean of the weights, by tokens. Groups follow from ids and texts and the
means from integer sums, so neither the layout of the files nor the cluster changes the weights.

Defined results: a null text is empty and has the end token alone; a null doc_id counts as empty text in the
choice of folds; every input row gives one row. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.llm import common as C
from shopsight.llm.gru import Gru
from shopsight.session import scratch_path

END = np.uint64(0x0123456789ABCDEF)
KINDS = 12
ADD = 0.1
BLOCKS = 8
UNIT = 1 << 24  # of a weight, in the integer sums
LEAST_STEPS = 250


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, kinds and counts per row of the tokens, the end token after each row's words."""
    data = C.lower_ascii(data)
    starts, ends = C.words(data, offsets)
    value = C.hashes(data, starts, ends)
    high = np.maximum.reduceat(data, starts) >= 128 if len(starts) else np.zeros(0, bool)  # only spaces follow a word
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    plain = ((last >= 48) & (last <= 57)) | ((last >= 97) & (last <= 122)) | (last >= 128)
    mark = np.where(plain, 0, np.where((last == 44) | (last == 46), 1, 2))
    kind = (high * 3 + mark) * 2 + (ends - starts > 8)
    counts = np.diff(np.searchsorted(starts, offsets))
    at = np.cumsum(counts)
    return np.insert(value, at, END), np.insert(kind, at, 0), counts + 1


def token_counts(docs: DataFrame) -> DataFrame:
    """token, kind and c over all rows."""
    def count(batches):
        held, waiting = [], 0
        def merged():
            value, first, at = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
            return (value, np.concatenate([h[1] for h in held])[first],
                    np.bincount(at, np.concatenate([h[2] for h in held]), len(value)).astype(np.int64))
        for batch in batches:
            for _, data, offsets in C.text_chunks(batch["text"]):
                value, kind, _ = tokens(data, offsets)
                order = np.argsort(value)  # equal tokens are of one kind, so any of them will do
                value = value[order]
                first = np.flatnonzero(np.diff(value, prepend=~value[:1]))
                held.append((value[first], kind[order[first]], np.diff(first, append=len(value))))
                waiting += len(first)
                if waiting > 1 << 21 and len(held) > 1:
                    held, waiting = [merged()], 0
        if held:
            value, kind, n = merged()
            yield pa.RecordBatch.from_pydict({"token": pa.array(value.view(np.int64)), "kind": pa.array(kind.astype(np.int32)),
                                              "c": pa.array(n)})

    return docs.select("text").mapInArrow(count, "token long, kind int, c long").groupBy("token").agg(
        F.first("kind").alias("kind"), F.sum("c").alias("c"))


class Counts:
    """The frequent words in order of their hash: count, vocabulary number (-1: none); totals of all and per kind."""

    def __init__(self, head: pa.Table, n: int, v: int, kinds: list[tuple[int, int, int]], vocabulary: int):
        token = np.array(head["token"], np.int64).view(np.uint64)
        self.c = np.array(head["c"], np.int64)
        order = np.lexsort((token, -self.c))
        chosen = order[token[order] != END][:vocabulary - KINDS - 1]
        number = np.full(len(token), -1, np.int64)
        number[chosen] = 1 + KINDS + np.arange(len(chosen))
        number[token == END] = KINDS
        kind = np.array(head["kind"], np.int64)
        total, types = np.zeros(KINDS), np.zeros(KINDS)
        for k, words, found in kinds:
            total[k], types[k] = words, found
        inside = number >= 0
        np.subtract.at(total, kind[inside], self.c[inside])
        np.subtract.at(types, kind[inside], 1)
        by_hash = np.argsort(token)
        self.token, self.c, self.number = token[by_hash], self.c[by_hash], number[by_hash]
        self.share = np.log10(self.c + ADD)
        bits = max(1, (4 * len(token)).bit_length())  # hashes are even, so a bucket of their first bits holds few
        self.shift = np.uint64(64 - bits)
        self.begins = np.searchsorted(self.token >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.kind_words = total
        self.n, self.v, self.size = n, v, 1 + KINDS + len(chosen)
        self.dtype = np.dtype(np.uint16 if self.size < 1 << 16 else np.int32)  # of stored numbers
        self.base_total = n + ADD * (v + 1)
        self.kind_total = total + ADD * (types + 1)

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each token, and whether it is there at all."""
        if not len(self.token):
            return np.zeros(len(value), np.int64), np.zeros(len(value), bool)
        bucket = (value >> self.shift).astype(np.int64)
        place, last = self.begins.take(bucket).astype(np.int64), self.begins.take(bucket + 1) - 1
        found = self.token.take(place, mode="clip") == value
        left = np.flatnonzero(~found & (place < last))
        while len(left):
            place[left] += 1
            found[left] = hit = self.token.take(place[left]) == value[left]
            left = left[~hit & (place[left] < last[left])]
        return np.minimum(place, len(self.token) - 1), found

    def numbers(self, value: np.ndarray, kind: np.ndarray, place: np.ndarray, found: np.ndarray) -> np.ndarray:
        """What the network reads: vocabulary numbers, kinds for the other words."""
        number = np.where(found, self.number.take(place), -1) if len(self.token) else np.full(len(value), -1)
        return np.where(number >= 0, number, np.where(value == END, KINDS, kind))


def scores(docs: DataFrame, *, folds: int = 10, held_out_fold: int = 0, vocabulary: int = 2025, frequent: int = 1 << 18,
           rounds: int = 10, group: int = 1 << 19, hidden: int = 24) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``frequent`` bounds the words whose counts go to all tasks. The network is fitted in at most ``rounds``
    rounds, by tasks of about ``group`` tokens each.
    """
    docs = C.query_columns(docs, doc_id="long", text="string")
    held_out = C.fold(F.col("doc_id"), folds) == held_out_fold
    counts = C.stage(token_counts(docs.where(~held_out)), "token-counts")
    kinds = [(r["kind"], r["words"], r["types"]) for r in counts.groupBy("kind").agg(
        F.sum("c").alias("words"), F.count("*").alias("types")).collect()]
    head = counts.orderBy(F.desc("c"), "token").limit(frequent).toArrow()
    known = Counts(head, sum(k[1] for k in kinds), sum(k[2] for k in kinds), kinds, vocabulary)
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(vars(known))
    rounds = max(1, min(rounds, -(-known.n // group)))
    groups = max(1, -(-known.n // (rounds * group)))

    def read(batches):
        known = _restored(Counts, table.value)
        for batch in batches:
            n_tokens, n_known = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            base, own = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            rare, rare_counts, ids = [], np.zeros(batch.num_rows, np.int64), []
            for first, data, offsets in C.text_chunks(batch["text"]):
                value, kind, lengths = tokens(data, offsets)
                n = len(lengths)
                rows = np.repeat(np.arange(n), lengths)
                place, found = known.find(value)
                number = known.numbers(value, kind, place, found)
                flat, ends = number.astype(known.dtype), np.cumsum(lengths)
                ids += [flat[e - m:e].tobytes() for e, m in zip(ends.tolist(), lengths.tolist())]
                part = slice(first, first + n)
                n_tokens[part] = lengths
                n_known[part] = np.bincount(rows[found], minlength=n)
                share = known.share.take(place) if len(known.c) else np.zeros(len(value))
                base[part] = np.bincount(rows[found], share[found] - np.log10(known.base_total), n)
                other = found & (number < KINDS)
                own[part] = np.bincount(rows[other], share[other] - np.log10(known.kind_total[kind[other]]), n)
                left = ~found
                key = np.stack([rows[left], value[left].view(np.int64), kind[left], value[left] == END]).astype(np.int64)
                key = key[:, np.lexsort((key[1], key[0]))]
                new = np.ones(key.shape[1], bool)
                new[1:] = (key[0, 1:] != key[0, :-1]) | (key[1, 1:] != key[1, :-1])
                at = np.flatnonzero(new)
                rare.append(np.concatenate([key[:, at], np.diff(np.r_[at, key.shape[1]])[None]]))
                rare_counts[part] = np.bincount(key[0, at], minlength=n)
            rest = np.concatenate(rare, axis=1) if rare else np.zeros((5, 0), np.int64)
            # the end token stands for itself in the vocabulary, so only its base score is open
            items = pa.StructArray.from_arrays(
                [pa.array(rest[1]), pa.array(np.where(rest[3] == 1, -1, rest[2]).astype(np.int32)), pa.array(rest[4].astype(np.int32))],
                ["token", "kind", "tf"])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "round": batch["round"], "member": batch["member"], "mark": batch["mark"],
                "n_tokens": pa.array(n_tokens), "n_known": pa.array(n_known), "base": pa.array(base), "own": pa.array(own),
                "ids": pa.array(ids, pa.binary()),
                "rare": pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(rare_counts)]).astype(np.int32), items)})

    mark = F.xxhash64("doc_id", "text")
    place = F.pmod(F.xxhash64(mark), F.lit(rounds * groups))
    path = scratch_path(spark, "lm-parts")
    read_in = docs.select("doc_id", "text", F.when(held_out, -1).otherwise(place % rounds).cast("int").alias("round"),
                          (place / rounds).cast("int").alias("member"), mark.alias("mark")).mapInArrow(
        read, "doc_id long, round int, member int, mark long, n_tokens long, n_known long, base double, own double, "
        "ids binary, rare array<struct<token: long, kind: int, tf: int>>").withColumn("row", F.monotonically_increasing_id())
    read_in.write.partitionBy("round").parquet(path)
    part = spark.read.schema(read_in.schema).parquet(path)

    network = fit_network(part, known, rounds=rounds, groups=groups, hidden=hidden)
    model = spark.sparkContext.broadcast(vars(network))
    dtype = known.dtype

    def score(batches):
        network = _restored(Gru, model.value)
        for batch in batches:
            flat = np.frombuffer(b"".join(batch["ids"].to_pylist()), dtype).astype(np.int64)
            log = network.score(flat, np.array(batch["n_tokens"], np.int64)) / np.log(10)
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["ids", "own"]).columns, pa.array(np.array(batch["own"]) + log)],
                                             [*plain, "own"])

    plain = ["row", "doc_id", "n_tokens", "n_known", "base"]
    scored = C.stage(part.select(*plain, "own", "ids").mapInArrow(
        score, "row long, doc_id long, n_tokens long, n_known long, base double, own double"), "lm-scored")
    totals = F.element_at(F.array(*[F.lit(float(t)) for t in known.kind_total]), F.greatest(F.col("kind"), F.lit(0)) + 1)
    rare = part.select("row", F.inline("rare")).join(counts.select("token", "c"), "token", "left").withColumn(
        "share", F.log10(F.coalesce("c", F.lit(0)) + ADD))
    rare = rare.groupBy("row").agg(
        F.sum(F.col("tf") * (F.col("share") - F.lit(float(np.log10(known.base_total))))).alias("base_rare"),
        F.sum(F.when(F.col("kind") >= 0, F.col("tf") * (F.col("share") - F.log10(totals)))).alias("own_rare"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("tf"))).alias("known_rare"))
    zero = F.lit(0.0)
    return scored.join(rare, "row", "left").select(
        "doc_id", held_out.alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("known_rare", F.lit(0))).alias("n_known"),
        F.lit(known.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_rare", zero)).alias("base_score"),
        (F.col("own") + F.coalesce("own_rare", zero)).alias("score"))


def fit_network(part: DataFrame, known: Counts, *, rounds: int, groups: int, hidden: int) -> Gru:
    """The network after one pass (more on a small table) over all training documents; raises if a token was left out."""
    network = Gru(known.size, hidden)
    inside = known.number >= KINDS
    counts = np.zeros(known.size)
    counts[:KINDS] = known.kind_words
    counts[known.number[inside]] = known.c[inside]
    network.begin(counts)
    if not known.n:
        return network
    known_size, dtype = known.size, known.dtype
    lanes, rate = (96, 0.01) if rounds == 1 else (512, 0.02)
    length = -(-(len(network.vector()) + 2) // BLOCKS)
    seen = 0
    for k in range(rounds):
        state = part.sparkSession.sparkContext.broadcast(vars(network))

        def fit(rows):
            rows = rows.sort_by("mark")
            own = Gru(known_size, hidden)
            own.put(_restored(Gru, state.value).vector())
            docs = [np.frombuffer(d.as_buffer(), dtype) for d in rows["ids"]]
            tokens = sum(map(len, docs))
            own.fit(docs, lanes=lanes, rate=rate, epochs=1, least_steps=-(-LEAST_STEPS // rounds), part=(k, rounds))
            weight = -(-tokens // 1024)
            total = np.zeros(length * BLOCKS, np.int64)
            vector = own.vector()
            total[:len(vector)] = np.rint(np.clip(vector, -64, 64).astype(np.float64) * UNIT).astype(np.int64) * weight
            total[-2:] = weight, tokens
            return pa.Table.from_batches([C.vector_rows(total, BLOCKS)])

        parts = part.where(F.col("round") == k).select("member", "mark", "ids").repartition(groups, "member").groupBy("member").applyInArrow(
            fit, "block int, sums binary")
        total = C.sum_vectors(parts, length, BLOCKS)
        seen += int(total[-1])
        if total[-2]:
            network.put(total[:len(network.vector())] / (float(total[-2]) * UNIT))
        state.unpersist()
    if seen != known.n:
        raise RuntimeError(f"the network was fitted on {seen} of {known.n} tokens")
    return network


def _restored(kind: type, state: dict):
    """An object from its broadcast fields (broadcasts carry plain arrays, not classes)."""
    out = kind.__new__(kind)
    out.__dict__.update(state)
    return out
