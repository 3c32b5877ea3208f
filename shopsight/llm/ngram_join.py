"""Near duplicates by an n-gram Jaccard join with prefixes of token combinations.

Tokens are the distinct five-word shingles of a text. Equal sets are one node. All tokens get one global
order: those whose counter in a fixed-width sketch of all token counts stands out come last, else by hash.
Let t be the similarity, and let a set of n tokens keep a prefix of n - ceil(t n) + 2 tokens. Two sets that
are similar then share a rare token of both prefixes, or two frequent ones: so rare tokens are indexed alone
and frequent ones in pairs (one token of extension pays for the pairs). Exact counts over all prefixes
decide the class; the sketch only orders tokens and salts hot ones.

Only links between different components matter for the classes, so the join works in rounds. In the first
rounds each node is compared with one node of each of its tokens' buckets (linear in the index). Then all
pairs of the buckets that still hold different components are formed, thinned by parity bits (each differing
bit is a token that only one set has) and by the number of prefix tokens that similar sets must share, and
verified on their whole texts. Frequent tokens meet by size class: sets of like size must share a combination in
a much shorter prefix than sets of unlike size.
No pair of similar sets is lost; no candidate is capped or sampled.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; a text of one to
four words is one shingle. Every input row gives one row; rows that repeat a doc_id are judged by their own
texts; a null doc_id counts as larger than any other. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.llm import common as C
from shopsight.llm.components import components

COUNTERS = 1 << 18
PAIR = 2  # tokens in a combination of the frequent class
MANY = 24  # frequent tokens of which all couples are shown
SALTS = 16  # parts of a hot token's rows where they are looked up
PARITY = 8  # longs of parity bits per set
_STEP_SIZE = 1.05  # from one size class to the next
_STEP = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their rows, ordered by row and hash."""
    data = C.lower_ascii(data)
    starts, ends = C.words(data, offsets)
    word, rows = C.hashes(data, starts, ends), C.rows_of(starts, offsets)
    if not len(word):
        return word, rows
    total = np.zeros(len(word), np.uint64)
    for j in range(min(size, len(word))):
        total[:len(word) - j] += word[j:] * _STEP[j % 64]
        if j >= 64:
            total = C.mix(total)
    full = np.zeros(len(word), bool)
    if len(word) >= size:
        full[:len(word) - size + 1] = rows[size - 1:] == rows[:len(word) - size + 1]
    begin = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    n = np.diff(np.r_[begin, len(rows)])
    short = begin[n < size]
    for at, length in zip(short, n[n < size]):
        total[at:at + 1] = (word[at:at + length] * _STEP[:length]).sum(keepdims=True) + _STEP[63 - length:64 - length]
    full[short] = True
    value, rows = C.mix(total[full]), rows[full]
    order = np.lexsort((value, rows))
    value, rows = value[order], rows[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])]
    return value[new], rows[new]


def sets(value: np.ndarray, rows: np.ndarray):
    """Row, begin, size and node id of each set; the id is a hash of the whole set."""
    begin = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    size = np.diff(np.r_[begin, len(rows)])
    if not len(begin):
        return begin, begin, size, np.zeros(0, np.int64)
    one, two = np.add.reduceat(value, begin), np.add.reduceat(C.mix(value ^ _STEP[5]), begin)
    return rows[begin], begin, size, C.mix(C.mix(one + size.astype(np.uint64)) * _STEP[6] + two).view(np.int64)


def _need(n, percent):
    """Least overlap of a set of n tokens with a similar set."""
    return (percent * n + 99) // 100


def _nodes(docs: DataFrame, size: int) -> DataFrame:
    """Of each row doc_id, n, node and parity bits; of each task also the rows of the token sketch."""
    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            n, node = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            parity = np.zeros((PARITY, batch.num_rows), np.int64)
            for first, data, offsets in C.text_chunks(batch["text"]):
                value, rows = shingles(data, offsets, size)
                total += np.bincount((value >> np.uint64(46)).astype(np.int64), minlength=COUNTERS)
                at, begin, count, ids = sets(value, rows)
                n[first + at], node[first + at] = count, ids
                if len(at):
                    word, bit = (value >> np.uint64(6)) % np.uint64(PARITY), np.uint64(1) << (value & np.uint64(63))
                    for k in range(PARITY):
                        parity[k, first + at] = np.bitwise_xor.reduceat(
                            np.where(word == np.uint64(k), bit, np.uint64(0)), begin).view(np.int64)
            empty = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "n": pa.array(n), "node": pa.array(node, mask=n == 0),
                **{f"p{k}": pa.array(parity[k]) for k in range(PARITY)},
                "block": empty.cast(pa.int32()), "sums": empty.cast(pa.binary())})
        rows = C.vector_rows(total)
        empty = pa.nulls(rows.num_rows).cast(pa.int64())
        yield pa.RecordBatch.from_pydict({"doc_id": empty, "n": empty, "node": empty,
                                          **{f"p{k}": empty for k in range(PARITY)},
                                          "block": rows["block"], "sums": rows["sums"]})

    bits = ", ".join(f"p{k} long" for k in range(PARITY))
    return docs.mapInArrow(run, f"doc_id long, n long, node long, {bits}, block int, sums binary")


def _index(docs: DataFrame, sketch: np.ndarray, size: int, percent: int, frequent: int) -> DataFrame:
    """token, node, n and often of the prefix tokens that more than one node has."""
    usual = sketch.mean()
    excess = np.maximum(0, sketch - int(usual + 6 * usual ** 0.5 + 16)).astype(np.int64)
    table = docs.sparkSession.sparkContext.broadcast(excess)

    def prefixes(batches):
        excess, seen = table.value, set()
        for batch in batches:
            for _, data, offsets in C.text_chunks(batch["text"]):
                value, rows = shingles(data, offsets, size)
                _, begin, n, node = sets(value, rows)
                fresh = np.zeros(len(node), bool)
                for k, one in enumerate(node.tolist()):
                    if one not in seen:
                        seen.add(one)
                        fresh[k] = True
                group = np.repeat(np.arange(len(n)), n)
                rank = excess[(value >> np.uint64(46)).astype(np.int64)]
                order = np.lexsort((rank, group))
                place = np.arange(len(group)) - begin[group]
                keep = (place < np.minimum(n, n - _need(n, percent) + PAIR)[group]) & fresh[group]
                token, rank, group = value[order][keep], rank[order][keep], group[keep]
                yield pa.RecordBatch.from_pydict({
                    "token": pa.array(token.view(np.int64)), "node": pa.array(node[group]),
                    "salt": pa.array(np.where(rank > 0, node[group] & 63, -1).astype(np.int32)),
                    "n": pa.array(n[group].astype(np.int32)), "place": pa.array(place[keep].astype(np.int32))})

    def repeated(batches):
        """Runs of one token, as they stream by; a run is held only until its class is known."""
        held, flushed = None, False
        for batch in batches:
            rows = np.stack([np.asarray(batch[c]).astype(np.int64) for c in ("token", "salt", "node", "n", "place")])
            if held is not None:
                rows = np.concatenate([held, rows], axis=1)
            if not rows.shape[1]:
                continue
            same = (rows[0, 1:] == rows[0, :-1]) & (rows[1, 1:] == rows[1, :-1])
            new = np.r_[True, ~(same & (rows[2, 1:] == rows[2, :-1]))]
            rows = rows[:, new]
            begin = np.flatnonzero(np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])])
            length = np.diff(np.r_[begin, rows.shape[1]])
            often = (length > frequent) | (rows[1, begin] >= 0)
            often[0] |= flushed
            out = np.repeat(often | (length > 1), length)
            if flushed:
                out[0] = False
            last = begin[-1]
            flushed = bool(often[-1])
            if flushed:
                held = rows[:, -1:]
            else:
                out[last:] = False
                held = rows[:, last:]
            if out.any():
                yield _index_rows(rows[:, out], np.repeat(often, length)[out])
        if held is not None and not flushed and held.shape[1] > 1:
            yield _index_rows(held, np.zeros(held.shape[1], bool))

    found = docs.select("text").mapInArrow(prefixes, "token long, node long, salt int, n int, place int")
    return found.repartition("token", "salt").sortWithinPartitions("token", "salt", "node").mapInArrow(
        repeated, "token long, node long, n int, place int, often boolean")


def _index_rows(rows: np.ndarray, often: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"token": pa.array(rows[0]), "node": pa.array(rows[2]),
                                       "n": pa.array(rows[3].astype(np.int32)), "place": pa.array(rows[4].astype(np.int32)),
                                       "often": pa.array(often)})


def _overlap(n, m, percent):
    """Least overlap of similar sets of n and m tokens."""
    return F.ceil(percent * (F.col(n) + F.col(m)) / (100.0 + percent))


def _combinations(often: DataFrame, percent: int) -> DataFrame:
    """Combinations of frequent tokens: one, two, size_class, delta, large, wide, other_wide, node, n, root and room.

    A node shows its combinations once for every difference ``delta`` of size classes that a similar set may have,
    as the larger and as the smaller of the two: the closer the sizes, the shorter the prefix that must hold a
    combination. Only tokens that the other side shows too, for another component, enter: no other can link, and
    those that similar sets share all stay. A node of up to ``MANY`` frequent tokens there shows couples; a wider one would show too many, so
    single tokens stand for it (``one`` = ``two``), and others show theirs for the wide ones alone. ``room`` is the
    number of tokens of the node that the first prefix with the whole combination leaves out.
    """
    reach = int(np.ceil(np.log(100 / percent) / np.log(_STEP_SIZE)))
    own_class = F.floor(F.log(F.col("n").cast("double")) / float(np.log(_STEP_SIZE))).cast("int")
    tokens = often.withColumn("own_class", own_class).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(reach))).alias("delta")).select(
        "*", F.explode(F.array(F.lit(True), F.lit(False))).alias("large"))
    other = F.col("own_class") + F.when(F.col("large"), -F.col("delta")).otherwise(F.col("delta"))
    # the other set's size at least; one less for the rounding of the power
    least = F.greatest(F.floor(F.pow(F.lit(_STEP_SIZE), other)) - 1, F.when(F.col("large"), F.ceil(
        percent * F.col("n") / 100.0)).otherwise(F.col("n")))
    tokens = tokens.select("token", "place", "node", "n", "root", "delta", "large", F.least("own_class", other).alias("size_class"),
                           least.alias("least"))
    tokens = tokens.withColumn("limit", (F.col("n") - _overlap("n", "least", percent) + PAIR).cast("int")).where("place < limit")
    # a token can only link where both sides show it, for different components; hot tokens are looked up by salt
    meeting = tokens.groupBy("token", "delta", "size_class").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.min("large").alias("all_large"), F.max("large").alias("any_large")).where(
        "low < high AND any_large AND NOT all_large").select(
        "token", "delta", "size_class", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    held = tokens.withColumn("salt", F.pmod(F.hash("node"), F.lit(SALTS))).join(meeting, ["token", "delta", "size_class", "salt"])
    held = held.groupBy("node", "n", "root", "delta", "large", "size_class", "limit").agg(
        F.sort_array(F.collect_list(F.struct("place", "token"))).alias("held")).withColumn("wide", F.size("held") > MANY)
    couples = F.expr("flatten(transform(held, (a, i) -> transform(slice(held, i + 2, size(held)), "
                     "b -> struct(a.token AS one, b.token AS two, b.place AS place))))")
    singles = F.transform(F.filter("held", lambda t: t["place"] < F.col("limit") - 1), lambda t: F.struct(
        t["token"].alias("one"), t["token"].alias("two"), t["place"].alias("place")))
    keys = ["size_class", "delta", "large", "wide", "node", "n", "root"]
    shown = held.where("not wide").select(*keys, F.lit(False).alias("other_wide"), F.explode(couples).alias("c")).union(
        held.select(*keys, F.explode(F.when(F.col("wide"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias(
            "other_wide"), singles.alias("singles")).select(*keys, "other_wide", F.explode("singles").alias("c")))
    return shown.select("c.one", "c.two", *keys, "other_wide", (
        F.col("n") - F.col("c.place") - 1 + F.when(F.col("c.one") == F.col("c.two"), 1).otherwise(PAIR)).alias("room"))


def _enough(shared, n, m, percent):
    """Whether so many shared prefix tokens can belong to similar sets of n and m tokens."""
    most = F.greatest(n, m)
    overlap = F.ceil(percent * (n + m) / (100.0 + percent))
    return ((percent * most <= 100 * F.least(n, m))
            & (shared >= F.greatest(F.lit(1), overlap - F.ceil(percent * most / 100.0) + PAIR)))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int, block: int = 256) -> DataFrame:
    """Those pairs (u, v) whose sets are similar. v's text meets its partners in blocks of about ``block``."""
    pairs = C.stage(pairs.select("u", "v"), "pairs")
    ids = pairs.select("u").union(pairs.select("v")).distinct().join(
        nodes, F.col("u") == F.col("node")).select("node", F.col("doc_id").alias("__id"))
    texts = C.stage(docs.join(ids, F.col("doc_id").eqNullSafe(F.col("__id"))).select("node", "text"), "pair-texts")
    parts = pairs.groupBy("v").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    owners = parts.join(texts, F.col("v") == F.col("node")).select(
        "v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), "node", "text")
    others = pairs.join(parts, "v").select("u", "v", F.pmod(F.hash("u"), "parts").alias("part")).join(
        texts, F.col("u") == F.col("node")).select("v", "part", F.lit(1).alias("side"), "node", "text")

    def compare(batches):
        owner, own = None, None
        for batch in batches:
            keys = list(zip(batch["v"].to_pylist(), batch["part"].to_pylist()))
            sides, names, links = batch["side"].to_pylist(), batch["node"].to_pylist(), []
            for first, data, offsets in C.text_chunks(batch["text"]):
                value, rows = shingles(data, offsets, size)
                at, begin, n, node = sets(value, rows)
                for row, low, count, one in zip((first + at).tolist(), begin.tolist(), n.tolist(), node.tolist()):
                    if one != names[row]:
                        continue  # another text under the same doc_id
                    mine = value[low:low + count]
                    if sides[row] == 0:
                        owner, own = keys[row], mine
                    elif owner == keys[row]:
                        place = np.minimum(np.searchsorted(own, mine), len(own) - 1)
                        both = int((own[place] == mine).sum())
                        if 100 * both >= percent * (len(own) + count - both):
                            links.append((one, owner[0]))
            if links:
                yield pa.RecordBatch.from_pydict({"u": pa.array([x for x, _ in links], pa.int64()),
                                                  "v": pa.array([x for _, x in links], pa.int64())})

    return owners.union(others).repartition("v", "part").sortWithinPartitions("v", "part", "side").mapInArrow(
        compare, "u long, v long").distinct()


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """node and root after further links; only nodes with links are listed."""
    if roots is None:
        return C.stage(components(links), "roots")
    side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    more = links.join(side("u"), "u", "left").join(side("v"), "v", "left").select(
        F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))
    merged = C.stage(components(more).select(F.col("node").alias("root"), F.col("root").alias("top")), "roots")
    return C.stage(roots.join(merged, "root", "left").select("node", F.coalesce("top", "root").alias("root")).union(
        merged.join(roots, "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))), "roots")


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 75, frequent: int = 32, rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id and class_size (rows in the component) of every row.

    Two texts link when 100 * shared >= percent * united shingles; component_id is the smallest doc_id
    that links reach. ``frequent`` parts rare from frequent tokens; it changes the cost, not the result.
    """
    docs = C.query_columns(docs, doc_id="long", text="string")
    found = C.stage(_nodes(docs, size), "shingle-sets")
    sketch = C.sum_vectors(found.where("block is not null").select("block", "sums"), COUNTERS // 64)
    rows = found.where("block is null").drop("block", "sums")
    bits = [f"p{k}" for k in range(PARITY)]
    nodes = C.stage(rows.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), *[F.min(c).alias(c) for c in bits]), "nodes")
    rows = rows.select("doc_id", "n", "node")
    index = C.stage(_index(docs, sketch, size, percent, frequent), "prefix-index")

    roots, open_index = None, index.withColumn("root", F.col("node"))
    for turn in range(rounds):
        pivot = open_index.groupBy("token").agg(F.min_by(
            F.struct("node", "n", "root"), F.xxhash64("node", F.lit(turn))).alias("pivot"))
        stars = (open_index.join(pivot, "token").where("root != pivot.root")
                 .groupBy(F.col("node").alias("u"), F.col("pivot.node").alias("v"), F.col("n"), F.col("pivot.n").alias("m"))
                 .agg(F.count("*").alias("shared")).where(_enough(4 * F.col("shared"), F.col("n"), F.col("m"), percent)))
        found = _verified(stars, nodes, docs, size, percent)
        roots = _merged(roots, found)
        placed = index.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        open_index = C.stage(placed.join(mixed.select("token"), "token"), "open-index")

    parity = nodes.select("node", *bits)

    def pairs_by(keys: list[str], one: DataFrame, two: DataFrame, *more: str):
        """Pairs of nodes of different components that share the keys and that sizes and parity bits allow."""
        one, two = (frame.join(parity, "node").select(*keys, *[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "root", *bits, *more)])
                    for side, frame in (("u", one), ("v", two)))
        # every differing parity bit is at least one token that only one of the sets has
        apart = sum((F.bit_count(F.col(f"{c}_u").bitwiseXOR(F.col(f"{c}_v"))) for c in bits), F.lit(0))
        both = F.col("n_u") + F.col("n_v")
        near = ((percent * F.greatest("n_u", "n_v") <= 100 * F.least("n_u", "n_v"))
                & ((100 + percent) * (both - apart) >= 2 * percent * both))
        order = (F.col("n_u") > F.col("n_v")) | ((F.col("n_u") == F.col("n_v")) & (F.col("node_u") > F.col("node_v")))
        return one.join(two, keys).where(order & (F.col("root_u") != F.col("root_v")) & near)

    names = [F.col("node_u").alias("u"), F.col("node_v").alias("v"), F.col("n_u").alias("n"), F.col("n_v").alias("m")]
    rare, often = open_index.where("not often"), open_index.where("often")
    units = C.stage(_combinations(often, percent), "combinations")
    keys = ["one", "two", "size_class", "delta", "wide_large", "wide_small"]
    large, small = (units.where(F.col("large") == side).withColumnsRenamed({
        "wide": "wide_large" if side else "wide_small", "other_wide": "wide_small" if side else "wide_large"}) for side in (True, False))
    least = _overlap("n_u", "n_v", percent)
    together = pairs_by(keys, large, small, "room").where((F.col("room_u") >= least) & (F.col("room_v") >= least))
    counted = C.stage(pairs_by(["token"], rare, rare).select(*names, F.lit(1).alias("rare")).union(
        together.select(*names, F.lit(0).alias("rare")).distinct()).groupBy("u", "v", "n", "m").agg(F.sum("rare").alias("rare")), "candidates")
    own = often.groupBy("node").agg(F.collect_list("token").alias("own"))  # part of one text's prefix
    for side in "uv":
        counted = counted.join(own.select(F.col("node").alias(side), F.col("own").alias(f"own_{side}")), side, "left")
    shared = F.col("rare") + F.coalesce(F.when(F.col("own_u").isNotNull() & F.col("own_v").isNotNull(), F.size(
        F.array_intersect("own_u", "own_v"))), F.lit(0))
    second = _verified(counted.where(_enough(shared, F.col("n"), F.col("m"), percent)), nodes, docs, size, percent)

    tops = _merged(roots, second)
    joined = rows.join(tops, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # stored first, so that the rows of a large class can be split in the join
    classes = C.stage(joined.where("root is not null").groupBy("root").agg(
        F.min("doc_id").alias("component_id"), F.count("*").alias("class_size")), "classes")
    return joined.join(classes, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))


def keep_one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """Of every class of near duplicates the document with the smallest doc_id; all documents linked with nothing.

    Of repeated rows (same doc_id and text) one stays.
    """
    kept = near_duplicates(docs, **settings).where("doc_id <=> component_id").select(
        F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__kept")), "left_semi").dropDuplicates(["doc_id", "text"])
