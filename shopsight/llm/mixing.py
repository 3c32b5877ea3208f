"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are counted by membership pattern (the set of sources they belong to). Patterns are the supply
nodes of a flow network and sources its demand nodes; the r-th use of a pattern's words costs r - 1, so the
costs of repetition are convex. Costs lie on the supply arcs alone, so the flow of least cost is found by
adding the capacity of one repetition after the other and routing all it can take. The network has one node
per pattern and per source; only those totals reach the driver.

Each pattern's words are then taken as whole documents: every document as often as the flow covers the whole
pattern, and for the rest seeded documents. These are found by a radix selection over hash bins (sums per
bin, then per bin of the boundary bin, then the few documents of one bin), so no group is ever ordered as a
whole; what is still missing is filled by the largest documents that fit, and at last by one that reaches a little
beyond if that is nearer.

Defined results: null texts have size 0; a null source is a source of its own, the last; documents of size 0
or without any source are never taken; repeated rows are taken independently of each other; an empty table
gives an empty result. Ties of the draw go by doc_id and text, never by the layout of the files. Texts of any
length count as a whole; extra columns are kept by ``mixed_rows``, whatever their names.
"""

from __future__ import annotations

import uuid
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopsight.llm import common as C

BIN_BITS = 12
WEIGHTS = (1, 2, 3)


def _mark(text: str, source: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"), F.col(source).cast("string"))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, a mark of text and source, and a row number that stays with the row."""
    def count(batches):
        for batch in batches:
            size = np.zeros(batch.num_rows, np.int64)
            for first, data, offsets in C.text_chunks(batch["text"]):
                starts, _ = C.words(data, offsets)
                size[first:first + len(offsets) - 1] = np.diff(np.searchsorted(starts, offsets))
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "source": batch["source"], "size": pa.array(size),
                                              "mark": batch["mark"]})

    return C.query_columns(docs, doc_id="long", text="string", source="string").withColumn("mark", _mark("text", "source")).mapInArrow(
        count, "doc_id long, source string, size long, mark long").withColumn("row", F.monotonically_increasing_id())


def targets(sizes: dict, weights: dict, repeats: int = 3) -> dict:
    """Targets in proportion to the weights that share all sizes, none above ``repeats`` times its own size."""
    out, left, open_keys = {}, float(sum(sizes.values())), [k for k in sizes]
    while open_keys:
        share = left / sum(weights[k] for k in open_keys)
        above = [k for k in open_keys if weights[k] * share > repeats * sizes[k]]
        if not above:
            out |= {k: weights[k] * share for k in open_keys}
            break
        for k in above:
            out[k] = float(repeats * sizes[k])
            left -= out[k]
        open_keys = [k for k in open_keys if k not in out]
    return out


def route(supply: dict[tuple, int], quota: dict, repeats: int = 3) -> dict[tuple, dict]:
    """Words that each pattern sends to each of its sources, at the least cost of repetition."""
    flow = {p: dict.fromkeys(p, 0) for p in supply}
    users = {}
    for p in supply:
        for s in p:
            users.setdefault(s, []).append(p)
    open_quota = {s: int(round(quota.get(s, 0))) for s in users}
    for _ in range(repeats):
        spare = dict(supply)
        for start in supply:
            while spare[start] > 0:
                # breadth first: patterns reach all their sources, sources reach back the patterns that feed them
                came, queue, end = {("p", start): None}, deque([("p", start)]), None
                while queue and end is None:
                    kind, node = at = queue.popleft()
                    for other in (node if kind == "p" else users[node]):
                        step = ("s" if kind == "p" else "p", other)
                        if step in came or (kind == "s" and flow[other][node] == 0):
                            continue
                        came[step] = at
                        if kind == "p" and open_quota[other] > 0:
                            end = step
                            break
                        queue.append(step)
                if end is None:
                    break
                path, at = [], end
                while came[at] is not None:
                    path.append((came[at], at))
                    at = came[at]
                amount = min([spare[start], open_quota[end[1]]] + [flow[b[1]][a[1]] for a, b in path if a[0] == "s"])
                for a, b in path:
                    if a[0] == "p":
                        flow[a[1]][b[1]] += amount
                    else:
                        flow[b[1]][a[1]] -= amount
                spare[start] -= amount
                open_quota[end[1]] -= amount
    return flow


def _bins(rows: DataFrame, level: int) -> DataFrame:
    return rows.withColumn("bin", F.shiftrightunsigned("seed", 64 - BIN_BITS * (level + 1)).bitwiseAND((1 << BIN_BITS) - 1))


def take(rows: DataFrame, wanted: DataFrame, *, fills: int = 3, seed: int = 0) -> DataFrame:
    """Adds ``extra`` (0 or 1) to rows (row, doc_id, mark, pattern, size): about ``missing`` words of each pattern.

    ``wanted`` has pattern and missing (below the pattern's size), one row per pattern, and comes from the
    driver. The draw follows from the seed, doc_id and mark, so it doesn't depend on the layout of the rows; the
    row number parts rows that are alike in all of these. What the fills leave open goes to one more document
    where that comes nearer than to stop short.
    """
    rows = C.stage(rows.withColumn("seed", F.xxhash64(F.lit(seed), "doc_id", "mark")), "mix-rows")
    wanted = F.broadcast(wanted)
    open_rows = rows.where("size > 0").join(wanted, "pattern")
    chosen = None
    for level in range(2):
        open_rows = _bins(open_rows, level)
        ordered = Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        cuts = open_rows.groupBy("pattern", "missing", "bin").agg(F.sum("size").alias("words")).withColumn(
            "before", F.coalesce(F.sum("words").over(ordered), F.lit(0))).where("before <= missing")
        cuts = C.stage(cuts.select("pattern", "bin", (F.col("before") + F.col("words") <= F.col("missing")).alias("whole"),
                                   (F.col("missing") - F.col("before")).alias("left")), "mix-bins")
        placed = open_rows.join(cuts, ["pattern", "bin"])
        whole = placed.where("whole").select("row")
        chosen = whole if chosen is None else chosen.union(whole)
        open_rows = placed.where("NOT whole").select("row", "doc_id", "pattern", "size", "seed", F.col("left").alias("missing"))
    ordered = Window.partitionBy("pattern").orderBy("seed", "row").rowsBetween(Window.unboundedPreceding, 0)
    chosen = C.stage(chosen.union(open_rows.withColumn("upto", F.sum("size").over(ordered)).where(
        "upto <= missing").select("row")), "mix-chosen")
    for turn in range(fills + 1):
        marked = rows.join(chosen.withColumn("extra", F.lit(1)), "row", "left")
        gaps = marked.groupBy("pattern").agg(F.sum(F.col("size") * F.coalesce("extra", F.lit(0))).alias("got")).join(
            wanted, "pattern").select("pattern", (F.col("missing") - F.col("got")).alias("gap")).where("gap > 0")
        fitting = marked.where("extra IS NULL AND size > 0").join(F.broadcast(gaps), "pattern")
        if turn < fills:
            fitting, best = fitting.where("size <= gap"), F.max_by("row", F.struct("size", "seed", "row"))
        else:
            fitting, best = fitting.where("size < 2 * gap"), F.min_by("row", F.struct(F.abs(F.col("size") - F.col("gap")), "seed", "row"))
        chosen = C.stage(chosen.union(fitting.groupBy("pattern").agg(best.alias("row")).select("row")), "mix-chosen")
    return rows.join(chosen.withColumn("extra", F.lit(1)), "row", "left").withColumn("extra", F.coalesce("extra", F.lit(0)))


def mix_patterns(rows: DataFrame, quota: dict, *, repeats: int = 3, seed: int = 0) -> DataFrame:
    """doc_id, mark, sources, size and taken of rows (row, doc_id, mark, sources array, size)."""
    rows = rows.withColumn("pattern", F.to_json(F.array_sort(F.array_distinct("sources"))))
    found = rows.groupBy("pattern").agg(F.sum("size").alias("words"), F.first(F.array_sort(F.array_distinct("sources"))).alias("keys"))
    found = sorted(found.collect(), key=lambda r: r["pattern"] or "")
    supply = {tuple(r["keys"]): r["words"] for r in found if r["keys"] is not None}
    flow = route(supply, quota, repeats)
    plan = []
    for r in found:
        total = sum(flow[tuple(r["keys"])].values()) if r["keys"] is not None else 0
        plan.append((r["pattern"], total // r["words"] if r["words"] else 0, total % r["words"] if r["words"] else 0))
    wanted = rows.sparkSession.createDataFrame(plan, "pattern string, whole long, missing long")
    picked = take(rows, wanted.select("pattern", "missing"), seed=seed)
    return picked.join(F.broadcast(wanted.select("pattern", "whole")), "pattern", "left").select(
        "doc_id", "mark", "sources", "size", (F.col("size") * (F.coalesce("whole", F.lit(0)) + F.col("extra"))).alias("taken"))


def mix_documents(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, repeats: int = 3, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and mark of every row.

    Sources in order of their names, null last, have the weights in turn; targets share all words and none
    exceeds ``repeats`` times its source's words, nor does a document. Reruns agree.
    """
    rows = C.stage(sizes(docs), "mix-sizes")
    totals = {r["source"]: r["words"] for r in rows.groupBy("source").agg(F.sum("size").alias("words")).collect()}
    names = sorted(totals, key=lambda name: (name is None, name or ""))
    goal = targets(totals, {name: weights[i % len(weights)] for i, name in enumerate(names)}, repeats)
    key = {name: "s" + name if name is not None else "null" for name in names}
    sources = F.array(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))
    mixed = mix_patterns(rows.select("row", "doc_id", "mark", sources.alias("sources"), "size"),
                         {key[n]: t for n, t in goal.items()}, repeats=repeats, seed=seed)
    facts = rows.sparkSession.createDataFrame(
        [(key[n], n, totals[n], goal[n]) for n in names], "key string, source string, source_size long, target double")
    return mixed.join(F.broadcast(facts), F.col("sources")[0] == F.col("key")).select(
        "doc_id", "source", "size", "source_size", "target", "taken", "mark")


def mixed_rows(docs: DataFrame, **settings) -> DataFrame:
    """The documents as the mix takes them: each as many times as it is taken, with all their columns.

    Rows that share doc_id, text and source share out what the mix takes of them; no other rows are mixed up.
    """
    names = {name: f"{name}_{uuid.uuid4().hex}" for name in ("id", "mark", "base", "more", "rows", "uses", "use")}
    use = F.expr("taken div size").cast("int")
    uses = mix_documents(docs, **settings).where("size > 0").groupBy(
        F.col("doc_id").alias(names["id"]), F.col("mark").alias(names["mark"])).agg(
        F.min(use).alias(names["base"]), F.sum(use).alias("all"), F.count("*").alias(names["rows"])).where("all > 0").select(
        *[names[c] for c in ("id", "mark", "base", "rows")], (F.col("all") - F.col(names["base"]) * F.col(names["rows"])).alias(names["more"]))
    found = docs.join(uses, F.col("doc_id").cast("long").eqNullSafe(F.col(names["id"])) & (
        _mark("text", "source") == F.col(names["mark"])))
    # only repeated rows of which the mix takes some once more than others have to be told apart
    alike = found.where(F.col(names["more"]) > 0).withColumn(names["uses"], F.col(names["base"]) + (F.row_number().over(
        Window.partitionBy(names["id"], names["mark"]).orderBy(names["id"])) <= F.col(names["more"])).cast("int"))
    plain = found.where(F.col(names["more"]) == 0).withColumn(names["uses"], F.col(names["base"]))
    return plain.unionByName(alike).where(F.col(names["uses"]) > 0).select(
        *docs.columns, F.explode(F.sequence(F.lit(1), F.col(names["uses"]))).alias(names["use"])).drop(names["use"])
