"""Random forests whose trees are grown in tasks of their own.

The built-in forest keeps every node of every tree on the driver while it grows, some hundred bytes each, and deep trees
have about as many nodes as rows. Here the training rows are packed to a byte per feature, the number of their bin, and
sent to the tasks once; a task grows a whole tree of them, level by level, on numpy arrays. Bins, bags, feature subsets,
stopping and the merging of leaves that predict alike follow the built-in forest; the draws are its own. Trees are
stored and score rows in groups of bounded size, so the driver never holds more than a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.session import materialize

#: Bytes of packed training rows that are sent to the tasks; more rows go to the built-in forest.
MOST_PACKED = 1 << 28
_BINS = 32
_GROUP_BYTES = 1 << 25
_CELLS = 1 << 21  # of one histogram
_LEAST_GAIN = 1e-10
_NODE = np.dtype([("feature", "<u2"), ("cut", "u1"), ("left", "<i4"), ("chance", "<f4")])


def cuts(sample: np.ndarray, bins: int = _BINS) -> list[np.ndarray]:
    """Thresholds per feature: between all values if there are few, else at about equal frequencies."""
    found = []
    for column in sample.T:
        values, counts = np.unique(column, return_counts=True)
        between = (values[:-1] + values[1:]) / 2
        if len(between) >= bins:
            before = np.cumsum(counts)[:-1]
            ends = np.searchsorted(before, len(column) * np.arange(1, bins) / bins)
            between = between[np.unique(np.minimum(ends, len(between) - 1))]
        found.append(between)
    return found


def binned(x: np.ndarray, thresholds: list[np.ndarray]) -> np.ndarray:
    """The bin of every value: how many thresholds lie below it."""
    out = np.empty(x.shape, np.uint8)
    for j, at in enumerate(thresholds):
        out[:, j] = np.searchsorted(at, x[:, j], side="left")
    return out


def _disorder(hits: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Entropy times weight."""
    def part(x):
        return x * np.log(np.where(x > 0, x, 1.0))
    return part(total) - part(hits) - part(total - hits)


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, bins: np.ndarray, subset: int, max_depth: int,
         draw: np.random.Generator) -> np.ndarray:
    """One entropy tree over packed rows ``x`` as nodes in order of level; a right child follows its left one."""
    width = x.shape[1]
    flat = x.ravel()
    row = np.flatnonzero(weight > 0)
    node = np.zeros(len(row), np.int64)
    y = y.astype(np.int64)
    both = np.bincount(y[row], weight[row], 2)
    levels, ids, total, hits = [], np.array([0]), np.array([both.sum()]), np.array([both[1]])
    feature, cut, left, chance = ([] for _ in range(4))
    count, depth = 1, 0
    while True:
        m = len(ids)
        best, best_f, best_c = np.full(m, _LEAST_GAIN), np.zeros(m, np.int64), np.zeros(m, np.int64)
        if depth < max_depth:
            impure = np.flatnonzero((hits > 0) & (hits < total))
            place = np.full(m, -1)
            place[impure] = np.arange(len(impure))
            keep = place[node] >= 0
            row, node = row[keep], node[keep]
            step = max(1, _CELLS // int(bins.max()))
            for start in range(0, len(impure), step):
                some = impure[start:start + step]
                mine = (place[node] >= start) & (place[node] < start + step) if len(impure) > step else slice(None)
                rows, at = row[mine], place[node[mine]] - start
                base, w, label = rows * width, weight[rows], y[rows]
                chosen = np.argpartition(draw.random((len(some), width), np.float32), subset - 1, axis=1)[:, :subset] if subset < width \
                    else np.tile(np.arange(width), (len(some), 1))
                whole, own = total[some], hits[some]
                plain = _disorder(own, whole)
                for f in chosen.T:
                    sizes = bins[f]
                    first = np.cumsum(sizes) - sizes
                    cell = first[at] + flat[base + f[at]]
                    table = np.bincount(2 * cell + label, w, 2 * int(sizes.sum())).reshape(-1, 2)
                    run = np.cumsum(table, axis=0)
                    before = np.vstack([np.zeros((1, 2)), run])[first]
                    owner = np.repeat(np.arange(len(some)), sizes)
                    run -= before[owner]
                    low = run.sum(axis=1)
                    open_ = np.flatnonzero((table.sum(axis=1) > 0) & (low < whole[owner]))
                    who, low, low_hits = owner[open_], low[open_], run[open_, 1]
                    gain = (plain[who] - _disorder(low_hits, low) - _disorder(own[who] - low_hits, whole[who] - low)) / whole[who]
                    order = np.lexsort((-gain, who))
                    lead = order[np.flatnonzero(np.diff(who[order], prepend=-1))]
                    better = gain[lead] > best[some[who[lead]]]
                    lead = lead[better]
                    to = some[who[lead]]
                    best[to], best_f[to], best_c[to] = gain[lead], f[who[lead]], open_[lead] - first[who[lead]]
        split = np.flatnonzero(best > _LEAST_GAIN)
        children = np.full(m, -1)
        children[split] = count + 2 * np.arange(len(split))
        levels.append(m)
        feature.append(best_f), cut.append(best_c), left.append(children), chance.append(hits / total)
        if not len(split):
            break
        place = np.full(m, -1)
        place[split] = np.arange(len(split))
        keep = place[node] >= 0
        row, node = row[keep], node[keep]
        right = flat[row * width + best_f[node]] > best_c[node]
        node = 2 * place[node] + right
        ids = count + np.arange(2 * len(split))
        table = np.bincount(2 * node + y[row], weight[row], 2 * len(ids)).reshape(-1, 2)
        total, hits = table.sum(axis=1), table[:, 1]
        count += len(ids)
        depth += 1
    nodes = np.zeros(count, _NODE)
    for name, parts in (("feature", feature), ("cut", cut), ("left", left)):
        nodes[name] = np.concatenate(parts)
    return _pruned(nodes, np.concatenate(chance), levels)


def _pruned(nodes: np.ndarray, chance: np.ndarray, levels: list[int]) -> np.ndarray:
    """Leaves that predict alike become their parent, from the deepest level up."""
    left, guess = nodes["left"].astype(np.int64), chance > 0.5
    ends = np.cumsum(levels)
    starts = ends - levels
    for start, end in zip(starts[::-1], ends[::-1]):
        at = start + np.flatnonzero(left[start:end] >= 0)
        low = left[at]
        left[at[(left[low] < 0) & (left[low + 1] < 0) & (guess[low] == guess[low + 1])]] = -1
    alive = np.zeros(len(nodes), bool)
    alive[0] = True
    for start, end in zip(starts, ends):
        at = start + np.flatnonzero(alive[start:end] & (left[start:end] >= 0))
        alive[left[at]] = alive[left[at] + 1] = True
    new = np.cumsum(alive) - 1
    nodes["left"] = np.where(left >= 0, new[left], -1)
    nodes["chance"] = chance
    return nodes[alive]


def chances(nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(1) of packed rows under one tree."""
    at, row = np.zeros(len(x), np.int64), np.arange(len(x))
    flat, width = x.ravel(), x.shape[1]
    feature, cut, left = nodes["feature"].astype(np.int64), nodes["cut"].copy(), nodes["left"].astype(np.int64)
    down = left[at]
    while len(row):
        inner = down >= 0
        row, down = row[inner], down[inner]
        now = at[row]
        now = down + (flat[row * width + feature[now]] > cut[now])
        at[row] = now
        down = left[now]
    return nodes["chance"][at].astype(np.float64)


def fit(train: DataFrame, n: int, width: int, trees: int, max_depth: int, seed: int) -> Callable[[DataFrame], DataFrame]:
    """Grow the forest over ``n`` rows with label and a vector ``features`` of ``width``; gives a function that adds
    prediction and score."""
    spark = train.sparkSession
    points = train.select(vector_to_array("features").alias("x"), "label")
    # thresholds come from as many rows as the built-in forest takes for them
    share = min(1.0, 10_000 / max(1, n))
    thresholds = cuts(np.array([r["x"] for r in (points if share == 1 else points.sample(share, seed)).select("x").collect()]).reshape(-1, width))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"x": [binned(np.stack(batch["x"].to_numpy()), thresholds).tobytes()],
                                    "y": [batch["label"].to_numpy().astype(np.uint8).tobytes()]})

    parts = points.mapInPandas(pack, "x binary, y binary").collect()
    packed = spark.sparkContext.broadcast((b"".join(r["x"] for r in parts), b"".join(r["y"] for r in parts)))
    del parts
    bins = np.array([len(t) + 1 for t in thresholds])
    subset = int(np.ceil(np.sqrt(width)))

    def grown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y = (np.frombuffer(part, np.uint8) for part in packed.value)
            x = x.reshape(len(y), width)
            for tree in batch["id"]:
                draw = np.random.default_rng([seed, int(tree)])
                weight = draw.poisson(1.0, len(y)).astype(float) if trees > 1 else np.ones(len(y))
                if not weight.any():
                    weight[:] = 1.0
                nodes = grow(x, y, weight, bins, subset if trees > 1 else width, max_depth, draw)
                yield pd.DataFrame({"tree": [int(tree)], "size": [nodes.nbytes], "nodes": [nodes.tobytes()]})

    forest = materialize(spark.range(0, trees, 1, trees).mapInPandas(grown, "tree long, size long, nodes binary"), "trees")
    packed.destroy()

    def predict(df: DataFrame) -> DataFrame:
        sizes = sorted((r["tree"], r["size"]) for r in forest.select("tree", "size").collect())
        groups, held = [[]], 0
        for tree, size in sizes:
            if groups[-1] and held + size > _GROUP_BYTES:
                groups.append([])
                held = 0
            groups[-1].append(tree)
            held += size
        df = df.withColumn("score", F.lit(0.0))
        for place, group in enumerate(groups):
            if place:  # a task holds one group of trees at a time
                df = materialize(df, "scores")
            df = df.withColumn("score", F.col("score") + _sum_of(forest, group, thresholds, spark)(vector_to_array("features")))
        return df.withColumn("score", F.col("score") / trees).withColumn(
            "prediction", (F.col("score") > 0.5).cast("double"))
    return predict


def _sum_of(forest: DataFrame, group: list[int], thresholds: list[np.ndarray], spark):
    found = forest.where(F.col("tree").between(group[0], group[-1])).select("tree", "nodes").collect()
    sent = spark.sparkContext.broadcast([bytes(r["nodes"]) for r in sorted(found, key=lambda r: r["tree"])])

    @F.pandas_udf("double")
    def total(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trees = [np.frombuffer(nodes, _NODE) for nodes in sent.value]
        for x in batches:
            if not len(x):
                yield pd.Series([], dtype=float)
                continue
            rows = binned(np.stack(x.to_numpy()), thresholds)
            yield pd.Series(sum(chances(nodes, rows) for nodes in trees))

    return total
