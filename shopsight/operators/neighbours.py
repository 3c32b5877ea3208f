"""Exact nearest neighbours by metric cells, and their votes.

Training rows are dealt to the nearest of about the square root of their number of pivots; a cell knows its
radius and the box around its rows. A query first meets the nearest cells that hold k rows together. Its k-th distance
there then rules out every cell whose pivot is farther than that distance and the cell's radius together, or whose box
is farther than that distance, and only the other cells are searched in a second round, up to that distance. A large
cell is cut in blocks and its queries in pieces, so a group of the shuffle is bounded however the rows cluster. Where the cells rule out little, as among vectors of many dimensions, the second
round meets all pairs of larger blocks and pieces instead: a row then travels a bounded number of times and not once
per cell. A group works on numpy matrices and hands out the best k per query row as lists, which are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.session import materialize

_MOST_PIVOTS = 4096
_BLOCK_ROWS = 8192
_PIECE_ROWS = 65536
_STRIP = 256
_CHUNK = 8192
_DENSE_ROWS = 65536
_DENSE_SHARE = 0.25  # of all pairs still open, from which the second round takes whole blocks
_MOST_COORDINATES = 1 << 20  # of pivots, up to which their cells get boxes
_SLACK = 1e-9  # relative; keeps a cell whose bound differs by rounding only


def nearest(queries: DataFrame, train: DataFrame, k: int, pivots: int | None = None,
            leave_one_out: bool = False) -> DataFrame:
    """The k nearest training rows per query row: (query_id, place, train_id, label, distance2).

    ``queries`` has (query_id, x); ``train`` has (train_id, x, label). Distances are squared
    Euclidean in double precision; ties go to the lower id. ``leave_one_out`` bars a row from being
    its own neighbour when both sides are the same table. ``pivots`` changes the cost, not the result;
    what reaches the driver is at most ``_MOST_PIVOTS`` rows of the training table and of its cells.
    """
    train = train.select("train_id", F.col("x").cast("array<double>").alias("x"), F.col("label").cast("int").alias("label"))
    queries = queries.select("query_id", F.col("x").cast("array<double>").alias("x"))
    want = k + leave_one_out
    counted = train.agg(F.count("*").alias("n")).first()["n"]
    # rows that make one block are one cell; beyond, as many cells as a cell has rows
    number = min(_MOST_PIVOTS, pivots or (1 if counted <= _BLOCK_ROWS else int(np.ceil(np.sqrt(counted)))))
    if not counted:
        return queries.where("false").select("query_id", F.lit(0).alias("place"), F.lit(0).cast("long").alias("train_id"),
                                             F.lit(0).alias("label"), F.lit(0.0).alias("distance2"))
    drawn = train.orderBy(F.xxhash64("train_id"), "train_id").limit(number).select("x").collect()
    centres = np.array([r["x"] for r in drawn], np.float64).reshape(len(drawn), -1)
    cells = materialize(_dealt(train, centres), "cells")
    partitions = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if number == 1:  # a single cell is shared out by queries
        pieces = max(partitions, -(-queries.count() // _PIECE_ROWS))
        return _places(_best_of(_searched(queries.withColumn("cell", F.lit(0)), cells, np.array([counted]), want, leave_one_out, pieces), k))
    sizes, radius, low, high = _extents(cells, centres)
    # the cells of the first round are stored, so that the second one leaves out just these
    asked = materialize(queries.mapInPandas(_near_cells(centres, sizes, want), "query_id long, x array<double>, near array<int>"), "asked")
    first = materialize(_searched(_visits(asked, "near"), cells, sizes, want, leave_one_out), "near")
    reach = _best_of(first, k).select("query_id", F.get("best", F.lit(k - 1))["distance2"].alias("reach2"))
    reached = asked.join(reach, "query_id", "left")
    opened = materialize(reached.mapInPandas(
        _open(centres, sizes, radius, low, high), "query_id long, x array<double>, reach2 double, still double, open array<int>"), "open")
    n, still = opened.agg(F.count("*"), F.sum("still")).first()
    if n and still > _DENSE_SHARE * counted * n:
        side = int(np.ceil(np.sqrt(partitions)))
        blocks = max(side, -(-counted // _DENSE_ROWS))
        whole = _searched(opened.select("query_id", "x", "reach2", F.lit(0).alias("cell")), cells.withColumn("cell", F.lit(0)), np.array([counted]),
                          want, leave_one_out, max(side, -(-n // _DENSE_ROWS)), -(-counted // blocks))
        return _places(_best_of(whole, k))
    second = _searched(_visits(opened, "open", "reach2"), cells, sizes, want, leave_one_out)
    return _places(_best_of(first.union(second), k))


def _away2(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance of every point to every centre by one matrix product, and what rounding may add to it."""
    own, theirs = (points ** 2).sum(axis=1)[:, None], (centres ** 2).sum(axis=1)[None, :]
    return own + theirs - 2.0 * (points @ centres.T), _rounding(centres.shape[1]) * (own + theirs)


def _rounding(width: int) -> float:
    return 8 * (width + 8) * np.finfo(float).eps


def _strips(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for batch in batches:
        for start in range(0, len(batch), _STRIP):
            strip = batch.iloc[start:start + _STRIP]
            yield strip, np.stack(strip["x"].to_numpy())


def _dealt(train: DataFrame, centres: np.ndarray) -> DataFrame:
    """The training rows with their cell and the distance to its pivot."""
    def deal(batches):
        for strip, points in _strips(batches):
            cell = _away2(points, centres)[0].argmin(axis=1)
            yield strip.assign(cell=cell.astype(np.int32), away=np.sqrt(((points - centres[cell]) ** 2).sum(axis=1)))

    return train.mapInPandas(deal, "train_id long, x array<double>, label int, cell int, away double")


def _extents(cells: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, radius, lowest and highest coordinates of every cell; very wide rows get no coordinates."""
    width = centres.shape[1] if centres.size <= _MOST_COORDINATES else 0

    def task(batches):
        found = {}
        for batch in batches:
            cell = batch["cell"].to_numpy()
            order = np.argsort(cell, kind="stable")
            starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
            if len(order):
                x = np.stack(batch["x"].to_numpy())[order, :width]
                facts = zip(cell[order][starts].tolist(), np.diff(np.r_[starts, len(order)]),
                            np.maximum.reduceat(batch["away"].to_numpy()[order], starts),
                            np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts))
                for c, *mine in facts:
                    found[c] = merge(found[c], mine) if c in found else mine
        if found:
            yield table(found)

    def add(batches):
        found = {}
        for batch in batches:
            for c, *mine in batch.itertuples(index=False):
                found[c] = merge(found[c], mine) if c in found else mine
        if found:
            yield table(found)

    def merge(one, other):
        return [one[0] + other[0], max(one[1], other[1]), np.minimum(one[2], other[2]), np.maximum(one[3], other[3])]

    def table(found):
        return pd.DataFrame([(c, *facts) for c, facts in found.items()], columns=["cell", "n", "radius", "low", "high"]).astype(
            {"cell": "int32", "n": "int64", "radius": "float64"})

    schema = "cell int, n long, radius double, low array<double>, high array<double>"
    sizes, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    low, high = centres[:, :width].copy(), centres[:, :width].copy()
    for r in cells.select("cell", "away", "x").mapInPandas(task, schema).repartition("cell").mapInPandas(add, schema).toLocalIterator():
        sizes[r["cell"]], radius[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["radius"], r["low"], r["high"]
    return sizes, radius, low, high


def _first_cells(away: np.ndarray, sizes: np.ndarray, want: int) -> list[np.ndarray]:
    """The nearest cells that hold ``want`` rows together, per query."""
    away = np.where(sizes > 0, away, np.inf)
    nearest = away.argmin(axis=1).astype(np.int32)
    chosen = list(nearest[:, None])
    for row in np.flatnonzero(sizes[nearest] < want):
        order = np.argsort(away[row], kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        chosen[row] = order[(before < want) & (sizes[order] > 0)].astype(np.int32)
    return chosen


def _near_cells(centres: np.ndarray, sizes: np.ndarray, want: int):
    def near(batches):
        for strip, points in _strips(batches):
            yield strip.assign(near=_first_cells(_away2(points, centres)[0], sizes, want))

    return near


def _open(centres: np.ndarray, sizes: np.ndarray, radius: np.ndarray, low: np.ndarray, high: np.ndarray):
    """The queries with the cells that the first round left out and ``reach2`` can't rule out, and the rows in these.

    A cell is ruled out by its pivot and radius, or by the box around its rows.
    """
    def strips(batches):
        for strip, points in _strips(batches):
            away2, rounding = _away2(points, centres)
            away = np.sqrt(np.maximum(0.0, away2 - rounding))
            reach2 = strip["reach2"].to_numpy(np.float64)
            reach2 = np.where(np.isnan(reach2), np.inf, reach2)
            open_ = ~(away - radius[None, :] > np.sqrt(reach2)[:, None] + _SLACK * (away + radius[None, :])) & (sizes > 0)[None, :]
            near = strip["near"].to_numpy()
            open_[np.repeat(np.arange(len(strip)), [len(c) for c in near]), np.concatenate(near)] = False
            row, cell = np.nonzero(open_)
            if len(row) <= _DENSE_SHARE * open_.size:
                gap2 = np.zeros(len(row))
                for mine, below, above in zip(points.T, low.T, high.T):
                    at = mine[row]
                    gap2 += np.maximum(0.0, np.maximum(below[cell] - at, at - above[cell])) ** 2
                kept = ~(gap2 > reach2[row] * (1 + _SLACK))
                row, cell = row[kept], cell[kept]
            still = np.bincount(row, sizes[cell], len(strip))
            yield strip.drop(columns="near").assign(
                still=still, open=np.split(cell.astype(np.int32), np.searchsorted(row, np.arange(1, len(strip)))))

    return strips


def _visits(queries: DataFrame, cells: str, *others: str) -> DataFrame:
    """One row per query and cell of its list."""
    return queries.select("query_id", "x", *others, F.explode(cells).alias("cell"))


def _best_of(found: DataFrame, k: int) -> DataFrame:
    """The best k of all lists of a query in one list: (query_id, best)."""
    return found.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list(
        F.arrays_zip("distance2", "train_id", "label")))), 1, k).alias("best"))


def _places(best: DataFrame) -> DataFrame:
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).alias("place"), "b.train_id", "b.label", "b.distance2")


def _searched(visits: DataFrame, cells: DataFrame, sizes: np.ndarray, want: int, leave_one_out: bool,
              pieces: int | None = None, block_rows: int | None = None) -> DataFrame:
    """The best rows of every visited block, in a list per query and block: (query_id, distance2, train_id, label).

    The visits of a cell are cut in as many pieces as their number needs, or in ``pieces``; each piece is sent the
    cell's rows. Where visits have ``reach2``, rows beyond it are left out.
    """
    blocks = F.element_at(F.lit([max(1, -(-n // (block_rows or _BLOCK_ROWS))) for n in sizes.tolist()]), F.col("cell") + 1)
    if pieces:
        cuts = F.lit(pieces)
    else:
        met = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}
        cuts = F.element_at(F.lit([max(1, -(-met.get(c, 0) // _PIECE_ROWS)) for c in range(len(sizes))]), F.col("cell") + 1)
    left = visits.withColumn("piece", F.pmod(F.xxhash64("query_id"), cuts).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    right = cells.withColumn("block", F.pmod(F.xxhash64("train_id"), blocks).cast("int")).withColumn(
        "piece", F.explode(F.sequence(F.lit(0), cuts - 1)))

    def best_of_block(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        best = _best(q, t, want)
        if leave_one_out:
            best = best[(best["train_id"] != best["query_id"]) & best["train_id"].notna() & best["query_id"].notna()]
        return _listed(best)

    keys = ["cell", "block", "piece"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        best_of_block, "query_id long, distance2 array<double>, train_id array<long>, label array<int>")


def _listed(best: pd.DataFrame) -> pd.DataFrame:
    """The rows of each query row, which stand together, as lists in one row."""
    starts = np.flatnonzero(np.diff(best["row"].to_numpy(), prepend=-1))

    def lists(name: str) -> pd.Series:
        values = best[name]
        if name != "distance2" and values.dtype.kind == "f":  # whole numbers with nulls among them
            values = values.astype("Int64").astype(object).where(values.notna(), None)
        return pd.Series(np.split(values.to_numpy(), starts[1:]) if len(starts) else [], dtype=object)

    return pd.DataFrame({"query_id": best["query_id"].to_numpy()[starts], **{c: lists(c) for c in ("distance2", "train_id", "label")}})


def _best(q: pd.DataFrame, t: pd.DataFrame, k: int) -> pd.DataFrame:
    """Best k rows of ``t`` per row of ``q``, a strip of query rows and a chunk of ``t`` at a time.

    One matrix product gives every distance up to rounding. Only pairs that rounding leaves a chance against the
    k-th best so far are worked out by the difference of their coordinates, so the result is that of all distances,
    or of those up to the query's ``reach2`` where there is one. ``row`` is the place of the row in ``q``.
    """
    if q.empty or t.empty:
        return pd.DataFrame({"query_id": [], "train_id": [], "label": [], "distance2": [], "row": []}).astype(
            {"query_id": "int64", "train_id": "int64", "label": "int32", "distance2": "float64", "row": "int64"})
    t = t.sort_values("train_id")
    points = np.ascontiguousarray(np.stack(t["x"].to_numpy()).T)
    ids, labels = t["train_id"].to_numpy(), t["label"].to_numpy()
    n, lengths = len(ids), (points ** 2).sum(axis=0)
    factors = np.vstack([points, np.ones(n), lengths])
    rounding = 8 * (len(points) + 8) * np.finfo(float).eps
    reach2 = np.full(len(q), np.inf)
    if "reach2" in q:
        reach2 = np.where(q["reach2"].isna(), np.inf, q["reach2"].to_numpy(np.float64, na_value=np.nan))
    found = []
    for start in range(0, len(q), _STRIP):
        strip = q.iloc[start:start + _STRIP]
        rows = np.ascontiguousarray(np.stack(strip["x"].to_numpy()).T)
        m, own = rows.shape[1], (rows ** 2).sum(axis=0)
        by = np.vstack([-2.0 * rows, own, np.ones(rows.shape[1])]).T
        slack = rounding * (own + lengths.max())
        far, at = np.full((m, k), np.inf), np.full((m, k), n)
        most = reach2[start:start + _STRIP]
        for first in range(0, n, _CHUNK):
            near = by @ factors[:, first:first + _CHUNK]
            limit = np.where(at[:, -1] < n, far[:, -1], most)
            if near.shape[1] > k and np.isinf(limit).any():
                limit = np.minimum(limit, np.partition(near, k - 1, axis=1)[:, k - 1] + slack)
            row, col = np.nonzero(~(near > (limit + slack)[:, None]))
            col += first
            exact = np.zeros(len(row))
            for mine, theirs in zip(rows, points):
                exact += (mine[row] - theirs[col]) ** 2
            within = ~(exact > most[row])
            row, col, exact = row[within], col[within], exact[within]
            known = at < n
            row = np.concatenate([np.nonzero(known)[0], row])
            col, exact = np.concatenate([at[known], col]), np.concatenate([far[known], exact])
            # columns follow the ids, so the lower id comes first on a tie
            order = np.lexsort((col, exact, row))
            row, col, exact = row[order], col[order], exact[order]
            place = np.arange(len(row)) - np.searchsorted(row, np.arange(m))[row]
            kept = place < k
            far[row[kept], place[kept]], at[row[kept], place[kept]] = exact[kept], col[kept]
        row, place = np.nonzero(at < n)
        take = at[row, place]
        found.append(pd.DataFrame({
            "query_id": strip["query_id"].to_numpy()[row], "train_id": ids[take], "label": labels[take],
            "distance2": far[row, place], "row": start + row}))
    return pd.concat(found)


def votes(neighbours: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Majority label of the first k neighbours for every k; the lowest label wins a tie."""
    reach = F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("place")))
    counts = neighbours.select("query_id", "label", reach.alias("k")).groupBy("query_id", "k", "label").agg(
        F.count("*").alias("n"))
    return counts.groupBy("query_id", "k").agg(
        F.max_by("label", F.struct("n", -F.col("label"))).alias("prediction"),
        (F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("n"))), F.lit(0)) / F.sum("n")).alias("score"))


def accuracy_by_k(voted: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of right votes per k; ``truth`` has (query_id, label)."""
    hit = (F.col("prediction") == F.col("label")).cast("long")
    return voted.join(truth, "query_id").groupBy("k").agg(
        F.count("*").alias("n"), F.sum(hit).alias("n_right")).withColumn("accuracy", F.col("n_right") / F.col("n"))
