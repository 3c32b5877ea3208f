"""Models of many folds and penalties from sums per fold: logistic regression and Gaussian naive Bayes.

What a fold's model needs of its training rows is a sum, so the training part is the total less the fold. Moments
of all folds and classes come from one pass and give the scalers and the naive Bayes of every fold. Newton steps
need sums of gradients and curvatures: one pass over the rows serves a step of all folds and penalties at once,
where separate fits would run a job for each. Only sums of a size that the features fix reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Curvatures are square in the features; wider rows go to the built-in optimiser (:func:`models.logistic`).
WIDEST = 256
_STEPS, _CLOSE = 25, 1e-6


@dataclass(frozen=True)
class Problem:
    """One model: the fold that it leaves out (None: none), its C, and whether classes weigh alike."""

    fold: int | None
    c: float
    balanced: bool = False


@dataclass(frozen=True)
class Moments:
    """Per fold and class (0, 1): rows ``n``, sums ``total`` and sums of squares ``square`` of the features."""

    folds: list[int]
    n: np.ndarray
    total: np.ndarray
    square: np.ndarray

    def without(self, fold: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, means and variances per class, and the deviations of both classes (1 for a constant), less one fold."""
        keep = np.array([f != fold for f in self.folds])
        n, total, square = (x[keep].sum(axis=0) for x in (self.n, self.total, self.square))
        mean = total / np.maximum(1, n)[:, None]
        variance = np.maximum(0.0, square / np.maximum(1, n)[:, None] - mean * mean)
        whole = total.sum(axis=0) / max(1, n.sum())
        spread = np.sqrt(np.maximum(0.0, square.sum(axis=0) / max(1, n.sum()) - whole * whole))
        return n, mean, variance, np.where(spread > 1e-12, spread, 1.0)


def points(rows: DataFrame) -> DataFrame:
    """label, fold and the dense features x of rows with a vector ``x``; fold is -1 where there is none."""
    fold = F.col("fold") if "fold" in rows.columns else F.lit(-1)
    return rows.select(F.col("label").cast("double").alias("label"), fold.cast("int").alias("fold"), vector_to_array("x").alias("x"))


def _summed(rows: DataFrame, task) -> dict[int, np.ndarray]:
    """Sums of the vectors that ``task`` makes per part from its rows, over all tasks."""
    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, vector in zip(batch["part"], batch["sums"]):
                total[part] = total[part] + vector if part in total else np.array(vector)
        if total:
            yield pd.DataFrame({"part": list(total), "sums": list(total.values())})

    schema = "part int, sums array<double>"
    # tasks hand out one row per part; the parts are added up in parallel, so the driver gets one row each
    merged = rows.mapInPandas(task, schema).repartition("part").mapInPandas(add, schema)
    return {r["part"]: np.array(r["sums"], np.float64) for r in merged.collect()}


def moments(rows: DataFrame) -> Moments:
    """The moments of all folds and classes from one pass over ``points``."""
    def task(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if len(batch):
                x, part = np.stack(batch["x"].to_numpy()), (2 * batch["fold"] + batch["label"].astype(int)).to_numpy()
                for p in np.unique(part):
                    mine = x[part == p]
                    total[p] = total.get(p, 0.0) + np.r_[len(mine), mine.sum(axis=0), (mine * mine).sum(axis=0)]
        if total:
            yield pd.DataFrame({"part": list(total), "sums": list(total.values())})

    found = _summed(rows, task)
    folds = sorted({p // 2 for p in found})
    none = np.zeros(len(next(iter(found.values()))))
    table = np.stack([[found.get(2 * f + c, none) for c in (0, 1)] for f in folds])
    width = (table.shape[2] - 1) // 2
    return Moments([int(f) for f in folds], table[:, :, 0], table[:, :, 1:1 + width], table[:, :, 1 + width:])


def fit_all(rows: DataFrame, problems: Sequence[Problem], known: Moments | None = None) -> np.ndarray:
    """Weights of all problems over the unscaled ``points``: one row each, the intercept last.

    The penalty of weight w on a feature scaled by its deviation is w^2 / (2 C), the intercept is free: the fit
    of a scaler and a regression per fold. Rows must be persisted or cheap to read; each step passes over them.
    """
    known = known or moments(rows)
    width = known.total.shape[2]
    facts = [known.without(p.fold) for p in problems]
    scale = np.stack([std for *_, std in facts])
    heft = np.stack([n.sum() / (2 * np.maximum(1, n)) if p.balanced else np.ones(2) for p, (n, *_) in zip(problems, facts)])
    left_out = np.array([-2 if p.fold is None else p.fold for p in problems])
    weights = np.zeros((len(problems), width + 1))

    def step(active: np.ndarray) -> dict[int, np.ndarray]:
        now = weights[active]

        def task(batches):
            total = None
            for batch in batches:
                if not len(batch):
                    continue
                x = np.stack(batch["x"].to_numpy())
                x = np.c_[x, np.ones(len(x))]
                label, fold = batch["label"].to_numpy(), batch["fold"].to_numpy()
                if total is None:
                    total = np.zeros((len(active), 1 + width + 1 + (width + 1) ** 2))
                for j, i in enumerate(active):
                    mine = fold != left_out[i]
                    z, y = x[mine], label[mine]
                    raw = z @ now[j]
                    weight = heft[i][y.astype(int)]
                    p = 1 / (1 + np.exp(-np.clip(raw, -500, 500)))
                    slope = z.T @ (weight * (p - y))
                    curve = (z * (weight * p * (1 - p))[:, None]).T @ z
                    loss = (weight * (np.logaddexp(0, raw) - y * raw)).sum()
                    total[j] += np.r_[loss, slope, curve.ravel()]
            if total is not None:
                yield pd.DataFrame({"part": [int(i) for i in active], "sums": list(total)})

        return _summed(rows, task)

    last, done = np.full(len(problems), np.inf), np.zeros(len(problems), bool)
    previous, move = weights.copy(), np.ones(len(problems))
    for _ in range(_STEPS):
        active = np.flatnonzero(~done)
        if not len(active):
            break
        sums = step(active)
        for i in active.tolist():
            loss, slope, curve = sums[i][0], sums[i][1:width + 2], sums[i][width + 2:].reshape(width + 1, -1)
            ridge = np.r_[scale[i] ** 2 / problems[i].c, 0.0]
            loss += (ridge * weights[i] ** 2).sum() / 2
            if loss > last[i] + 1e-9 * abs(last[i]) and move[i] > 1e-4:  # too far: halve the last move
                move[i] /= 2
                weights[i] = previous[i] + (weights[i] - previous[i]) / 2
                continue
            turn = np.linalg.lstsq(curve + np.diag(ridge) + 1e-10 * np.eye(width + 1), slope + ridge * weights[i], rcond=None)[0]
            done[i] = np.abs(turn * np.r_[scale[i], 1.0]).max() < _CLOSE
            last[i], previous[i], move[i] = loss, weights[i].copy(), 1.0
            weights[i] = weights[i] - turn
    return weights


def linear_score(weights: np.ndarray):
    """Log odds of class 1 under one row of :func:`fit_all`."""
    return lambda x: x @ weights[:-1] + weights[-1]


def bayes_score(known: Moments, fold: int | None):
    """Log odds of class 1 under Gaussian naive Bayes on all folds but one.

    Variances are those of scaled features and get a billionth of the largest one added.
    """
    n, mean, variance, std = known.without(fold)
    scaled = variance / std ** 2
    whole = (n[:, None] * (scaled + ((mean - (n @ mean) / max(1, n.sum())) / std) ** 2)).sum(axis=0) / max(1, n.sum())
    spread = (scaled + 1e-9 * whole.max()) * std ** 2

    def score(x):
        each = [np.log(max(n[c], 1e-300) / n.sum()) - 0.5 * (np.log(2 * np.pi * spread[c]) + (x - mean[c]) ** 2 / spread[c]).sum(axis=1)
                for c in (0, 1)]
        return each[1] - each[0]
    return score


def scored(rows: DataFrame, models: Sequence[tuple[int, object]]) -> DataFrame:
    """place, label, prediction and score of the rows of each model's fold; ``models`` has (fold, log odds)."""
    def task(batches):
        for batch in batches:
            if not len(batch):
                continue
            x, label, fold = np.stack(batch["x"].to_numpy()), batch["label"].to_numpy(), batch["fold"].to_numpy()
            for place, (left, odds) in enumerate(models):
                mine = fold == left
                if mine.any():
                    raw = odds(x[mine])
                    yield pd.DataFrame({"place": place, "label": label[mine], "prediction": (raw > 0).astype(float),
                                        "score": 1 / (1 + np.exp(-np.clip(raw, -500, 500)))})

    return rows.mapInPandas(task, "place int, label double, prediction double, score double")
