"""Metric cells against all distances, and their cost."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shopsight.operators import neighbours


def brute(queries, train, k, leave_one_out=False):
    """(query, place) to (train id, squared distance); ties go to the lower id."""
    far = ((queries[:, None, :] - train[None, :, :]) ** 2).sum(axis=2)
    if leave_one_out:
        np.fill_diagonal(far, np.inf)
    return {(q, p + 1): t for q in range(len(queries)) for p, t in enumerate(np.argsort(far[q], kind="stable")[:k]) if far[q, t] < np.inf}


def table(spark, points, name):
    rows = [(i, p.tolist(), i % 3) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, f"{name} long, x array<double>, label int")


@pytest.mark.parametrize("pivots", [None, 1, 7, 60])
@pytest.mark.parametrize("shape", ["clusters", "ties", "copies", "even"])
def test_neighbours_equal_all_distances(spark, monkeypatch, shape, pivots):
    monkeypatch.setattr(neighbours, "_BLOCK_ROWS", 20)
    monkeypatch.setattr(neighbours, "_PIECE_ROWS", 50)
    draw = np.random.default_rng(3)
    train = {"clusters": draw.normal(draw.integers(0, 6, (90, 1)) * 10.0, 0.3, (90, 2)), "ties": draw.integers(0, 3, (90, 2)).astype(float),
             "copies": np.repeat(draw.normal(size=(3, 2)), 30, axis=0), "even": draw.random((90, 4))}[shape]
    queries = np.vstack([train[:40], draw.normal(size=(30, train.shape[1])) * 20])
    near = neighbours.nearest(table(spark, queries, "query_id"), table(spark, train, "train_id"), 6, pivots)
    found = {(r.query_id, r.place): r.train_id for r in near.collect()}
    assert found == brute(queries, train, 6)
    itself = neighbours.nearest(table(spark, train, "query_id"), table(spark, train, "train_id"), 6, pivots, leave_one_out=True)
    assert {(r.query_id, r.place): r.train_id for r in itself.collect()} == brute(train, train, 6, True)


def test_fewer_rows_than_neighbours_and_no_rows(spark):
    few = table(spark, np.array([[0.0], [1.0], [5.0]]), "train_id")
    queries = table(spark, np.array([[0.4]]), "query_id")
    assert [r.train_id for r in neighbours.nearest(queries, few, 9).orderBy("place").collect()] == [0, 1, 2]
    assert neighbours.nearest(queries, few.where("false"), 3).collect() == []
    assert neighbours.nearest(queries.where("false"), few, 3).collect() == []


def test_searched_rows_grow_below_the_square(spark, monkeypatch):
    """Distances that are worked out, for one, four and sixteen times the rows."""
    worked = []
    searched = neighbours._searched

    def counted(visits, cells, sizes, *rest):
        met = visits.groupBy("cell").count().join(cells.groupBy("cell").agg(F.count("*").alias("n")), "cell")
        worked[-1] += met.agg(F.sum(F.col("count") * F.col("n"))).first()[0] or 0
        return searched(visits, cells, sizes, *rest)

    monkeypatch.setattr(neighbours, "_searched", counted)
    monkeypatch.setattr(neighbours, "_BLOCK_ROWS", 100)
    draw = np.random.default_rng(8)
    for n in (300, 1200, 4800):
        points = draw.random((n, 2))
        worked.append(0)
        neighbours.nearest(table(spark, points, "query_id"), table(spark, points, "train_id"), 5, leave_one_out=True).count()
    assert worked[1] < 11 * worked[0] and worked[2] < 11 * worked[1]  # 16 times would be the square
    assert worked[2] < 4800 ** 2 / 4


def test_rows_that_cells_cannot_part_travel_by_blocks(spark, monkeypatch):
    """Among vectors of many dimensions no cell is ruled out; a query then meets blocks and not every cell."""
    met = []
    searched = neighbours._searched

    def counted(visits, cells, *rest):
        met.append(visits.count())
        return searched(visits, cells, *rest)

    monkeypatch.setattr(neighbours, "_searched", counted)
    monkeypatch.setattr(neighbours, "_BLOCK_ROWS", 100)
    points = np.random.default_rng(5).normal(size=(900, 24))
    near = neighbours.nearest(table(spark, points, "query_id"), table(spark, points, "train_id"), 5, leave_one_out=True)
    assert {(r.query_id, r.place): r.train_id for r in near.collect()} == brute(points, points, 5, True)
    assert met[1] <= 900


def test_best_rows_equal_all_distances_far_from_the_origin(monkeypatch):
    monkeypatch.setattr(neighbours, "_CHUNK", 16)
    draw = np.random.default_rng(1)
    points = np.vstack([draw.normal(size=(60, 3)) * 1e-3 + 1e4, np.repeat(draw.normal(size=(5, 3)), 8, axis=0)])
    frame = pd.DataFrame({"x": list(points), "label": np.int32(0)})
    best = neighbours._best(frame.assign(query_id=np.arange(100)), frame.assign(train_id=np.arange(100)), 7)
    far = np.zeros((100, 100))
    for d in range(3):
        far += (points[:, d, None] - points[None, :, d]) ** 2
    order = np.argsort(far, axis=1, kind="stable")[:, :7]
    assert best["train_id"].tolist() == order.ravel().tolist()
    assert best["distance2"].tolist() == np.take_along_axis(far, order, axis=1).ravel().tolist()


def test_second_round_leaves_out_boxes_and_rows_beyond_reach(spark, monkeypatch):
    """Rows spread along a line in each group: radii overlap, boxes don't."""
    met, listed = [], []
    searched = neighbours._searched

    def counted(visits, cells, *rest):
        found = searched(visits, cells, *rest)
        met.append(visits.count())
        listed.append(found.selectExpr("size(distance2) as n").agg(F.sum("n")).first()[0] or 0)
        return found

    monkeypatch.setattr(neighbours, "_searched", counted)
    monkeypatch.setattr(neighbours, "_BLOCK_ROWS", 60)
    draw = np.random.default_rng(4)
    group = np.arange(800) % 8
    points = np.c_[np.eye(8)[group] * 6, draw.random((800, 1)) * 30]
    near = neighbours.nearest(table(spark, points, "query_id"), table(spark, points, "train_id"), 4, 40, leave_one_out=True)
    assert {(r.query_id, r.place): r.train_id for r in near.collect()} == brute(points, points, 4, True)
    assert len(met) == 2 and met[1] < 1200 and listed[1] < 1200, (met, listed)


def test_best_rows_up_to_a_reach():
    points = np.arange(10.0)[:, None]
    train = pd.DataFrame({"x": list(points), "label": np.int32(0), "train_id": np.arange(10)})
    queries = pd.DataFrame({"x": list(points[:3]), "query_id": [7, 7, 9], "reach2": [1.0, None, 0.0]})
    best = neighbours._best(queries, train, 3)
    assert best["train_id"].tolist() == [0, 1, 1, 0, 2, 2] and best["row"].tolist() == [0, 0, 1, 1, 1, 2]
    lists = neighbours._listed(best)
    assert lists["query_id"].tolist() == [7, 7, 9] and [list(x) for x in lists["train_id"]] == [[0, 1], [1, 0, 2], [2]]
