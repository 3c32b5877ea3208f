"""Columns without spread and scores of one class."""

import pytest

from shopsight.operators import evaluate, stats


def test_histogram_of_one_value(spark):
    rows = stats.histogram(spark.createDataFrame([(3.0,)] * 4 + [(None,)], "v double"), "v", 10).orderBy("bin").collect()
    assert [r.n for r in rows] == [0] * 5 + [4] + [0] * 4
    assert (rows[0].bin_from, rows[-1].bin_to) == (2.5, 3.5)


def test_density_without_spread(spark):
    same = spark.createDataFrame([(3.0,)] * 4, "v double")
    with pytest.raises(Exception, match="need a bandwidth"):
        stats.density(same, "v").collect()
    assert len(stats.density(same, "v", bandwidth=1.0).collect()) > 0


def test_roc_of_one_class(spark):
    rows = evaluate.roc_curve(spark.createDataFrame([(1, 0.5), (1, 0.7), (1, None)], "y int, s double"), "y", "s").collect()
    assert sorted(r.threshold for r in rows) == [0.5, 0.7]
    assert all(r.fpr is None and r.area is None for r in rows)
