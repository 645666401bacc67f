"""Bins against Spark ML and against comparing edge by edge."""

from __future__ import annotations

import math

import pytest
from pyspark.ml import feature as ml
from pyspark.sql import functions as F

import quernstone as q

NAN = float("nan")


def as_table(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double")


def buckets(df):
    """Buckets in the order of the (small, one-partition) input."""
    return [r["v_bucket"] for r in df.collect()]


def test_fit_and_transform_equal_spark_ml(load):
    events = load("events").select("value")
    peer = ml.QuantileDiscretizer(
        inputCol="value", outputCol="peer", numBuckets=10, relativeError=0.0
    ).fit(events)
    ours = q.QuantileDiscretizer(["value"], method="exact").fit(events)
    assert ours.splits["value"] == peer.getSplits()
    both = ours.transform(peer.transform(events))
    assert both.filter(F.col("peer").cast("int") != F.col("value_bucket")).count() == 0


@pytest.mark.parametrize("method", ["exact", "summary", "sketch"])
def test_counts_add_up(load, method):
    events = load("events")
    binned = q.QuantileDiscretizer(["value"], method=method).fit_transform(events)
    rows = q.bucket_distribution(binned, "value_bucket").collect()
    counts = {r["bucket"]: r["cnt"] for r in rows}
    assert sum(counts.values()) == events.count()
    assert set(counts) == set(range(10))
    assert max(counts.values()) <= 1.3 * events.count() / 10


def test_missing_values_of_the_discretizer(spark):
    table = as_table(spark, [*map(float, range(10)), NAN, None])
    with pytest.raises(Exception, match="NaN"):
        q.QuantileDiscretizer(["v"], num_buckets=2).fit_transform(table).collect()
    kept = buckets(q.QuantileDiscretizer(["v"], num_buckets=2, invalid="keep").fit_transform(table))
    assert kept == [0] * 4 + [1] * 6 + [2, None]
    skip = q.QuantileDiscretizer(["v"], num_buckets=2, invalid="skip").fit_transform(table)
    assert buckets(skip) == [0] * 4 + [1] * 6
    clean = table.filter("v IS NULL OR NOT isnan(v)")
    error = buckets(q.QuantileDiscretizer(["v"], num_buckets=2).fit_transform(clean))
    assert error == [0] * 4 + [1] * 6 + [None]


def test_repeated_quantiles_collapse(spark):
    table = as_table(spark, [float(i % 3) for i in range(30)] + [None])
    model = q.QuantileDiscretizer(["v"], num_buckets=10, method="exact").fit(table)
    assert model.splits["v"] == [-math.inf, 0.0, 1.0, 2.0, math.inf]
    with pytest.warns(UserWarning, match="3 buckets in use, 10 requested"):
        assert q.actual_bucket_count(model.transform(table), "v_bucket", 10) == 3
    used = q.distinct_buckets(model.transform(table), "v_bucket")
    assert {r["v_bucket"] for r in used.collect()} == {1, 2, 3, None}


def test_column_without_values(spark):
    table = spark.createDataFrame([(None,), (None,)], "v double")
    assert buckets(q.QuantileDiscretizer(["v"]).fit_transform(table)) == [None, None]


VALUES = [0.0, 5.0, 10.0, 20.0, 30.0, -1.0, 31.0, None, NAN]
EDGES = [0.0, 10.0, 20.0, 30.0]


@pytest.mark.parametrize(
    ("options", "expected"),
    [
        ({"closed": "right"}, [None, 0, 0, 1, 2]),
        ({"closed": "right", "include_lowest": True}, [0, 0, 0, 1, 2]),
        ({"closed": "left"}, [0, 0, 1, 2, 2]),
    ],
)
def test_sides(spark, options, expected):
    table = as_table(spark, VALUES)
    kept = q.CustomBinner({"v": EDGES}, invalid="keep", **options).transform(table)
    assert buckets(kept) == [*expected, None, None, None, None]
    skipped = q.CustomBinner({"v": EDGES}, invalid="skip", **options).transform(table)
    assert buckets(skipped) == [b for b in expected if b is not None]
    for bad in (-1.0, 31.0, NAN):
        with pytest.raises(Exception, match="outside its edges"):
            q.CustomBinner({"v": EDGES}, **options).transform(as_table(spark, [bad])).collect()
    inside = as_table(spark, [5.0, 10.0, None])
    assert buckets(q.CustomBinner({"v": EDGES}, **options).transform(inside))[2] is None


def test_left_equals_spark_ml(spark):
    table = as_table(spark, [v / 7 for v in range(0, 211)])
    peer = ml.Bucketizer(splits=EDGES, inputCol="v", outputCol="peer").transform(table)
    both = q.CustomBinner({"v": EDGES}, closed="left").transform(peer)
    assert both.filter(F.col("peer").cast("int") != F.col("v_bucket")).count() == 0


def test_infinite_edges(spark):
    table = as_table(spark, [-1e300, 0.5, math.inf])
    step = q.CustomBinner({"v": [-math.inf, 0.0, 1.0, math.inf]})
    assert buckets(step.transform(table)) == [0, 1, 2]


def test_repeated_edges(spark):
    edges = [0.0, 0.0, 1.0, 1.0, 2.0]
    with pytest.raises(ValueError, match="repeat"):
        q.CustomBinner({"v": edges})
    step = q.CustomBinner({"v": edges}, duplicates="drop", include_lowest=True)
    assert buckets(step.transform(as_table(spark, [0.0, 1.0, 2.0]))) == [0, 0, 1]
    for wrong in ([1.0, 1.0], [2.0, 1.0]):
        with pytest.raises(ValueError):
            q.CustomBinner({"v": wrong}, duplicates="drop")


def test_thousand_edges(spark):
    table = spark.range(0, 5000).selectExpr("id / 5.0D AS v")
    edges = [float(i) for i in range(1001)]
    binned = q.CustomBinner({"v": edges}, closed="left").transform(table)
    assert binned.filter("v_bucket != least(floor(v), 999)").count() == 0
    right = q.CustomBinner({"v": edges}, include_lowest=True).transform(table)
    assert right.filter("v_bucket != greatest(ceil(v) - 1, 0)").count() == 0


def test_several_columns(spark):
    table = spark.createDataFrame([(1.0, 15.0)], "a double, b double")
    step = q.CustomBinner({"a": [0, 2, 4], "b": [0, 10, 20]}, ["x", "y"])
    assert step.transform(table).select("x", "y").first() == (0, 1)
    with pytest.raises(ValueError):
        q.CustomBinner({"a": [0, 1]}, ["x", "y"])
