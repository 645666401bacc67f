"""Scalers against Spark ML, and on the edge cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml import feature as ml
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import quernstone as q
from quernstone.support.plan_text import plan_text

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [(1.0, None), (2.0, 3.0), (float("nan"), 4.0)]
    return spark.createDataFrame(rows, "a double, b double")


def test_equals_spark_ml(load):
    rows = load("lineitem").select(*FEATURES)
    assembled = ml.VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    model = ml.StandardScaler(
        inputCol="features", outputCol="scaled", withMean=True, withStd=True
    ).fit(assembled)
    both = q.StandardScaler(FEATURES).fit(rows).transform(model.transform(assembled))
    peer = vector_to_array("scaled")
    off = [F.max(F.abs(peer[i] - F.col(f"scaled_{c}"))) for i, c in enumerate(FEATURES)]
    assert max(both.agg(*off).first()) < 1e-9


def test_fitted_data_has_mean_zero_and_deviation_one(load):
    scaled = q.StandardScaler(FEATURES).fit_transform(load("lineitem"))
    names = [f"scaled_{c}" for c in FEATURES]
    row = q.standard_statistics(scaled, names).first()
    for n in names:
        assert abs(row[f"mean_{n}"]) < 1e-9
        assert abs(row[f"std_{n}"] - 1) < 1e-9


def test_result_does_not_depend_on_partitions(load):
    rows = load("lineitem")
    a = q.StandardScaler(FEATURES).fit(rows)
    b = q.StandardScaler(FEATURES).fit(rows.repartition(13))
    for c in FEATURES:
        assert math.isclose(a.mean[c], b.mean[c], rel_tol=1e-12)
        assert math.isclose(a.std[c], b.std[c], rel_tol=1e-12)


def test_missing_values_are_refused_by_default(gaps):
    for column in ("a", "b"):
        with pytest.raises(ValueError, match="null or NaN"):
            q.StandardScaler([column]).fit(gaps)
        with pytest.raises(ValueError, match="null or NaN"):
            q.MinMaxScaler([column]).fit(gaps)
    fitted = q.StandardScaler(["a"]).fit(gaps.filter("a < 3"))
    with pytest.raises(Exception, match="null or NaN"):
        fitted.transform(gaps).select("scaled_a").collect()


def test_skip_drops_rows_with_any_missing_value(gaps):
    model = q.StandardScaler(["a", "b"], invalid="skip").fit(gaps)
    assert model.mean == {"a": 2.0, "b": 3.0}
    assert values(model.transform(gaps), "a") == [2.0]


def test_keep_leaves_missing_values_out_column_by_column(gaps):
    model = q.StandardScaler(["a", "b"], invalid="keep").fit(gaps)
    assert model.mean == {"a": 1.5, "b": 3.5}
    rows = model.transform(gaps).collect()
    assert rows[0]["scaled_b"] is None
    assert math.isnan(rows[2]["scaled_a"])


def test_constant_single_and_empty(spark):
    constant = spark.createDataFrame([(5.0,), (5.0,)], "a double")
    assert values(q.StandardScaler(["a"]).fit_transform(constant), "scaled_a") == [0.0, 0.0]
    assert values(q.MinMaxScaler(["a"]).fit_transform(constant), "scaled_a") == [0.5, 0.5]
    single = spark.createDataFrame([(5.0,)], "a double")
    assert values(q.StandardScaler(["a"]).fit_transform(single), "scaled_a") == [0.0]
    empty = spark.createDataFrame([], "a double")
    assert q.StandardScaler(["a"]).fit(empty).mean == {"a": None}
    assert values(q.StandardScaler(["a"]).fit_transform(empty), "scaled_a") == []
    assert values(q.MinMaxScaler(["a"]).fit_transform(empty), "scaled_a") == []
    assert values(q.StandardScaler(["a"]).fit(empty).transform(single), "scaled_a") == [None]


def test_mean_and_deviation_can_be_left_out(spark):
    rows = spark.createDataFrame([(1.0,), (3.0,)], "a double")
    std = math.sqrt(2)
    only_std = q.StandardScaler(["a"], with_mean=False).fit_transform(rows)
    assert values(only_std, "scaled_a") == pytest.approx([1 / std, 3 / std])
    only_mean = q.StandardScaler(["a"], with_std=False).fit_transform(rows)
    assert values(only_mean, "scaled_a") == [-1.0, 1.0]
    population = q.StandardScaler(["a"], ddof=0).fit_transform(rows)
    assert values(population, "scaled_a") == [-1.0, 1.0]


def test_names_that_need_quoting(spark):
    rows = spark.createDataFrame([(1.0,), (3.0,)], "`it's a ``b``.c` double")
    name = rows.columns[0]
    scaled = q.StandardScaler([name], ["out"], ddof=0).fit_transform(rows)
    assert values(scaled, "out") == [-1.0, 1.0]


def test_output_columns_must_match():
    with pytest.raises(ValueError, match="length"):
        q.StandardScaler(["a", "b"], output_columns=["x"])
    with pytest.raises(ValueError, match="invalid"):
        q.StandardScaler(["a"], invalid="drop")
    with pytest.raises(ValueError, match="ddof"):
        q.StandardScaler(["a"], ddof=2)


def test_min_max_equals_spark_ml(load):
    rows = load("lineitem").select(*FEATURES)
    assembled = ml.VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    model = ml.MinMaxScaler(inputCol="features", outputCol="scaled").fit(assembled)
    both = q.MinMaxScaler(FEATURES).fit(rows).transform(model.transform(assembled))
    peer = vector_to_array("scaled")
    off = [F.max(F.abs(peer[i] - F.col(f"scaled_{c}"))) for i, c in enumerate(FEATURES)]
    assert max(both.agg(*off).first()) < 1e-9


def test_assembler_modes(gaps):
    kept = q.FeatureAssembler(["a", "b"], invalid="keep").transform(gaps)
    assert math.isnan(values(kept, "features")[0][1])
    skipped = q.FeatureAssembler(["a", "b"], invalid="skip").transform(gaps)
    assert values(skipped, "features") == [[2.0, 3.0]]
    with pytest.raises(Exception, match="null or NaN"):
        q.FeatureAssembler(["a", "b"]).transform(gaps).select("features").collect()


@pytest.mark.parametrize("as_vector", [False, True])
def test_vector_scaler_keeps_missing_and_constant_elements(spark, as_vector):
    rows = spark.createDataFrame(
        [(1.0, 7.0, float("nan")), (3.0, 7.0, 2.0)], "a double, b double, c double"
    )
    assembler = q.FeatureAssembler(["a", "b", "c"], as_vector=as_vector, invalid="keep")
    steps = Pipeline(stages=[assembler, q.VectorStandardScaler(ddof=0)])
    found = values(steps.fit(rows).transform(rows), "scaled_features")
    assert list(found[0])[:2] == [-1.0, 0.0]
    assert math.isnan(found[0][2])
    assert list(found[1]) == [1.0, 0.0, 0.0]


def test_cached_block_releases_the_input(spark):
    rows = spark.range(10)
    with q.cached(rows) as held:
        assert held.is_cached
        assert q.row_count(held).first()["n_rows"] == 10
    assert not rows.is_cached


def test_sparse_vectors_stay_sparse(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    tokens = q.Tokenizer().transform(docs)
    counts = q.CountVectorizer(vocab_size=50).fit_transform(tokens).select("doc_id", "features")
    counts = counts.union(spark.createDataFrame([(-1, None)], counts.schema)).persist()
    for ddof in (0, 1):
        scaler = q.VectorStandardScaler(with_mean=False, ddof=ddof)
        model = scaler.fit(counts)
        rows = model.transform(counts).collect()
        held = np.array([r.features.toArray() for r in rows if r.features is not None])
        std = held.std(axis=0, ddof=ddof)
        assert np.allclose(model.std, std)
        for r in rows:
            if r.features is None:
                assert r.scaled_features is None
                continue
            assert r.scaled_features.toArray() == pytest.approx(r.features.toArray() / std)
            assert (r.scaled_features.indices == r.features.indices).all()
    assert "Generate" not in plan_text(model.transform(counts))
    counts.unpersist()


def test_no_vectors_at_all(spark, load):
    empty = q.FeatureAssembler(["l_tax"], as_vector=True).transform(load("lineitem").limit(0))
    assert q.VectorStandardScaler(with_mean=False).fit(empty).transform(empty).count() == 0
