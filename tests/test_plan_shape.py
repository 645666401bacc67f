"""Plans have the shape that scales: pruned scans, no Python, no shuffle where none is needed."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import quernstone as q
from quernstone.operators.quantiles import _tagged_values
from quernstone.plans import all_plans
from quernstone.support.plan_text import plan_text

PYTHON = re.compile("PythonUDF|ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroups")


def exchanges(df) -> int:
    """Exchange nodes of the formatted plan, broadcasts aside."""
    return len(re.findall(r"^\(\d+\) Exchange\b", plan_text(df), flags=re.M))


def read_schema(df) -> set[str]:
    found = re.findall(r"ReadSchema: struct<(.*)>", plan_text(df))
    return {part.split(":")[0] for scan in found for part in scan.split(",")}


@pytest.mark.parametrize(
    "name",
    ["scaler_transform", "quantile_discretize_left", "custom_bins_right", "count_vector_long",
     "tokenize_documents", "hash_sample_text", "nested_samples_coarse", "vocabulary_topk"],
)
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    text = plan_text(all_plans()[name].query(spark, sf_dir))
    assert not PYTHON.search(text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(
    "name",
    ["scaler_transform", "min_max_transform", "quantile_discretize_left", "custom_bins_right",
     "custom_bins_dup_edges", "tokenize_documents", "hash_sample_text", "count_vector_long"],
)
def test_transforms_do_not_shuffle(spark, sf_dir, name):
    assert exchanges(all_plans()[name].query(spark, sf_dir)) == 0


def test_statistics_shuffle_partial_sums_only(load):
    text = plan_text(q.term_statistics(q.Tokenizer().transform(load("documents")), min_df=2))
    assert "partial_count(if" in text and "Sort" not in text
    assert exchanges(q.term_statistics(q.Tokenizer().transform(load("documents")))) == 1


def test_scans_read_the_columns_they_need(load):
    features = ["l_quantity", "l_tax"]
    assert read_schema(q.standard_statistics(load("lineitem"), features)) == set(features)
    scaled = q.StandardScaler(features).fit(load("lineitem")).transform(load("lineitem"))
    assert read_schema(scaled.select("scaled_l_tax")) == {"l_tax"}
    assert read_schema(q.term_statistics(q.Tokenizer().transform(load("documents")))) == {"text"}
    assert read_schema(q.aggregate(load("events"), q.QuantileSketch("value", [0.5]))) == {"value"}


def test_counting_pass_combines_before_the_shuffle(load):
    numbers = load("events").select(F.col("value").alias("c0"))
    counted = _tagged_values(numbers, ["c0"], [[(1.0, 2.0)]]).groupBy("place", "tag", "value")
    text = plan_text(counted.agg(F.count(F.lit(1))))
    assert "partial_count(1)" in text and "Window" not in text


def test_projection_stays_in_codegen(load):
    binned = q.QuantileDiscretizer(["value"]).fit(load("events")).transform(load("events"))
    assert "[codegen id" in plan_text(binned.select("value_bucket"))
    scaled = q.StandardScaler(["value"]).fit(load("events")).transform(load("events"))
    assert "[codegen id" in plan_text(scaled.select("scaled_value"))


def test_sampled_rows_are_not_shuffled(load):
    """The one exchange carries the cuts, a row per stratum and rate."""
    orders = load("orders").withColumn("stratum", F.year("o_orderdate"))
    text = plan_text(q.nested_samples(orders, ["stratum"], ["o_orderkey"], [5, 15]))
    moved = re.findall(r"^\(\d+\) Exchange *\nInput \[\d+\]: \[(.*)\]", text, flags=re.M)
    assert len(moved) == 1 and "o_orderkey" not in moved[0]


def test_heavy_strata_are_not_shuffled_even_among_many(load):
    """Rows of the most frequent strata meet their cuts by a broadcast; the others are shuffled."""
    orders = load("orders").select("o_orderkey", F.year("o_orderdate").alias("stratum"))
    text = plan_text(q.nested_samples(orders, ["stratum"], ["o_orderkey"], [5], broadcast_rows=0))
    assert "Union" in text and "BroadcastHashJoin LeftAnti" in text
    frequent = text[: text.index("LeftAnti")]
    assert "BroadcastHashJoin Inner" in frequent


def test_no_document_is_shuffled_at_any_vocabulary_size(load, monkeypatch):
    """Slices of the vocabulary come to the documents; many slices are met pass by pass."""
    from quernstone.operators import text

    tokens = q.Tokenizer().transform(load("documents"))
    vocabulary = q.CountVectorizer(vocab_size=900).fit(tokens).vocabulary
    monkeypatch.setattr(text, "LEAST_TERMS", 100)
    for held in (2, 100):
        monkeypatch.setattr(text, "HELD_SLICES", held)
        model = q.CountVectorizerModel(vocabulary, local_terms=300)
        assert model._slices() == [(0, 300), (300, 600), (600, 900)]
        vectors = model.transform(tokens)
        assert exchanges(vectors) == 0 and "Join" not in plan_text(vectors)
        whole = q.CountVectorizerModel(vocabulary).transform(tokens).select("doc_id", F.col("features").alias("whole"))
        both = vectors.join(whole, "doc_id").collect()
        assert len(both) == load("documents").count() and all(r.features == r.whole for r in both)


def test_footers_answer_without_a_scan(spark, sf_dir):
    path = f"{sf_dir}/lineitem.parquet"
    found = q.footer_statistics(spark, path, ["l_orderkey"])
    text = plan_text(found)
    assert re.search(r"PushedAggregation: \[COUNT\(\*\), MIN\(l_orderkey\), MAX\(l_orderkey\)\]", text)
    assert "PushedAggregation" not in plan_text(spark.read.parquet(path).agg(F.count("*")))
    mixed = plan_text(q.footer_statistics(spark, path, ["l_orderkey", "l_quantity"]))
    assert "MIN(l_quantity)" not in mixed and "BroadcastNestedLoopJoin" not in mixed
