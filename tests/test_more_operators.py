"""Logarithmic buckets, fits by rate, footers, whole traces, stored steps, and names that clash."""

from __future__ import annotations

import json
import math
import random
import statistics

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

import quernstone as q
from quernstone.support.names import unused

VALUES = [None, float("nan"), 0.0, -0.0, 1e-308, 5e-324, -3.5, 7.0, 7.0, 1.7e308, float("inf"), float("-inf"), 123.456]


@pytest.mark.parametrize("error", [0.3, 0.01, 0.001])
def test_log_buckets_keep_the_error_for_every_rank(spark, error):
    draw = random.Random(1)
    values = VALUES + [draw.choice([-1, 1]) * 10 ** draw.uniform(-9, 9) for _ in range(200)]
    frame = spark.createDataFrame([(v, 1) for v in values], "x double, sign int")
    held = sorted(v for v in values if v is not None and not math.isnan(v))
    probabilities = [i / len(held) for i in range(1, len(held) + 1)]
    buckets = q.log_buckets(frame, ["x"], error)
    got = {r.prob: r.value for r in q.log_bucket_quantiles(buckets, probabilities, error).collect()}
    assert len(got) == len(held)
    for exact, p in zip(held, probabilities, strict=True):
        if math.isinf(exact) or exact == 0:
            assert got[p] == exact
        elif abs(exact) > 1e-300:
            assert abs(got[p] - exact) <= abs(exact) * error * (1 + 1e-9)


def test_log_buckets_add_up_and_refuse(spark):
    frame = spark.range(100).selectExpr("cast(id as double) as x", "cast(null as double) as none")
    whole = sorted(map(tuple, q.log_buckets(frame, ["x", "none"], 0.05).collect()))
    parts = [q.log_buckets(frame.filter(F.col("x") % 3 == i), ["x", "none"], 0.05) for i in range(3)]
    assert sorted(map(tuple, q.merged_buckets(*parts).collect())) == whole
    assert {c for c, *_ in whole} == {"x"}
    assert q.log_bucket_quantiles(q.log_buckets(frame.limit(0), ["x"], 0.05), [0.5], 0.05).count() == 0
    for bad in (0, 1, -1, 1e-9):
        with pytest.raises(ValueError):
            q.log_buckets(frame, ["x"], bad)


def test_fits_by_rate_equal_fits_of_each_sample(spark):
    draw = random.Random(2)
    rows = [(draw.choice([5, 10, 40, None]), draw.choice([None, float("nan"), 1e9 + draw.random()]), 3.0) for _ in range(300)]
    frame = spark.createDataFrame(rows, "first_rate int, a double, b double")
    rates = [1, 5, 20, 40]
    found = {r.rate: r for r in q.moments_by_rate(q.moments(frame, ["a", "b"]), ["a", "b"], rates).collect()}
    for rate in rates:
        held = [a for r, a, _ in rows if r is not None and r <= rate and a is not None and not math.isnan(a)]
        assert found[rate].n_a == len(held) and found[rate].n_b == sum(r is not None and r <= rate for r, *_ in rows)
        if len(held) < 2:
            assert (found[rate].mean_a, found[rate].std_a) == (None, None)
            continue
        assert found[rate].mean_a == pytest.approx(statistics.mean(held), rel=1e-14)
        assert found[rate].std_a == pytest.approx(statistics.stdev(held), rel=1e-6)
        assert (found[rate].min_a, found[rate].max_a) == (min(held), max(held)) and found[rate].std_b == 0
    scaler = q.MinMaxScaler(["b"], invalid="keep")
    assert q.fit_by_rate(scaler, frame, [40])[40].min == {"b": 3.0}
    with pytest.raises(ValueError):
        q.fit_by_rate(q.StandardScaler(["a"], ddof=0), frame, [5])


def test_footers_of_empty_and_null_columns(spark, tmp_path):
    rows = [(None, None, "b"), (3, float("nan"), "a"), (-2, 1.0, None)]
    frame = spark.createDataFrame(rows, "i long, d double, s string")
    for name, some in (("whole", frame.repartition(3)), ("empty", frame.limit(0))):
        some.write.parquet(str(tmp_path / name))
    found = q.footer_statistics(spark, str(tmp_path / "whole"), ["s", "i", "d"]).first()
    assert (found.row_count, found.min_i, found.max_i, found.min_d, found.min_s, found.max_s) == (3, -2, 3, 1.0, "a", "b")
    assert math.isnan(found.max_d)
    assert tuple(q.footer_statistics(spark, str(tmp_path / "empty"), ["i", "d"]).first()) == (0, None, None, None, None)
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_trace_of_a_rolling_log(spark, tmp_path):
    def task(stage, start, end, gc):
        return {"Event": "SparkListenerTaskEnd", "Stage ID": stage, "Task Info": {"Launch Time": start, "Finish Time": end},
                "Task Metrics": {"JVM GC Time": gc, "Executor Deserialize Time": 1}}

    parts = [
        [{"Event": "SparkListenerJobStart", "Job ID": 0, "Stage IDs": [0, 1]}, task(0, 0, 10, 2),
         {"Event": "SparkListenerExecutorAdded", "Timestamp": 5, "Executor ID": "1", "Executor Info": {"Total Cores": 4}}],
        [task(1, 10, 30, 0), {"Event": "SparkListenerJobStart", "Job ID": 1, "Stage IDs": [1, 2]}, task(2, 30, 40, 1), task(7, 0, 1, 0)],
    ]
    for i, events in enumerate(parts):
        text = "\n".join(map(json.dumps, events))
        (tmp_path / f"events_{i}").write_text(text + ('\n{"Event": "SparkListenerTa' if i else ""))
    trace = q.read_trace(spark, str(tmp_path))
    got = {r.job: (r.stages, r.tasks, r.total_ms, r.overhead_ms) for r in q.task_overhead_by_job(trace).collect()}
    assert got == {0: (2, 2, 30, 4), 1: (1, 1, 10, 2), None: (1, 1, 1, 1)}
    assert [tuple(r) for r in q.executor_spans(trace).collect()] == [("1", 5, None, 4)]


def test_capacity_that_changes_inside_an_interval(spark):
    spans = spark.createDataFrame([(0, 10), (5, 25), (None, 3)], "s long, e long")
    offers = spark.createDataFrame([(0, 15, 2), (12, 20, 4), (0, None, 8), (40, 50, 1), (0, 9, None)], "a long, z long, c int")
    columns = (F.col("s"), F.col("e"), offers, F.col("a"), F.col("z"), F.col("c"))
    got = {r.bucket_start: (r.busy, r.capacity, r.utilisation) for r in q.capacity_share(spans, *columns, 10).collect()}
    assert got == {0: (15, 20, 0.75), 10: (10, 42, 10 / 42), 20: (5, 0, None), 40: (0, 10, 0.0)}


def test_every_step_is_stored_and_read_by_a_new_session(spark, tmp_path):
    rows = spark.createDataFrame([(1.0, 2.0, "a b"), (3.0, 9.0, "b \0 c"), (4.0, 7.0, "")], "x double, y double, text string")
    stages = [
        q.StandardScaler(["x"]),
        q.MinMaxScaler(["y"], high=2.0),
        q.QuantileDiscretizer(["x"], num_buckets=2, method="exact"),
        q.CustomBinner({"y": [0, 5, 10]}, ["y_bin"]),
        q.Tokenizer(),
        q.CountVectorizer(),
        q.FeatureAssembler(["x", "y"], "xy"),
        q.VectorStandardScaler("xy", "xy_scaled"),
    ]
    plain = Pipeline(stages=stages)
    plain.write().save(str(tmp_path / "pipeline"))
    model = plain.fit(rows)
    model.write().overwrite().save(str(tmp_path / "model"))
    model.write().overwrite().save(str(tmp_path / "model"))
    want = sorted(map(str, model.transform(rows).collect()))
    spark.newSession().range(1).count()
    loaded = PipelineModel.load(str(tmp_path / "model"))
    assert sorted(map(str, loaded.transform(rows).collect())) == want
    assert [s.uid for s in loaded.stages] == [s.uid for s in model.stages]
    again = Pipeline.load(str(tmp_path / "pipeline")).fit(rows)
    assert sorted(map(str, again.transform(rows).collect())) == want
    model.stages[0].write().save(str(tmp_path / "one"))
    assert q.StandardScalerModel.load(str(tmp_path / "one")).mean == model.stages[0].mean
    with pytest.raises(AssertionError):
        q.MinMaxScalerModel.load(str(tmp_path / "one"))


def test_terms_hold_any_sign(spark):
    """Signs that raw web text has, among them those once used between terms."""
    tokens = ["a\0b", "\1", "\2", "\3", "x\0", "é", ",", "\n"]
    rows = spark.createDataFrame([(1, tokens), (2, tokens[:3])], "doc_id long, tokens array<string>")
    model = q.CountVectorizer().fit(rows)
    terms = [r.term for r in model.vocabulary.orderBy("term_index").collect()]
    assert sorted(terms) == sorted(tokens)
    got = {r.doc_id: r.features.toArray().tolist() for r in model.transform(rows).collect()}
    assert got == {1: [1.0] * 8, 2: [float(t in tokens[:3]) for t in terms]}


def test_a_vocabulary_read_from_a_file(spark, monkeypatch):
    from quernstone.operators import text

    monkeypatch.setattr(text, "FEW_TERMS", 1)
    monkeypatch.setattr(text, "LEAST_TERMS", 2)
    monkeypatch.setattr(text, "HELD_SLICES", 1)
    rows = spark.createDataFrame([(1, list("abcdeab")), (2, list("ed")), (3, []), (4, None)], "doc_id long, tokens array<string>")
    fitted = q.CountVectorizer().fit(rows)
    model = q.CountVectorizerModel(fitted.vocabulary, local_terms=2)
    got = {r.doc_id: r.features for r in model.transform(rows).collect()}
    assert got == {r.doc_id: r.features for r in fitted.transform(rows).collect()}
    # Few zeros, and still sparse.
    assert {type(v).__name__ for v in got.values()} == {"SparseVector"} and got[1].toArray().tolist() == [2, 2, 1, 1, 1]


def test_intermediate_names_may_be_taken(spark):
    taken = ["_hash", "cut_5", "_body", "_present", "_part_0", "_scaled", "_key_0", "_n", "_KEY_0_", "at", "held", "_whole"]
    rows = spark.createDataFrame([(i, i % 3, f"a b{i}") for i in range(90)], "id long, s long, text string")
    rows = rows.select("*", *[F.lit(f"kept {n}").alias(n) for n in taken])

    def kept(df, count):
        found = df.select(*taken).distinct().collect()
        assert [tuple(r) for r in found] == [tuple(f"kept {n}" for n in taken)] and df.count() == count

    for broadcast in (None, 0):
        kept(q.nested_samples(rows, ["s"], ["id"], [5, 50], broadcast_rows=broadcast), 45)
        kept(q.stratified_sample(rows, ["s"], ["id"], 5, broadcast_rows=broadcast), 6)
    tokens = q.Tokenizer().transform(rows)
    kept(tokens, 90)
    model = q.CountVectorizer().fit(tokens)
    vectors = model.transform(tokens)
    kept(vectors, 90)
    kept(q.VectorStandardScaler("features", "out", with_mean=False).fit_transform(vectors), 90)
    assert q.term_statistics(tokens, by=["at", "held"]).columns == ["at", "held", "term", "tf", "df"]


def test_unused_names():
    assert unused(["A", "b_"], "a", "b", "b_", "c", "c") == ["a_", "b", "b__", "c", "c_"]


@pytest.mark.parametrize("method", ["summary", "sketch"])
def test_default_discretizer_shares(load, method):
    events = load("events")
    binned = q.QuantileDiscretizer(["value"], num_buckets=8, relative_error=0.01, method=method).fit_transform(events)
    total = events.count()
    for row in binned.groupBy("value_bucket").count().collect():
        assert abs(row["count"] / total - 1 / 8) <= 2 * 0.011


@pytest.mark.parametrize("buckets", [1, 7, 1 << 12, 1 << 17])
@pytest.mark.parametrize("vocab_size, min_df", [(1, 1), (40, 1), (40, 3), (300, 2), (100_000, 1)])
def test_frequent_terms_hold_the_vocabulary(load, buckets, vocab_size, min_df):
    tokens = q.Tokenizer().transform(load("documents").limit(60)).select("tokens").cache()
    whole = [tuple(r) for r in q.term_statistics(tokens, min_df=min_df).collect()]
    found = [tuple(r) for r in q.frequent_terms(tokens, vocab_size, min_df=min_df, buckets=buckets).collect()]
    assert set(found) <= set(whole) and len(found) == len(set(found))
    order = lambda r: (-r[1], r[0].encode())
    assert sorted(found, key=order)[:vocab_size] == sorted(whole, key=order)[:vocab_size]
    if buckets == 1 << 17 and vocab_size == 40:
        assert len(found) < len(whole) / 5
    tokens.unpersist()


def test_frequent_terms_of_nothing(spark):
    for rows in ([], [([],)], [(None,)], [([None],)]):
        frame = spark.createDataFrame(rows, "tokens array<string>")
        assert q.frequent_terms(frame, 5).count() == 0
        assert q.CountVectorizer(method="buckets").fit(frame).vocabulary.count() == 0
    with pytest.raises(ValueError):
        q.CountVectorizer(method="guess")
