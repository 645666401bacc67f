"""Trace summaries by hand, and over the event log of the test session itself."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import quernstone as q
from quernstone.support import ranking


def busy_by_hand(spans, step):
    found: dict[int, int] = {}
    for start, end in spans:
        for b in range(start // step, end // step + 1):
            inside = min(end, (b + 1) * step) - max(start, b * step)
            if inside > 0:
                found[b * step] = found.get(b * step, 0) + inside
    return found


def busy(spark, spans, step, slots=None):
    table = spark.createDataFrame(spans, "s long, e long").repartition(3)
    rows = q.utilisation(table, F.col("s"), F.col("e"), step, slots).collect()
    assert len({r["bucket_start"] for r in rows}) == len(rows)
    return {r["bucket_start"]: r["busy"] for r in rows}


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_spans_crossing_intervals(spark, monkeypatch, block):
    monkeypatch.setattr(ranking, "BLOCK", block)
    spans = [(0, 10), (5, 25), (30, 30), (39, 95), (1000, 1001), (-15, -5)]
    assert busy(spark, spans, 10) == busy_by_hand(spans, 10)


def test_random_spans(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 4)
    rng = random.Random(5)
    spans = [(s, s + rng.choice([0, 1, 7, 400])) for s in (rng.randrange(3000) for _ in range(300))]
    assert busy(spark, spans, 7) == busy_by_hand(spans, 7)


def test_one_span_over_everything(spark):
    found = busy(spark, [(0, 1_000_000)], 10)
    assert len(found) == 100_000 and set(found.values()) == {10}


def test_no_spans_and_share(spark):
    assert busy(spark, [], 10) == {}
    assert busy(spark, [(None, 5)], 10) == {}
    table = spark.createDataFrame([(0, 10), (0, 5)], "s long, e long")
    row = q.utilisation(table, F.col("s"), F.col("e"), 10, slots=2).first()
    assert (row["busy"], row["utilisation"]) == (15, 0.75)


def test_overhead_of_log_lines(spark):
    start = '{"Event":"SparkListenerTaskEnd","Stage ID":1,'
    info = '"Task Info":{"Launch Time":0,"Finish Time":100},'
    lines = [
        start + info + '"Task Metrics":{"Executor Deserialize Time":10,"JVM GC Time":15}}',
        start + info + '"Task Metrics":{"Executor Deserialize Time":0,"JVM GC Time":25}}',
        '{"Event":"SparkListenerJobEnd","Job ID":0}',
        "not json",
    ]
    table = spark.createDataFrame([(x,) for x in lines], "value string")
    row = q.task_overhead(q.parse_task_ends(table)).first()
    assert (row["stage"], row["tasks"], row["total_ms"]) == (1, 2, 200)
    assert (row["gc_ms"], row["deserialize_ms"], row["overhead_share"]) == (40, 10, 0.25)


def test_own_event_log(spark, event_log_dir):
    spark.range(0, 1000, numPartitions=4).groupBy((F.col("id") % 3).alias("g")).count().collect()
    tasks = q.read_task_ends(spark, event_log_dir.as_uri())
    overhead = q.task_overhead(tasks).collect()
    assert sum(r["tasks"] for r in overhead) >= 4
    assert all(r["total_ms"] >= 0 for r in overhead)
    used = q.utilisation(tasks, F.col("start_ms"), F.col("end_ms"), 1000, slots=8)
    total = tasks.agg(F.sum(F.col("end_ms") - F.col("start_ms"))).first()[0]
    assert used.agg(F.sum("busy")).first()[0] == total
