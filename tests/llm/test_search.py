from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import blocks, mih, topk
from quernstone.llm.blocks import usable
from quernstone.llm.queries import PLANS
from quernstone.support.plan_text import plan_text


def load(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)


def best(ids, scores, own, k):
    order = [j for j in np.lexsort((ids, -scores)) if ids[j] != own][:k]
    return [(int(own), n + 1, int(ids[j]), scores[j]) for n, j in enumerate(order)]


def test_exact_top_k_against_brute_force(spark, sf_dir):
    ids, vectors = load(spark, sf_dir)
    whole = np.floor(256 * vectors)
    want = [r for i in np.flatnonzero(ids % 50 == 0) for r in best(ids, whole @ whole[i], ids[i], 5)]
    got = PLANS["op5_exact_top_k"].query(spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_nearest_neighbours_recall(spark, sf_dir):
    ids, vectors = load(spark, sf_dir)
    got = PLANS["op7_nearest_neighbours"].query(spark, sf_dir).collect()
    place = {int(i): n for n, i in enumerate(ids)}
    found, hits, total = {}, 0, 0
    for r in got:
        assert r.score == pytest.approx(vectors[place[r.query_id]] @ vectors[place[r.vec_id]], rel=1e-12)
        found.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    for i in np.flatnonzero(ids % 20 == 0):
        own = sorted(found[ids[i]])
        assert [r[0] for r in own] == list(range(1, 21)) and own == sorted(own, key=lambda r: r[1:])
        want = {r[2] for r in best(ids, vectors @ vectors[i], ids[i], 20)}
        hits, total = hits + len(want & {r[2] for r in own}), total + 20
    assert hits / total >= 0.9


def test_probing_finds_every_code_within_the_radius():
    random = np.random.default_rng(2)
    codes = random.integers(0, 1 << 63, 3000).astype(np.uint64)
    codes[:300] = codes[0] ^ (np.uint64(1) << random.integers(0, 64, 300).astype(np.uint64))
    parts = mih.substring_values(codes)
    index = []
    for p in parts:
        order = np.argsort(p, kind="stable")
        index.append((order, np.searchsorted(p[order], np.arange((1 << mih.WIDTH) + 1))))
    for radius in (0, 1, 3, 10, 22, 27, 64):
        assert sum(s + 1 for s in mih.shares(radius)) == radius + 1
        near = np.flatnonzero(np.bitwise_count(codes ^ codes[0]) <= radius)
        assert set(near) <= set(mih.probe(codes[0], index, radius))


ROWS = [
    (0, [1.0, 0.0]),
    (20, [1.0, 0.0]),
    (50, [1.0, 0.0]),
    (50, [0.5, 0.5]),
    (3, [2.0, 0.0]),
    (4, [2.0, 0.0]),
    (5, [0.0, 0.0]),
    (6, None),
    (7, [1.0, None]),
    (8, [float("nan"), 1.0]),
    (9, [float("inf"), 1.0]),
    (None, [1.0, 1.0]),
    (100, [1.0, 2.0, 3.0]),
    (10, []),
]


def test_ties_repeats_and_unusable_rows(spark):
    rows = spark.createDataFrame(ROWS, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    vectors = usable(rows)
    assert sorted(r.vec_id for r in vectors.collect()) == [0, 3, 4, 5, 20, 50, 50, 100]
    got = topk.top_k(vectors, F.col("vec_id") % 50 == 0, 3, 1).collect()
    of = lambda q: sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
    assert of(0) == [(1, 3, 2), (2, 4, 2), (3, 20, 1)]
    assert of(100) == [] and len(of(50)) == 6
    near = mih.nearest(vectors.filter(F.exists("v", lambda x: x != 0)), F.col("vec_id") % 20 == 0, 3).collect()
    assert sorted((r.rank, r.vec_id) for r in near if r.query_id == 20) == [(1, 3), (2, 4), (3, 0)]
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 50 == 0, 3, 1).count() == 0
    assert mih.nearest(vectors.limit(0), F.col("vec_id") % 20 == 0, 3).count() == 0


@pytest.mark.parametrize("outliers", [[], [3], [0, 3, 50], "all"])
@pytest.mark.parametrize("large", [5e4, 1e9, 1e15])
def test_large_components_are_summed_exactly(spark, outliers, large):
    """One row out of line costs no other its scores, and none fails the query."""
    random = np.random.default_rng(8)
    vectors = np.round(random.normal(size=(120, 64)), 3)
    at = np.arange(120) if outliers == "all" else np.array(outliers, int)
    vectors[at] = vectors[at] * (large if large < 1e15 else 1.0)
    if large == 1e15 and len(at):
        vectors[at, 7] = 2.0**53
        vectors[at, 9] = -(2.0**53)
        vectors[:, 7] = vectors[:, 9] = np.where(np.isin(np.arange(120), at), vectors[:, 7], 0.25)
    whole = [[int(np.floor(4 * x)) for x in v] for v in vectors.tolist()]
    want = []
    for q in range(0, 120, 50):
        scores = [(-sum(a * b for a, b in zip(whole[q], w, strict=True)), i) for i, w in enumerate(whole) if i != q]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:5])]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    if any(abs(r[3]) >= 2**63 for r in want):
        with pytest.raises(Exception, match="(?i)overflow|too large"):
            topk.top_k(usable(rows), F.col("vec_id") % 50 == 0, 5, 4).collect()
        return
    got = topk.top_k(usable(rows), F.col("vec_id") % 50 == 0, 5, 4).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def recall(got, ids, vectors, k, queries):
    found, hits = {}, 0
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for q in queries:
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        hits += len({int(i) for i in ids[np.argpartition(-scores, k)[:k]]} & found[int(ids[q])])
    return hits / (k * len(queries))


def test_recall_where_the_lowest_ids_are_one_cluster(spark):
    """More than one block of rows; the queries inside and outside the cluster each find their neighbours."""
    base = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()])
    random = np.random.default_rng(4)
    vectors = base[random.integers(0, len(base), 20_000)] + random.normal(scale=0.05, size=(20_000, base.shape[1]))
    vectors[:2000] = base[0] + random.normal(scale=0.01, size=(2000, base.shape[1]))
    ids = np.arange(20_000)
    frame = spark.createDataFrame(list(zip(ids.tolist(), vectors.tolist(), strict=True)), "vec_id long, embedding array<double>").repartition(8)
    got = mih.nearest(usable(frame), F.col("vec_id") % 100 == 0, 20).collect()
    inside, outside = ids[:2000:100], ids[2000::100]
    assert recall(got, ids, vectors, 20, inside) >= 0.9
    assert recall(got, ids, vectors, 20, outside) >= 0.9


def test_sums_that_could_be_inexact_are_refused():
    with pytest.raises(OverflowError):
        topk.accumulate(np.full((1, 2), 2.0**30), np.full((1, 2), 2.0**30))


@pytest.mark.parametrize("tasks", [8192, 7])
def test_queries_are_neither_broadcast_nor_copied_for_each_block(spark, monkeypatch, tasks):
    """Many blocks of rows, few bytes of queries: every pair meets once, at the default bounds of Spark's broadcasts."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(blocks, "QUERY_ROWS", 8)
    monkeypatch.setattr(blocks, "QUERY_BYTES", 400, raising=False)
    monkeypatch.setattr(blocks, "TASKS", tasks, raising=False)
    random = np.random.default_rng(6)
    vectors = [np.round(random.normal(size=4 if i % 3 else 5), 2).tolist() for i in range(600)]
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    found = topk.top_k(usable(rows), F.col("vec_id") % 50 == 0, 3, 256)
    whole = [np.floor(256 * np.array(v)) for v in vectors]
    want = []
    for q in range(0, 600, 50):
        ids = np.array([i for i, w in enumerate(whole) if len(w) == len(whole[q])])
        want += best(ids, np.array([whole[i] @ whole[q] for i in ids]), q, 3)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    plan = plan_text(found)
    assert "CartesianProduct" in plan and "Broadcast" not in plan and "Generate" not in plan


def test_query_blocks_are_numbered_by_the_queries_there_are(spark, monkeypatch):
    """Few queries of many rows are one block, which each block of rows meets once."""
    monkeypatch.setattr(blocks, "QUERY_ROWS", 8)
    rows = spark.range(1600).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double")).alias("v"))

    def met(block, q_ids, q_data):
        return np.zeros(1, np.int64), np.array([block["block"]]), np.array([len(q_ids)])

    found = blocks.search(rows, F.col("vec_id") < 3, 50, 100, met, "long").collect()
    assert sorted((r.vec_id, r.score) for r in found) == [(block, 3) for block in range(16)]
