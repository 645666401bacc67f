from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernstone.llm import quality
from quernstone.llm.queries import PLANS


@pytest.fixture(scope="module")
def larger(sf_dir):
    """Held-out accuracy needs some hundred labels."""
    return sf_dir.replace("sf0.001", "sf0.01")


def area(scores: np.ndarray, labels: np.ndarray) -> float:
    """Share of pairs of a good and a bad document that are in order."""
    good, bad = scores[labels == 1], scores[labels == 0]
    return float((good[:, None] > bad[None, :]).mean())


def test_held_out_accuracy(spark, larger):
    rows = PLANS["op9_quality_scores"].query(spark, larger).collect()
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    scores = np.array([r.score for r in held])
    truth = np.array([labels[r.doc_id] for r in held])
    assert area(scores, truth) > 0.95
    assert ((scores >= 0.3) == truth).mean() > 0.93


def test_equal_texts_have_equal_scores_whatever_their_row(spark, sf_dir, edges, clashing):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = quality.score(clashing, model).collect()
    assert len(rows) == edges.count() and all(0 <= r.score <= 1 for r in rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert len(by_id[5]) == 1 and by_id[1] == by_id[None] and by_id[2] == by_id[3] == by_id[4]
    assert quality.score(edges.limit(0), model).count() == 0
    kept = quality.keep_good(clashing, model, 0.0)
    assert kept.columns == clashing.columns and kept.count() == edges.count()
    assert quality.keep_good(clashing, model, 1.1).count() == 0


def test_scores_do_not_depend_on_the_slice():
    texts = ["one two two three", None, "", "é é é", "x" * 500]
    model = quality.Model(np.random.default_rng(1).normal(size=1 << 16).astype(np.float32), 0.1)
    together = model.scores(pa.array(texts))
    assert np.allclose(together, [model.scores(pa.array([t], pa.string()))[0] for t in texts], atol=1e-12)


def test_missing_labels(spark, edges):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(edges, none).constant == 0
    one = spark.createDataFrame([(i, 1) for i in range(1, 8)] + [(8, None)], "doc_id long, quality int")
    model = quality.fit(edges, one)
    assert all(r.score > 0.5 for r in quality.score(edges, model).collect())
    both = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (6, 0), (7, 0), (99, 0)], "doc_id long, quality int")
    assert quality.score(edges, quality.fit(edges, both)).count() == edges.count()


def test_fold(spark):
    rows = spark.range(50).select("id", quality.in_fold(F.col("id"), 5, 0).alias("held"))
    assert all(r.held == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows.collect())


def naive_features(text):
    """One value for the text, its words, pairs and byte runs, each by the same hash as a bucket."""
    found = (text or "").encode().split()
    whole = quality.mixed
    word = {w: quality.word_hashes(quality.words(*quality.flat(pa.array([w.decode()]))))[0] for w in set(found)}
    out = [whole(np.zeros(1, np.uint64))[0]] + [word[w] for w in found]
    for a, b in zip(found, found[1:], strict=False):
        pair = whole(np.array([word[a]]) * np.uint64(3) + word[b])[0]
        out.append(whole(np.ones(1, np.uint64))[0] if a == b else pair)
    joined = b" ".join(found) + b" " if found else b""
    for size in quality.CHARACTER_GRAMS:
        for i in range(len(joined) - size + 1):
            gram = int.from_bytes(joined[i : i + size], "little") + (size << 56)
            out.append(whole(np.array([gram], np.uint64))[0])
    return [int(h) >> (64 - quality.BUCKET_BITS) for h in out]


def test_scores_against_features_averaged_one_by_one():
    random = np.random.default_rng(5)
    model = quality.Model(random.normal(size=1 << quality.BUCKET_BITS).astype(np.float32), 0.25)
    texts = ["", None, "a", "aa  bb\naa aa", "é漢 🎉 x", "word " * 50, " lead and trail \t"]
    for text, got in zip(texts, model.scores(pa.array(texts, pa.string())), strict=True):
        average = np.mean([float(model.shares[b]) for b in naive_features(text)])
        assert got == pytest.approx(1 / (1 + np.exp(-(average + 0.25))), rel=1e-6)
