from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernstone.llm import lm
from quernstone.llm.queries import PLANS


def tokens(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return [*low.split(), None]


@pytest.mark.parametrize("held", [lm.HELD_WORDS, 500])
def test_documents_against_counting(spark, sf_dir, monkeypatch, held):
    monkeypatch.setattr(lm, "HELD_WORDS", held)
    monkeypatch.setattr(lm, "MODEL_WORDS", 200)
    docs = {d.doc_id: tokens(d.text) for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = {i for i in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = Counter(t for i, ts in docs.items() if i not in out for t in ts)
    total, distinct = sum(counts.values()), len(counts)
    rows = PLANS["op10_language_model_scores"].query(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = docs[r.doc_id]
        assert r.held_out == (r.doc_id in out) and r.train_tokens == total
        assert (r.n_tokens, r.n_known) == (len(own), sum(counts[t] > 0 for t in own))
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in own)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0
    held_rows = [r for r in rows if r.held_out]
    assert sum(r.score for r in held_rows) > sum(r.base_score for r in held_rows)


def test_probabilities_of_every_context_add_up_to_one(spark):
    shares = np.array([0.5, 0.2, 0.1, 0.2])
    model = lm.Parameters.start(shares)
    random = np.random.default_rng(1)
    for _ in range(20):
        last, second, word = random.integers(0, 5, 64), random.integers(0, 5, 64), random.integers(0, 4, 64)
        model.step(last, second, word, random.integers(0, 4, 8), np.log(8 * shares).astype(np.float32))
    tables = lm.tables(spark.range(1), model)
    for last in range(5):
        for second in range(5):
            every = tables.log_probabilities(np.full(4, last), np.full(4, second), np.arange(4))
            assert np.exp(every).sum() == pytest.approx(1, abs=1e-5)


def test_training_learns_an_order(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a b c " * 40).alias("text"), F.lit(True).alias("train"))
    row = lm.score(docs).first()
    assert row.score > row.base_score / 2


def test_contexts_stop_at_the_text():
    last, second = lm.contexts(np.array([1, 2, 3, 9, 4, 9, 9]), np.array([0, 4, 6, 7]), 7)
    assert last.tolist() == [7, 1, 2, 3, 7, 4, 7]
    assert second.tolist() == [7, 7, 1, 2, 7, 7, 7]


def test_edges(edges, clashing):
    rows = lm.score(clashing.withColumn("train", F.lit(True))).collect()
    assert len(rows) == edges.count()
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    twice = [r for r in rows if r.doc_id == 5]
    assert twice[0].base_score == pytest.approx(twice[1].base_score, rel=1e-12)
    untrained = lm.score(edges.withColumn("train", F.lit(False))).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in untrained)
    assert lm.score(edges.limit(0).withColumn("train", F.lit(True))).count() == 0


@pytest.mark.parametrize("held", [lm.HELD_WORDS, 2])
def test_words_outside_the_most_frequent_have_their_own_context(spark, monkeypatch, held):
    monkeypatch.setattr(lm, "MODEL_WORDS", 2)
    monkeypatch.setattr(lm, "HELD_WORDS", held)
    learned = spark.range(200).select("id", F.lit("a a p b b q " * 5).alias("text"), F.lit(True).alias("train"))
    asked = spark.createDataFrame([(1000, "a a p b b q", False), (1001, "a a q b b p", False)], learned.schema)
    rows = lm.score(learned.unionByName(asked).withColumnRenamed("id", "doc_id")).filter("not train").collect()
    usual, swapped = (r.score for r in sorted(rows))
    assert usual > swapped + 0.5


def test_words_of_a_class_add_up_to_one():
    random = np.random.default_rng(3)
    before = random.normal(size=(9, lm.DIMENSIONS)).astype(np.float32)
    hashes = random.zipf(1.5, 5000).astype(np.uint64) % np.uint64(700)
    found, n, vectors, norm = lm.fit_class(hashes, random.integers(0, 9, 5000), before, 1)
    assert n.sum() == 5000 and len(found) == len(set(hashes.tolist()))
    weights = (n + 1)[:, None] * np.exp(vectors @ before.T)
    assert (weights.sum(axis=0) + 1) / np.exp(norm) == pytest.approx(1, abs=1e-4)


@pytest.mark.parametrize("parts", [1, 5])
def test_score_adds_up_to_one_over_all_next_words(spark, monkeypatch, parts):
    """Frequent words, those held, rare ones from the table, and for each class one word never seen."""
    monkeypatch.setattr(lm, "MODEL_WORDS", 8)
    monkeypatch.setattr(lm, "HELD_WORDS", 20)
    random = np.random.default_rng(6)
    texts = [" ".join(f"w{min(w, 60)}" for w in random.zipf(1.3, 30)) for _ in range(200)]
    if parts > 1:
        monkeypatch.setattr(lm, "CLASS_TOKENS", 100)
        monkeypatch.setattr(lm, "MERGED", 2)
    kept = {}
    for name in ("vocabulary", "tables"):
        own = getattr(lm, name)
        monkeypatch.setattr(lm, name, lambda *a, own=own, name=name: kept.setdefault(name, own(*a)))
    seen = sorted({w for t in texts for w in t.split()})
    hash_of = lambda w: lm.tokens(pa.array([w]))[0][:1]
    classes = lm.class_count(len(seen) + 1 - 8)
    unseen = {}
    for i in range(1000):
        unseen.setdefault(int(lm.class_numbers(hash_of(f"new{i}"), classes)[0]), f"new{i}")
    assert len(unseen) == classes > 1
    words = [*seen, *unseen.values()]
    rows = [(i, t, True) for i, t in enumerate(texts)] + [(1000 + i, f"w2 {w}", False) for i, w in enumerate(words)]
    frame = spark.createDataFrame([*rows, (5000, "w2", False)], "doc_id long, text string, train boolean")
    score = {r.doc_id: r.score * np.log(10) for r in lm.score(frame).collect()}
    known, norms = kept["vocabulary"], kept["tables"]
    assert (known.class_tokens.sum() > 500) and known.class_tokens.sum() == known.total - np.sort(known.counts)[-8:].sum()
    unit = lambda h: known.find(h)[1]
    end, first, start = unit(np.array([lm.END])), unit(hash_of("w2")), np.array([len(known.shares)])
    assert end[0] < known.known

    def ends(last, second):
        return float(norms.log_probabilities(last, second, end)[0])

    log_first = score[5000] - ends(first, start)
    total = sum(np.exp(score[1000 + i] - log_first - ends(unit(hash_of(w)), first)) for i, w in enumerate(words))
    # An end right away is the last thing that can follow.
    assert total + np.exp(ends(first, start)) == pytest.approx(1, abs=1e-4)


def test_parts_of_a_class_keep_counts_and_average_vectors():
    random = np.random.default_rng(9)
    hashes = [random.integers(0, 40, 300).astype(np.uint64) for _ in range(3)]
    made = [lm.learn_class(h, random.integers(0, 5, 300), random.normal(size=(5, lm.DIMENSIONS)).astype(np.float32), i) for i, h in enumerate(hashes)]
    found, n, vectors = lm.merge_class(made)
    every = np.concatenate(hashes)
    assert found.tolist() == sorted(set(every.tolist())) and n.tolist() == [int((every == f).sum()) for f in found]
    for f, v in zip(found, vectors, strict=True):
        parts = [(c[w == f][0], x[w == f][0]) for w, c, x in made if (w == f).any()]
        assert v == pytest.approx(sum(c * x for c, x in parts) / sum(c for c, _ in parts), abs=1e-5)


def test_classes_grow_with_the_words():
    assert [lm.class_count(n) for n in (0, 4, 400_000, 40_000_000, 10**11)] == [1, 1, 317, 3163, 4096]


def test_many_small_partitions_learn_as_much_as_few(spark):
    text = F.concat_ws(" ", *[F.when(F.col("id") % 2 == 0, "a b c d").otherwise("e f g h")] * 30)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), text.alias("text"), (F.col("id") % 5 != 0).alias("train"))

    def gain(parts):
        row = lm.score(docs.repartition(parts)).filter("not train").agg(F.sum("score"), F.sum("base_score")).first()
        return row[0] - row[1]

    few, many = gain(2), gain(64)
    assert many > 0.8 * few > 0
