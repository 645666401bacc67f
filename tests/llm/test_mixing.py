from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.llm import mixing
from quernstone.llm.queries import PLANS


def targets(sizes: dict, weights=(3, 1, 2)) -> dict:
    """Shares by weight, cut at twice the source, the excess shared again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = budget - sum(2 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return {s: share.get(s, 2.0 * sizes[s]) for s in names}
        full |= over


def test_documents_against_definition(spark, sf_dir):
    got = PLANS["op1_mix_to_targets"].query(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    size = {d.doc_id: len((d.text or "").encode().split()) for d in docs}
    source = {d.doc_id: d.source for d in docs}
    words = Counter()
    for d in docs:
        words[d.source] += size[d.doc_id]
    wanted, taken = targets(words), defaultdict(int)
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(size)
    for r in rows:
        assert r.size == size[r.doc_id] and r.source_size == words[source[r.doc_id]]
        assert abs(r.target - wanted[source[r.doc_id]]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source[r.doc_id]] += r.taken
    for s in words:
        rounds, left = divmod(int(wanted[s] + 0.5), words[s])
        reach = 1
        for i in size:
            if source[i] == s:
                reach |= reach << size[i]
        # No choice of whole documents within the budget holds more words.
        assert taken[s] == rounds * words[s] + (reach & ((2 << left) - 1)).bit_length() - 1
    again = PLANS["op1_mix_to_targets"].query(spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


@pytest.mark.parametrize("documents", [200, 600, 5_000, 50_000])
@pytest.mark.parametrize("share", [0.1, 0.2, 0.5, 0.8, 0.95])
def test_every_third_of_the_lengths_has_its_share(documents, share):
    """The same kind of mix from small and large sources: no switch by size."""
    draw = random.Random(documents)
    counts = Counter(draw.randrange(5, 400) for _ in range(documents))
    lengths = sorted(counts)
    goal = int(share * sum(a * b for a, b in counts.items()))
    rounds, more = mixing.fit_lengths(lengths, [counts[a] for a in lengths], goal)
    assert rounds == 0 and all(0 <= m <= counts[a] for a, m in zip(lengths, more, strict=True))
    assert goal - 400 < sum(a * m for a, m in zip(lengths, more, strict=True)) <= goal
    ascending = [(a, k < m) for a, m in zip(lengths, more, strict=True) for k in range(counts[a])]
    for third in range(3):
        some = ascending[third * documents // 3 : (third + 1) * documents // 3]
        assert abs(sum(taken for _, taken in some) / len(some) - share) < 0.10


@pytest.mark.parametrize("seed", range(30))
def test_few_or_very_long_documents_come_near(seed):
    draw = random.Random(seed)
    counts = Counter(int(10 ** draw.uniform(0, 6)) for _ in range(draw.choice([1, 2, 5, 30, 300])))
    lengths = sorted(counts)
    everything = sum(a * b for a, b in counts.items())
    goal = int(draw.uniform(0, 2) * everything)
    rounds, more = mixing.fit_lengths(lengths, [counts[a] for a in lengths], goal)
    assert all(0 <= m <= counts[a] for a, m in zip(lengths, more, strict=True))
    words = rounds * everything + sum(a * m for a, m in zip(lengths, more, strict=True))
    left = [a for a, m in zip(lengths, more, strict=True) if m < counts[a]]
    assert words <= goal and (not left or goal - words < max(left))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), min_size=1, max_size=6), st.integers(0, 150))
def test_fill_is_the_best_sum(counts, budget):
    lengths = sorted(counts)
    reach = {0}
    for a in lengths:
        reach = {r + k * a for r in reach for k in range(counts[a] + 1)}
    taken, total = mixing.fill(lengths, [counts[a] for a in lengths], budget)
    assert total == max(r for r in reach if r <= budget) == sum(a * n for a, n in taken.items())
    assert all(n <= counts[a] for a, n in taken.items())


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 9000), st.integers(1, 400), min_size=3, max_size=40), st.floats(0, 2))
def test_fitted_lengths_stay_within_counts_and_near_the_goal(counts, share):
    lengths = sorted(counts)
    held = [counts[a] for a in lengths]
    everything = sum(a * b for a, b in zip(lengths, held, strict=True))
    goal = int(everything * share)
    rounds, more = mixing.fit_lengths(lengths, held, goal)
    assert all(0 <= m <= b for m, b in zip(more, held, strict=True)) and rounds <= 2
    words = rounds * everything + sum(a * m for a, m in zip(lengths, more, strict=True))
    assert abs(words - goal) <= lengths[0] + max(lengths) * (len(lengths) < 8)


def test_edges(edges, clashing):
    rows = mixing.mix(clashing).collect()
    assert len(rows) == edges.count()
    assert all(r.copies == 0 for r in rows if r.size == 0)
    assert {r["size"] for r in rows} >= {0, 6, 30_000}
    repeated = mixing.repeat_by_mix(clashing)
    assert repeated.columns == clashing.columns
    assert repeated.count() == sum(r.copies for r in rows)
    assert mixing.mix(edges.limit(0)).count() == 0
    assert mixing.repeat_by_mix(edges.limit(0)).count() == 0


def test_hot_length_is_cut_inside_a_slice(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 64)
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 3000, "x").otherwise("y").alias("source")
    )
    rows = mixing.mix(docs, weights=(1, 1, 1)).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")), F.max("target"))
    assert all(abs(r[1] - r[2]) <= 3 for r in rows.collect())
