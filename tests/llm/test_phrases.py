from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from oracle import connect, differences

from quernstone.llm import bloom, phrases
from quernstone.llm.queries import PLANS


def pieces(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall("[^ \t]+", piece) for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower)]


def counts_of(rows, most):
    counts = Counter()
    for lang, text in rows:
        for words in pieces(text):
            for m in range(1, most + 1):
                for i in range(len(words) - m + 1):
                    counts["und" if lang is None else lang, tuple(words[i : i + m])] += 1
    return counts


def brute(rows, most=3, least=10, percent=50, top=2000):
    counts = counts_of(rows, most)
    n = Counter()
    for (lang, words), f in counts.items():
        n[lang] += f * (len(words) == 1)
    found = {k: a for k, a in counts.items() if len(k[1]) >= 2 and a >= least}
    covered = set()
    for (lang, words), f in found.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                part = (lang, words[i : i + m])
                if 100 * f >= percent * found[part]:
                    covered.add(part)
    out = {}
    for (lang, words), a in found.items():
        if (lang, words) in covered:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return [
        (lang, rank, phrase.decode(), -a, left, right, n[lang], -score)
        for lang, some in out.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(some)[:top], 1)
    ]


def test_documents_against_sql_and_brute_force(spark, sf_dir):
    plan = PLANS["op11_phrase_collocations"]
    got = plan.query(spark, sf_dir)
    assert differences(got, connect(sf_dir), plan.sql) == []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert sorted(map(tuple, got.collect())) == sorted(brute([(d.lang, d.text) for d in docs]))


def drawn(seed, number=400):
    draw = random.Random(seed)
    vocabulary = ["a", "B", "c", "é", "漢", "x-y", "Z z", "d", "e"]
    rows = []
    for i in range(number):
        words = draw.choices(vocabulary, [2.0**-k for k in range(9)], k=draw.randrange(20))
        text = "".join(w + draw.choice([" ", " ", "  ", "\t", " \t", ". ", ",", "\n", ":"]) for w in words)
        rows.append((draw.choice([i, 7, None]), draw.choice(["en", "de", None, "und"]), draw.choice([text, text, None, ""])))
    return rows


# Shares and thresholds of the sample: nothing proposed, chance, nearly all proposed.
@pytest.mark.parametrize("share, lowered", [(0.0, 0.8), (0.02, 0.1), (0.25, 0.8), (1.0, 0.0), (0.5, 40.0)])
def test_every_sample_gives_the_same(spark, share, lowered):
    rows = drawn(3)
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    got = phrases.collocations(frame, most_words=4, least=5, top=30, share=share, lowered=lowered)
    want = brute([r[1:] for r in rows], 4, 5, top=30)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 40


def test_filters_in_slices_and_full_ones(spark, monkeypatch):
    rows = drawn(4)
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    want = sorted(brute([r[1:] for r in rows], 3, 4))
    monkeypatch.setattr(bloom, "LEAST_BITS", 5)
    monkeypatch.setattr(bloom, "MOST_BITS", 9)
    filters = bloom.Filter(frame.limit(0), 200)
    assert (filters.bits, filters.split) == (9, 3)
    assert sorted(map(tuple, phrases.collocations(frame, least=4, share=0.1).collect())) == want
    # Every cell taken: all phrases pass.
    monkeypatch.setattr(bloom, "CELLS", 1)
    monkeypatch.setattr(bloom, "LEAST_BITS", 3)
    monkeypatch.setattr(bloom, "MOST_BITS", 3)
    assert sorted(map(tuple, phrases.collocations(frame, least=4, share=0.01).collect())) == want


def test_counts_are_those_of_all_frequent_phrases(spark):
    rows = drawn(5)
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = phrases.with_words(frame, phrases.frequent_phrases(frame, 3, 6))
    want = {(lang, " ".join(w)): f for (lang, w), f in counts_of([r[1:] for r in rows], 3).items() if f >= 6}
    assert {(r.lang, r.phrase): r.n for r in got.filter("words > 0").collect()} == want


def test_edges_and_clashing_names(spark, edges, clashing):
    assert sorted(map(tuple, phrases.collocations(clashing).collect())) == sorted(
        brute([(r.lang, r.text) for r in edges.collect()])
    )
    named = edges.selectExpr("*", "1 AS phrase", "2 AS lang_key", "3 AS bucket", "4 AS draw", "5 AS hash", "6 AS _lang")
    assert {r.phrase for r in phrases.collocations(named).collect()} == {"word word word"}
    assert phrases.collocations(edges.limit(0)).count() == 0
    assert phrases.collocations(edges.filter("doc_id IN (2, 3, 4)")).count() == 0
    with pytest.raises(ValueError):
        phrases.collocations(edges, least=0)


def test_products_beyond_64_bits(spark):
    big = [(3_000_000_000, 3_000_000_001, 3_000_000_003), (10**13, 10**13 + 7, 10**13)]
    frame = spark.createDataFrame(big, "a long, l long, r long")
    got = [r[0] for r in frame.select(phrases.exact_score("a", "l", "r")).collect()]
    assert got == [1_000_000 * a * a // (left * right) for a, left, right in big]


def test_filter_holds_what_it_was_given(spark):
    hashes = np.random.default_rng(1).integers(0, 2**63, 5000)
    frame = spark.createDataFrame([(int(h),) for h in hashes[:2500]], "hash long").repartition(3)
    held = bloom.Filter(frame, 2500)
    passes = held.load(0).passes(hashes.astype(np.uint64))
    assert passes[:2500].all() and passes[2500:].mean() < 0.02


def test_phrases_summed_in_many_ranges_and_parts(spark, monkeypatch):
    rows = drawn(6)
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    monkeypatch.setattr(phrases, "HELD", 50)
    monkeypatch.setattr(phrases, "RANGE_BYTES", 500)
    got = phrases.collocations(frame, most_words=6, least=3)
    assert sorted(map(tuple, got.collect())) == sorted(brute([r[1:] for r in rows], 6, 3))
    # No row per phrase is made around longer ones.
    made = got._jdf.queryExecution().optimizedPlan().toString().count("Generate ")
    assert made == 1


def test_sums_tell_phrases_of_one_hash_apart():
    draw = np.random.default_rng(2)
    hashes, checks = draw.integers(0, 9, 500).astype(np.uint64), draw.integers(0, 4, 500).astype(np.uint32)
    n, bucket = draw.integers(1, 2**40, 500), draw.integers(0, 256, 500).astype(np.uint8)
    want = {}
    for h, c, k, b in zip(*(x.tolist() for x in (hashes, checks, n, bucket)), strict=True):
        total, least = want.get((h, c), (0, 256))
        want[h, c] = total + k, min(least, b)
    got = list(zip(*(x.tolist() for x in phrases._summed(hashes, checks, n, bucket)), strict=True))
    assert {r[:2]: r[2:] for r in got} == want and len(got) == len(want)
