from __future__ import annotations

import hashlib
import random
from functools import reduce

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import bloom, substring
from quernstone.llm.queries import PLANS


def brute(rows, window):
    tokens = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, words in tokens:
        for k in range(len(words) - window + 1):
            run = tuple(words[k : k + window])
            if i is not None and i <= least.get(run, i):
                least[run] = i
    out = []
    for i, words in tokens:
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            first = least.get(tuple(words[k : k + window]))
            if first is not None and (i is None or first < i):
                gone[k : k + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
        out.append((i, len(words), sum(gone), kept))
    return out


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = {
        (i, n, gone, hashlib.sha256(kept.encode()).hexdigest())
        for i, n, gone, kept in brute([(d.doc_id, d.text) for d in docs], 50)
    }
    got = PLANS["op8_repeated_passages"].query(spark, sf_dir).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(docs)
    assert sum(r.n_removed for r in got) > 0


@pytest.mark.parametrize("bits", [None, 8])
def test_short_windows_and_a_full_sketch(spark, monkeypatch, bits):
    if bits:  # every cell is taken, so all windows pass to the exact step
        monkeypatch.setattr(substring, "LEAST_BITS", bits)
        monkeypatch.setattr(substring, "MOST_BITS", bits)
    draw = random.Random(5)
    rows = []
    for _ in range(70):
        text = None if draw.random() < 0.1 else " ".join(draw.choice("abc") for _ in range(draw.randrange(14)))
        rows.append((draw.choice([None, *range(8)]), text))
    got = substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, 4), key=key)


def test_edges(edges, clashing):
    rows = substring.deduplicate(clashing).collect()
    assert len(rows) == edges.count()
    assert {(r.n_words, r.n_removed) for r in rows if r.doc_id in (2, 3, 4)} == {(0, 0)}
    assert {(r.n_words, r.n_removed) for r in rows if r.doc_id == 7} == {(30_000, 0)}
    assert substring.deduplicate(edges.limit(0)).count() == 0


def test_few_more_windows_are_proposed_than_repeat(spark, load):
    """Whatever the size: the sketch has cells in proportion, and its filter holds what counts twice."""
    docs = load("documents").select("doc_id", "text")
    bits = []
    for times in (1, 8):
        # Other words in each copy of the table, so that no more windows repeat than within one.
        parts = [docs.select((F.col("doc_id") * 8 + i).alias("doc_id"), F.regexp_replace("text", r"(\S+)", f"$1{i}").alias("text")) for i in range(times)]
        rows = reduce(DataFrame.unionByName, parts).dropDuplicates(["text"]).withColumn("text_key", F.xxhash64("text"))
        proposed = substring.proposed_windows(rows)
        windows = proposed.groupBy("hash", "check").agg(F.countDistinct("doc_id").alias("n"))
        found = windows.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("n") > 1).alias("repeated")).first()
        total = sum(max(0, len(r.text.split()) - 49) for r in rows.filter("text IS NOT NULL").collect())
        assert 0 < found["repeated"] and found["all"] - found["repeated"] < 0.05 * total
        letters = rows.agg(F.sum(F.octet_length("text"))).first()[0]
        bits.append((substring.CELLS * letters // substring.BYTES_PER_ANCHOR).bit_length())
    assert bits[1] - bits[0] == 3


@pytest.mark.parametrize("slices", [1, 8])
def test_filter_in_slices_and_copies(spark, monkeypatch, slices):
    monkeypatch.setattr(bloom, "LEAST_BITS", 4)
    monkeypatch.setattr(bloom, "MOST_BITS", 4 if slices > 1 else 20)
    draw = random.Random(6)
    texts = [" ".join(draw.choice("abcde") for _ in range(draw.randrange(20))) for _ in range(25)]
    # Copies of whole texts, in other white space as well, with smaller, equal, larger and null ids.
    rows = [(draw.choice([None, *range(12)]), draw.choice([t, t, t.replace(" ", "\t")])) for t in texts for _ in range(3)]
    got = substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, 4), key=key)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=60), st.integers(1, 60))
def test_least_of_runs(values, width):
    width = min(width, len(values))
    want = [min(values[i : i + width]) for i in range(len(values) - width + 1)]
    assert substring._least_of(np.array(values, np.uint64), width).tolist() == want
