"""Samples: exact sizes, nesting, repeatability, skewed strata and equal keys."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import quernstone as q
from quernstone.functions.keys import hash_key
from quernstone.operators import sampling
from quernstone.sources.tables import read_nested, read_rate, write_nested, write_rates

RATES = [1, 5, 15, 50, 95, 100]


@pytest.fixture(scope="module")
def skewed(spark):
    """One stratum holds most rows, one holds a single row, one is null."""
    return spark.range(0, 5000).select(
        F.col("id").alias("k"),
        F.expr(
            "CASE WHEN id = 17 THEN 'one' WHEN id % 10 = 0 THEN NULL WHEN id % 10 = 1 THEN 'b' "
            "ELSE 'big' END"
        ).alias("s"),
    )


def by_hand(rows, percent, seed):
    """Per stratum, the first ceil(percent * n / 100) keys in the order of their hash."""
    strata: dict = {}
    for row in rows:
        strata.setdefault(row["s"], []).append(row["k"])
    kept = set()
    for keys in strata.values():
        ordered = sorted(keys, key=lambda k: hashlib.md5(f"{seed}|{len(str(k))}:{k}".encode()).hexdigest())
        kept |= set(ordered[: math.ceil(percent * len(keys) / 100)])
    return kept


@pytest.mark.parametrize("bounds", [{}, {"broadcast_rows": 0}, {"slice_rows": 0}])
def test_sample_by_hand(skewed, bounds):
    found = q.stratified_sample(skewed, ["s"], ["k"], 7, 3, **bounds)
    assert found.columns == skewed.columns
    assert {r["k"] for r in found.collect()} == by_hand(skewed.collect(), 7, 3)


def test_small_slices(skewed):
    """Slices of any size lead to the same cut."""
    found = q.stratified_sample(skewed, ["s"], ["k"], 50, 3, slice_rows=1)
    assert {r["k"] for r in found.collect()} == by_hand(skewed.collect(), 50, 3)


def test_samples_nest(skewed):
    nested = q.nested_samples(skewed, ["s"], ["k"], RATES, 3).collect()
    assert len(nested) == 5000
    rows = skewed.collect()
    for rate in RATES:
        assert {r["k"] for r in nested if r["first_rate"] <= rate} == by_hand(rows, rate, 3)


def test_sample_depends_on_the_data_alone(skewed):
    a = q.stratified_sample(skewed, ["s"], ["k"], 15, 3)
    b = q.stratified_sample(skewed.repartition(23), ["s"], ["k"], 15, 3)
    assert {r["k"] for r in a.collect()} == {r["k"] for r in b.collect()}
    other = q.stratified_sample(skewed, ["s"], ["k"], 15, 4)
    assert {r["k"] for r in a.collect()} != {r["k"] for r in other.collect()}


@pytest.mark.parametrize("slice_rows", [100, 1_000_000])
def test_rows_sharing_a_key_stay_together(spark, slice_rows):
    """A third of the rows are copies of one key."""
    rows = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"),
        F.lit("x").alias("s"),
        F.col("id"),
    )
    sample = q.stratified_sample(rows, ["s"], ["k"], 20, 3, slice_rows=slice_rows)
    counts = Counter(r["k"] for r in sample.collect())
    full = Counter(r["k"] for r in rows.collect())
    assert all(counts[k] == full[k] for k in counts)
    assert 600 <= sum(counts.values()) <= 600 + 1000
    everything = q.stratified_sample(rows, ["s"], ["k"], 100, 3, slice_rows=slice_rows)
    assert everything.count() == 3000


def test_empty_table_and_bad_rates(spark, skewed):
    assert q.stratified_sample(skewed.limit(0), ["s"], ["k"], 5).count() == 0
    for wrong in ([], [0], [101], [2.5]):
        with pytest.raises(ValueError):
            q.nested_samples(skewed, ["s"], ["k"], wrong)


def test_several_strata_columns(skewed):
    rows = skewed.withColumn("half", F.col("k") % 2)
    sample = q.stratified_sample(rows, ["s", "half"], ["k"], 10, 3)
    sizes = Counter((r["s"], r["half"]) for r in rows.collect())
    kept = Counter((r["s"], r["half"]) for r in sample.collect())
    assert kept == {g: math.ceil(n / 10) for g, n in sizes.items()}


def test_hash_sample_nests_and_holds_its_rate(spark):
    rows = spark.range(0, 20_000)
    small = {r["id"] for r in q.hash_sample(rows, ["id"], 5, 1).collect()}
    large = {r["id"] for r in q.hash_sample(rows.repartition(7), ["id"], 15, 1).collect()}
    assert small < large
    assert abs(len(large) - 3000) < 5 * math.sqrt(3000)
    assert q.hash_sample(rows, ["id"], 100, 1).count() == 20_000
    assert q.hash_sample(rows, ["id"], 0, 1).count() == 0
    with pytest.raises(ValueError):
        q.hash_sample(rows, ["id"], 101)


def test_hash_sample_by_stratum(skewed):
    found = q.hash_sample_by(skewed, "s", {"b": 100, None: 0, "one": 100}, ["k"], 1)
    assert Counter(r["s"] for r in found.collect()) == {"b": 500, "one": 1}


def test_random_draw_keeps_about_the_fraction(skewed):
    n = q.random_sample_by(skewed, "s", {"big": 0.5}, 1).count()
    assert 1700 < n < 2300


def test_family_of_tables(skewed, spark, tmp_path):
    nested = q.nested_samples(skewed, ["s"], ["k"], [5, 15, 25], 3)
    write_nested(nested, str(tmp_path / "nested"))
    write_rates(nested, str(tmp_path / "rates"), [5, 15])
    rows = skewed.collect()
    for rate in (5, 15):
        expected = by_hand(rows, rate, 3)
        one = read_nested(spark, str(tmp_path / "nested"), rate, ["k"])
        other = read_rate(spark, str(tmp_path / "rates"), rate, ["k"])
        assert {r["k"] for r in one.collect()} == {r["k"] for r in other.collect()} == expected


def test_large_slices_are_split_until_small():
    assert sampling._next_digits(3, 10, 1_000_000) == 32
    assert sampling._next_digits(3, 240_000_000, 1_000_000) == 5
    assert sampling._next_digits(3, 10**12, 1) == 8
    assert sampling._next_digits(31, 10**12, 1) == 32


def test_different_keys_have_different_hashes(spark):
    pairs = [("a|b", "c"), ("a", "b|c"), (None, "q"), ("q", None), ("-", None), (None, "-"), ("", ""), (None, None), ("1:a", ""), ("", "1:a")]
    rows = spark.createDataFrame(pairs, "x string, y string")
    hashes = [r.h for r in rows.select(hash_key(1, "x", "y").alias("h")).collect()]
    assert len(set(hashes)) == len(pairs)
