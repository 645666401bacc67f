"""Exact quantiles against sorting by hand; approximate ones against their promised error."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import quernstone as q
from quernstone.functions.probabilities import (
    even_probabilities,
    rank_of,
    sketch_error,
    sketch_size,
)
from quernstone.operators import quantiles as quantile_operators

DECILES = even_probabilities(10)


def as_table(spark, values, partitions=3):
    return spark.createDataFrame([(v,) for v in values], "v double").repartition(partitions)


def by_hand(values, probabilities):
    kept = sorted(v for v in values if v is not None and not math.isnan(v))
    if not kept:
        return [None] * len(probabilities)
    ranks = [max(1, math.ceil(Fraction(str(p)) * len(kept))) for p in probabilities]
    return [kept[r - 1] for r in ranks]


def test_ranks():
    assert rank_of(0.07, 100) == 7
    assert rank_of(0.0, 10) == 1
    assert rank_of(1.0, 10) == 10
    assert rank_of(0.7, 10) == 7
    assert rank_of(5 / 7, 70) == 50
    assert rank_of(0.1, 10**13) == 10**12
    for n in (2, 3, 7, 10, 97):
        assert [rank_of(p, 1000 * n) for p in even_probabilities(n)] == [
            1000 * i for i in range(1, n)
        ]


def test_probabilities_and_sketch_sizes():
    assert even_probabilities(4) == [0.25, 0.5, 0.75]
    assert sketch_size(1.0) == 8
    for error in (0.1, 0.01, 0.001, 0.0002):
        size = sketch_size(error)
        assert sketch_error(size) <= error < sketch_error(size - 1)
    with pytest.raises(ValueError, match="no sketch"):
        sketch_size(1e-5)
    for size in (7, 65_536):
        with pytest.raises(ValueError, match="sketch sizes"):
            q.QuantileSketch("v", [0.5], size)
    with pytest.raises(ValueError):
        even_probabilities(1)
    with pytest.raises(ValueError):
        sketch_size(0)


@settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.one_of(
            st.none(),
            st.just(float("nan")),
            st.integers(-3, 3).map(float),
            st.floats(allow_nan=False, allow_infinity=False, width=32),
        ),
        max_size=60,
    )
)
def test_exact_equals_sorting(spark, values):
    wanted = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    found = q.exact_quantiles(as_table(spark, values), ["v"], wanted)["v"]
    assert found == by_hand(values, wanted)


def test_exact_with_one_value_filling_a_third(spark):
    rng = random.Random(3)
    values = [42.0] * 2000 + [rng.gauss(40, 30) for _ in range(4000)]
    table = as_table(spark, values, 5)
    assert q.exact_quantiles(table, ["v"], DECILES)["v"] == by_hand(values, DECILES)
    narrowed = q.exact_quantiles(table, ["v"], DECILES, guess_size=100, window_rows=3)
    assert narrowed["v"] == by_hand(values, DECILES)


def test_exact_finds_a_rank_outside_its_bracket(spark, monkeypatch):
    """Whatever the guess was, the counts put it right."""
    values = [float(i * i % 997) for i in range(3000)]
    table = as_table(spark, values)

    def wrong(df, columns, probabilities, size):
        return {c: [5.0 + (i % 2) for i, _ in enumerate(probabilities)] for c in columns}

    monkeypatch.setattr(quantile_operators, "sketch_quantiles", wrong)
    assert q.exact_quantiles(table, ["v"], DECILES)["v"] == by_hand(values, DECILES)
    few = q.exact_quantiles(table, ["v"], DECILES, window_rows=10)["v"]
    assert few == by_hand(values, DECILES)


def test_exact_of_infinite_and_empty_columns(spark):
    values = [float("-inf"), 1.0, 2.0, float("inf"), None]
    found = q.exact_quantiles(as_table(spark, values), ["v"], [0.25, 0.5, 1.0])["v"]
    assert found == [float("-inf"), 1.0, float("inf")]
    table = spark.createDataFrame([(1.0, None), (2.0, float("nan"))], "a double, b double")
    found = q.exact_quantiles(table, ["a", "b"], [0.5])
    assert found == {"a": [1.0], "b": [None]}
    assert q.exact_quantiles(table.limit(0), ["a"], [0.5]) == {"a": [None]}


def test_integer_columns_and_partitions(load):
    rows = load("lineitem").select("l_linenumber", "l_quantity")
    columns = ["l_linenumber", "l_quantity"]
    once = q.exact_quantiles(rows, columns, DECILES)
    assert once == q.exact_quantiles(rows.repartition(11), columns, DECILES)
    assert once["l_quantity"] == rows.approxQuantile("l_quantity", DECILES, 0.0)


@pytest.mark.parametrize("error", [0.1, 0.05, 0.01, 0.001])
def test_summary_keeps_its_bound(load, error):
    events = load("events")
    found = q.approx_quantiles(events, ["value"], DECILES, error)["value"]
    worst = max(r["rank_error"] for r in q.rank_error(events, "value", DECILES, found).collect())
    assert worst <= error + 1 / events.count()


def test_zero_error_is_exact(load):
    events = load("events")
    exact = q.exact_quantiles(events, ["value"], DECILES)
    assert q.approx_quantiles(events, ["value"], DECILES, 0) == exact


def test_sketch_error_falls_as_it_grows(load):
    events = load("events")
    exact = q.exact_quantiles(events, ["value"], DECILES)["value"]
    spark = events.sparkSession

    def mean_error(size):
        found = q.sketch_quantiles(events, ["value"], DECILES, size)["value"]
        errors = q.quantile_error(spark, DECILES, exact, found)
        return q.mean_absolute_error(errors).first()["mae"]

    small = [mean_error(8) for _ in range(3)]
    large = [mean_error(5000) for _ in range(3)]
    assert sum(large) < sum(small)


def test_aggregates_share_a_row(spark):
    rows = [(1.0, None), (2.0, None), (float("nan"), None)]
    table = spark.createDataFrame(rows, "a double, b double")
    row = q.aggregate(
        table.repartition(3),
        q.QuantileSketch("a", [0.5, 1.0], 100),
        q.Minimum("a"),
        q.Maximum("a"),
        q.QuantileSketch("b", [0.5], 100),
        q.Maximum("b"),
    ).first()
    assert row["approx_quantile(a)"] == [1.0, 2.0]
    assert (row["min(a)"], row["max(a)"]) == (1.0, 2.0)
    assert row["approx_quantile(b)"] is None and row["max(b)"] is None
    assert q.sketch_quantiles(table, ["b"], [0.1, 0.2], 10) == {"b": [None, None]}


@pytest.mark.parametrize("method", ["exact", "summary", "sketch"])
def test_edges(spark, method):
    table = as_table(spark, [float(i) for i in range(101)] + [float("nan")])
    edges = q.bin_edges(table, "v", 4, method, 0.001)
    assert edges[0] == 0.0 and edges[-1] == 100.0
    assert edges[1:-1] == pytest.approx([25.0, 50.0, 75.0], abs=1)
    assert q.bin_edges(table.limit(0), "v", 4, method, 0.001) == []
    with pytest.raises(ValueError):
        q.quantiles_by(table, ["v"], [0.5], "guess")


def test_rank_error_of_repeated_values(spark):
    table = as_table(spark, [1.0] * 50 + [2.0] * 50)
    rows = q.rank_error(table, "v", [0.25, 0.75, 0.9], [1.0, 2.0, 1.0]).collect()
    assert [round(r["rank_error"], 9) for r in rows] == [0.0, 0.0, 0.4]


@pytest.mark.parametrize("window_rows", [1_000_000, 5])
def test_exact_types_stay_exact(spark, window_rows):
    base = 1 << 53
    rows = spark.range(1, 101).selectExpr(
        f"id + {base} AS whole", f"CAST(id + {base} AS DECIMAL(30, 3)) / 1000 AS exact", "id / 7 AS plain"
    )
    found = q.exact_quantiles(rows, ["whole", "exact", "plain"], [0.0, 0.5, 0.51, 1.0], window_rows=window_rows)
    assert found["whole"] == [base + 1, base + 50, base + 51, base + 100]
    assert [int(v * 1000) for v in found["exact"]] == found["whole"]
    assert found["plain"][1] == 50 / 7
