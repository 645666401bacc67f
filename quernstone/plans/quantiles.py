"""Exact and approximate quantiles, edges and errors over events and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions.probabilities import (
    MOST_SKETCH_SIZE,
    even_probabilities,
    sketch_size,
)
from quernstone.operators.logbuckets import log_bucket_quantiles, log_buckets, merged_buckets
from quernstone.operators.quantiles import (
    Maximum,
    Minimum,
    QuantileSketch,
    aggregate,
    approx_quantiles,
    bin_edges,
    exact_quantiles,
    mean_absolute_error,
    quantile_error,
    quantile_table,
    rank_error,
    sketch_quantiles,
)
from quernstone.plans.registry import Plans, table

PLANS = Plans()

TAIL = [0.9, 0.95, 0.99]
DECILES = even_probabilities(10)
COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]


def _quantiles_sql(source: str, columns: list[str], probabilities: list[float]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, unnest({probabilities}::DOUBLE[]) AS prob, "
        f"unnest(quantile_disc({c}, {probabilities})) AS value FROM {source}"
        for c in columns
    )


@PLANS.add(_quantiles_sql("events", ["value"], TAIL))
def exact_quantiles_tail(spark, sf_dir):
    found = exact_quantiles(table(spark, sf_dir, "events"), ["value"], TAIL)
    return quantile_table(spark, found, TAIL)


@PLANS.add(_quantiles_sql("lineitem", COLUMNS, [0.0, *DECILES, 1.0]))
def exact_quantiles_columns(spark, sf_dir):
    wanted = [0.0, *DECILES, 1.0]
    found = exact_quantiles(table(spark, sf_dir, "lineitem"), COLUMNS, wanted)
    return quantile_table(spark, found, wanted)


@PLANS.add(_quantiles_sql("events", ["value"], DECILES))
def exact_quantiles_narrowed(spark, sf_dir):
    """The same with brackets too large for one task, narrowed by exact counts."""
    found = exact_quantiles(
        table(spark, sf_dir, "events"), ["value"], DECILES, guess_size=100, window_rows=20
    )
    return quantile_table(spark, found, DECILES)


@PLANS.add(
    _quantiles_sql("(SELECT nullif(l_discount, 0) AS discount FROM lineitem)", ["discount"], TAIL)
)
def exact_quantiles_missing(spark, sf_dir):
    """Null and NaN are left out."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "CASE WHEN l_discount <> 0 THEN l_discount "
        "WHEN l_tax = 0 THEN double('NaN') END AS discount"
    )
    return quantile_table(spark, exact_quantiles(rows, ["discount"], TAIL), TAIL)


@PLANS.add("SELECT min(value) AS low, max(value) AS high FROM events")
def column_min_max(spark, sf_dir):
    found = aggregate(table(spark, sf_dir, "events"), Minimum("value"), Maximum("value"))
    return found.toDF("low", "high")


@PLANS.add(
    f"""
    SELECT CAST(unnest(range(0, 11)) AS INTEGER) AS place,
           unnest(list_concat([min(value)], quantile_disc(value, {DECILES}), [max(value)])) AS edge
    FROM events
    """
)
def bin_edges_exact(spark, sf_dir):
    edges = bin_edges(table(spark, sf_dir, "events"), "value", 10)
    return spark.createDataFrame(list(enumerate(edges)), "place int, edge double")


_EXACT = f"""
    (SELECT unnest({DECILES}::DOUBLE[]) AS prob,
            unnest(quantile_disc(value, {DECILES})) AS exact_value FROM events)
"""
REPORT_ERROR = 0.001


def _approximations(spark, sf_dir):
    """Exact deciles of all events, and both approximations of them."""
    events = table(spark, sf_dir, "events")
    exact = exact_quantiles(events, ["value"], DECILES)["value"]
    summary = approx_quantiles(events, ["value"], DECILES, REPORT_ERROR)["value"]
    sketch = sketch_quantiles(events, ["value"], DECILES, sketch_size(REPORT_ERROR))["value"]
    return events, exact, {"summary": summary, "sketch": sketch}


@PLANS.add(
    f"""
    SELECT method, prob, exact_value, TRUE AS within_bound, TRUE AS error_is_difference
    FROM {_EXACT}, (SELECT unnest(['summary', 'sketch']) AS method)
    """
)
def quantile_error_report(spark, sf_dir):
    """Summary and sketch of the whole column against its exact quantiles.

    The values of a sketch differ from run to run; its rank error is checked instead.
    """
    events, exact, found = _approximations(spark, sf_dir)
    parts = []
    for method, approx in found.items():
        errors = quantile_error(spark, DECILES, exact, approx)
        ranks = rank_error(events, "value", DECILES, approx).select("prob", "rank_error")
        difference = F.abs(F.col("abs_error") - F.abs(F.col("approx_value") - F.col("exact_value"))) < 1e-12
        parts.append(
            errors.join(ranks, "prob").select(
                F.lit(method).alias("method"),
                "prob",
                "exact_value",
                (F.col("rank_error") <= REPORT_ERROR).alias("within_bound"),
                difference.alias("error_is_difference"),
            )
        )
    return parts[0].unionByName(parts[1])


def _full_sketch_errors(spark, sf_dir):
    """A sketch that holds every value of up to twice its size has the exact quantiles."""
    events = table(spark, sf_dir, "events")
    exact = exact_quantiles(events, ["value"], DECILES)["value"]
    sketch = sketch_quantiles(events, ["value"], DECILES, MOST_SKETCH_SIZE)["value"]
    return quantile_error(spark, DECILES, exact, sketch)


@PLANS.add(
    f"SELECT prob, exact_value, exact_value AS approx_value, 0::DOUBLE AS abs_error FROM {_EXACT}"
)
def quantile_error_full_sketch(spark, sf_dir):
    """Without error while the rows are no more than the sketch holds."""
    return _full_sketch_errors(spark, sf_dir)


@PLANS.add(
    f"""
    SELECT method, TRUE AS is_mean, TRUE AS within_bound FROM (SELECT unnest(['sketch', 'summary']) AS method),
           (SELECT 1 FROM {_EXACT} LIMIT 1)
    """
)
def quantile_mean_error(spark, sf_dir):
    """The mean error of two real approximations is the mean of their reported differences, each within its bound."""
    events, exact, found = _approximations(spark, sf_dir)
    parts = []
    for method, approx in found.items():
        errors = quantile_error(spark, DECILES, exact, approx)
        mean = sum(abs(a - b) for a, b in zip(exact, approx, strict=True)) / len(DECILES)
        ranks = rank_error(events, "value", DECILES, approx).agg(F.max("rank_error").alias("worst"))
        is_mean = (F.abs(F.col("mae") - F.lit(mean)) < 1e-9).alias("is_mean")
        row = mean_absolute_error(errors).select(F.lit(1).alias("one"), is_mean)
        bound = ranks.select(F.lit(1).alias("one"), (F.col("worst") <= REPORT_ERROR).alias("within_bound"))
        parts.append(row.join(bound, "one").select(F.lit(method).alias("method"), "is_mean", "within_bound"))
    return parts[0].unionByName(parts[1])


SKETCH_ERRORS = [0.05, 0.01, 0.001]


@PLANS.add(
    f"""
    SELECT error, prob, TRUE AS within_bound FROM (SELECT unnest({SKETCH_ERRORS}::DOUBLE[]) AS error),
         (SELECT unnest({DECILES}::DOUBLE[]) AS prob)
    """
)
def sketch_error_bounds(spark, sf_dir):
    """Sketches of the sizes derived from three errors keep them."""
    events = table(spark, sf_dir, "events")
    parts = []
    for error in SKETCH_ERRORS:
        found = sketch_quantiles(events, ["value"], DECILES, sketch_size(error))["value"]
        ranks = rank_error(events, "value", DECILES, found)
        kept = (F.col("rank_error") <= error).alias("within_bound")
        parts.append(ranks.select(F.lit(error).alias("error"), "prob", kept))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_LARGE = 1 << 53


@PLANS.add(
    f"""
    SELECT 'large_id' AS column_name, unnest({[0.0, *DECILES, 1.0]}::DOUBLE[]) AS prob,
           unnest(quantile_disc(event_id * 3 + {_LARGE}, {[0.0, *DECILES, 1.0]})) AS value FROM events
    """
)
def exact_quantiles_large_integers(spark, sf_dir):
    """Integers that no double holds."""
    rows = table(spark, sf_dir, "events").select((F.col("event_id") * 3 + _LARGE).alias("large_id"))
    wanted = [0.0, *DECILES, 1.0]
    found = exact_quantiles(rows, ["large_id"], wanted)["large_id"]
    pairs = [("large_id", p, v) for p, v in zip(wanted, found, strict=True)]
    return spark.createDataFrame(pairs, "column_name string, prob double, value long")


@PLANS.add(None)
def approx_quantiles_gk(spark, sf_dir):
    found = approx_quantiles(table(spark, sf_dir, "events"), ["value"], DECILES, 0.01)
    return quantile_table(spark, found, DECILES)


@PLANS.add(None)
def approx_quantiles_kll(spark, sf_dir):
    found = sketch_quantiles(table(spark, sf_dir, "events"), ["value"], DECILES, sketch_size(0.001))
    return quantile_table(spark, found, DECILES)


def _bounded(spark, sf_dir, found, bound):
    """Whether each approximate quantile lies within the promised distance in rank."""
    events = table(spark, sf_dir, "events")
    errors = rank_error(events, "value", DECILES, found["value"])
    return errors.select("prob", (F.col("rank_error") <= bound).alias("within_bound"))


_WITHIN = f"SELECT unnest({DECILES}::DOUBLE[]) AS prob, TRUE AS within_bound"


@PLANS.add(_WITHIN)
def approx_quantiles_gk_bound(spark, sf_dir):
    """Every approximate quantile is within 1% of the rows of its rank."""
    found = approx_quantiles(table(spark, sf_dir, "events"), ["value"], DECILES, 0.01)
    return _bounded(spark, sf_dir, found, 0.0101)


@PLANS.add(_WITHIN)
def approx_quantiles_kll_bound(spark, sf_dir):
    """A sketch of size 1000 stays well within 2% of the rows."""
    found = sketch_quantiles(table(spark, sf_dir, "events"), ["value"], DECILES, 1000)
    return _bounded(spark, sf_dir, found, 0.02)


@PLANS.add(
    f"""
    SELECT unnest({DECILES}::DOUBLE[]) AS prob, low, high, TRUE AS within_bound
    FROM (SELECT min(value) AS low, max(value) AS high FROM events)
    """
)
def aggregate_one_pass(spark, sf_dir):
    """A sketch, minimum and maximum in one scan; the sketch's values are checked by their rank."""
    events = table(spark, sf_dir, "events")
    sketch = QuantileSketch("value", DECILES, sketch_size(0.01))
    row = aggregate(events, sketch, Minimum("value"), Maximum("value")).first()
    ranks = rank_error(events, "value", DECILES, row[sketch.name])
    return ranks.select(
        "prob",
        F.lit(row["min(value)"]).alias("low"),
        F.lit(row["max(value)"]).alias("high"),
        (F.col("rank_error") <= 0.01).alias("within_bound"),
    )


LOG_ERROR = 0.01
_LOG_BASE = (1 + LOG_ERROR) / (1 - LOG_ERROR)
# Values of both signs and zero, with gaps.
_SIGNED = "SELECT CASE WHEN event_id % 9 = 0 THEN 0 WHEN event_id % 3 = 0 THEN -value WHEN event_id % 17 = 0 THEN NULL ELSE value END AS x FROM events"


def _signed(spark, sf_dir):
    k = F.col("event_id")
    x = F.when(k % 9 == 0, 0.0).when(k % 3 == 0, -F.col("value")).when(k % 17 == 0, F.lit(None)).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select(k, x.alias("x"))


@PLANS.add(
    f"""
    WITH placed AS (
        SELECT CAST(sign(x) AS INTEGER) AS s,
               CASE WHEN x = 0 THEN 0 ELSE ceil(ln(abs(x)) / ln({_LOG_BASE})) END AS b
        FROM ({_SIGNED}) WHERE x IS NOT NULL
    ),
    ordered AS (
        SELECT s, b, row_number() OVER (ORDER BY s, s * b) AS rn, count(*) OVER () AS n FROM placed
    )
    SELECT 'x' AS column_name, prob, round(s * power({_LOG_BASE}, b - 1) * {2 * _LOG_BASE / (_LOG_BASE + 1)}, 6) AS value
    FROM ordered, (SELECT unnest({DECILES}::DOUBLE[]) AS prob, unnest({[round(p * 10) for p in DECILES]}) AS tenths)
    WHERE rn = greatest(1, (tenths * n + 9) // 10)
    """
)
def log_bucket_quantiles_values(spark, sf_dir):
    """The same values on every run: buckets of two halves of the rows, added up."""
    rows = _signed(spark, sf_dir)
    halves = [log_buckets(rows.filter(F.col("event_id") % 2 == i), ["x"], LOG_ERROR) for i in (0, 1)]
    found = log_bucket_quantiles(merged_buckets(*halves), DECILES, LOG_ERROR)
    return found.withColumn("value", F.round("value", 6))


@PLANS.add(f"SELECT unnest({DECILES}::DOUBLE[]) AS prob, TRUE AS within_bound")
def log_bucket_quantiles_bound(spark, sf_dir):
    """Each value is within its relative error of the exact quantile."""
    rows = _signed(spark, sf_dir)
    exact = exact_quantiles(rows, ["x"], DECILES)["x"]
    pairs = spark.createDataFrame(list(zip(DECILES, exact, strict=True)), "prob double, exact double")
    found = log_bucket_quantiles(log_buckets(rows, ["x"], LOG_ERROR), DECILES, LOG_ERROR)
    away = F.abs(F.col("value") - F.col("exact")) <= F.abs("exact") * (LOG_ERROR * (1 + 1e-9))
    return found.join(pairs, "prob").select("prob", away.alias("within_bound"))
