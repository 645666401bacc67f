"""Equal-frequency and custom binning, bucket counts, and binning on a stream."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from quernstone.functions.probabilities import even_probabilities
from quernstone.operators.binning import (
    CustomBinner,
    QuantileDiscretizer,
    actual_bucket_count,
    bucket_distribution,
    distinct_buckets,
)
from quernstone.operators.quantiles import bin_edges
from quernstone.operators.scaling import StandardScaler
from quernstone.plans.registry import Plans, table
from quernstone.streaming.scoring import apply_steps, running_bucket_counts
from quernstone.support.cut import scratch_path

PLANS = Plans()

DECILES = even_probabilities(10)
TWENTIETHS = even_probabilities(20)
EDGES = [1.0, 5.0, 25.0, 100.0, 300.0]


_FITTED = f"(SELECT quantile_disc(value, {DECILES}) AS inner_edges FROM events)"
_LEFT = f"""
    SELECT event_id,
           CAST(len(list_filter(list_distinct(inner_edges), lambda e: value >= e)) AS INTEGER)
               AS value_bucket
    FROM events, {_FITTED}
"""


def _exact_deciles(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    return QuantileDiscretizer(["value"], method="exact").fit_transform(events)


@PLANS.add(_LEFT)
def quantile_discretize_left(spark, sf_dir):
    return _exact_deciles(spark, sf_dir).select("event_id", "value_bucket")


_SPLITS = " UNION ALL ".join(
    f"""
    SELECT '{c}' AS column_name, CAST(row_number() OVER (ORDER BY edge) AS INTEGER) AS place, edge
    FROM (SELECT DISTINCT unnest(quantile_disc({c}, {DECILES})) AS edge FROM lineitem)
    """
    for c in ("l_quantity", "l_discount")
)


@PLANS.add(_SPLITS)
def quantile_discretizer_fit(spark, sf_dir):
    """Distinct inner splits of two columns fitted together."""
    columns = ["l_quantity", "l_discount"]
    rows = table(spark, sf_dir, "lineitem").select(*columns)
    model = QuantileDiscretizer(columns, method="exact").fit(rows)
    found = [
        (c, i, edge) for c in columns for i, edge in enumerate(model.splits[c][1:-1], start=1)
    ]
    return spark.createDataFrame(found, "column_name string, place int, edge double")


@PLANS.add(
    f"""
    WITH gaps AS (
        SELECT event_id, CASE WHEN value >= 10 THEN value END AS v, value < 5 AS nan_row
        FROM events
    ),
    fitted AS (SELECT list_distinct(quantile_disc(v, {DECILES})) AS edges FROM gaps)
    SELECT event_id,
           CAST(CASE WHEN nan_row THEN len(edges) + 1
                     WHEN v IS NOT NULL THEN len(list_filter(edges, lambda e: v >= e)) END
                AS INTEGER) AS v_bucket
    FROM gaps, fitted
    """
)
def quantile_discretize_keep_missing(spark, sf_dir):
    """A null keeps a null bucket, NaN gets a bucket of its own."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "CASE WHEN value >= 10 THEN value WHEN value < 5 THEN double('NaN') END AS v",
    )
    step = QuantileDiscretizer(["v"], method="exact", invalid="keep")
    return step.fit_transform(rows).select("event_id", "v_bucket")


def _cut_sql(value: str, edges: list[float], lower: str) -> str:
    cases = " ".join(
        f"WHEN {value} <= {b} THEN {i}" for i, b in enumerate(edges[1:])
    )
    return f"CAST(CASE WHEN {value} {lower} {edges[0]} THEN NULL {cases} END AS INTEGER)"


@PLANS.add(f"SELECT event_id, {_cut_sql('value', EDGES, '<=')} AS value_bucket FROM events")
def custom_bins_right(spark, sf_dir):
    """Given edges, intervals (a, b]; values outside get no bucket."""
    step = CustomBinner({"value": EDGES}, invalid="keep")
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    return step.transform(rows).select("event_id", "value_bucket")


_QUANTITY_EDGES = [1.0, 10.0, 20.0, 50.0]


@PLANS.add(
    f"SELECT l_orderkey, {_cut_sql('l_quantity', _QUANTITY_EDGES, '<')} AS bin FROM lineitem"
)
def custom_bins_include_lowest(spark, sf_dir):
    step = CustomBinner({"l_quantity": _QUANTITY_EDGES}, ["bin"], include_lowest=True)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    return step.transform(rows).select("l_orderkey", "bin")


@PLANS.add(
    """
    SELECT l_orderkey,
           CAST(CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 20 THEN 1 ELSE 2 END
                AS INTEGER) AS bin
    FROM lineitem
    """
)
def custom_bins_left(spark, sf_dir):
    """Given edges, intervals [a, b), the last one closed."""
    step = CustomBinner({"l_quantity": _QUANTITY_EDGES}, ["bin"], closed="left")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    return step.transform(rows).select("l_orderkey", "bin")


@PLANS.add(
    f"""
    SELECT event_id, {_cut_sql('value', EDGES, '<=')} AS value_bucket FROM events
    WHERE value > {EDGES[0]} AND value <= {EDGES[-1]}
    """
)
def custom_bins_skip_outside(spark, sf_dir):
    step = CustomBinner({"value": EDGES}, invalid="skip")
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    return step.transform(rows).select("event_id", "value_bucket")


_REPEATED = f"""
    WITH fitted AS (
        SELECT list_sort(list_distinct(list_concat(
                   [min(l_discount)], quantile_disc(l_discount, {TWENTIETHS}), [max(l_discount)]
               ))) AS edges
        FROM lineitem
    ),
    binned AS (
        SELECT l_orderkey,
               CAST(greatest(len(list_filter(edges, lambda e: l_discount > e)) - 1, 0)
                    AS INTEGER) AS l_discount_bucket
        FROM lineitem, fitted
    )
"""


def _repeated_edges(spark, sf_dir):
    """Twenty equal-frequency bins of a column with eleven values: most edges repeat."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount")
    edges = bin_edges(rows, "l_discount", 20)
    step = CustomBinner({"l_discount": edges}, include_lowest=True, duplicates="drop")
    return step.transform(rows)


@PLANS.add(f"{_REPEATED} SELECT l_orderkey, l_discount_bucket FROM binned")
def custom_bins_dup_edges(spark, sf_dir):
    return _repeated_edges(spark, sf_dir).select("l_orderkey", "l_discount_bucket")


@PLANS.add(f"{_REPEATED} SELECT DISTINCT l_discount_bucket FROM binned")
def distinct_buckets_used(spark, sf_dir):
    return distinct_buckets(_repeated_edges(spark, sf_dir), "l_discount_bucket")


@PLANS.add(
    f"""
    {_REPEATED} SELECT CAST(20 AS BIGINT) AS requested,
                       count(DISTINCT l_discount_bucket) AS actual FROM binned
    """
)
def actual_buckets(spark, sf_dir):
    """Fewer buckets than requested, which also warns."""
    actual = actual_bucket_count(_repeated_edges(spark, sf_dir), "l_discount_bucket", 20)
    return spark.createDataFrame([(20, actual)], "requested long, actual long")


@PLANS.add(
    f"SELECT value_bucket AS bucket, count(*) AS cnt FROM ({_LEFT}) GROUP BY value_bucket"
)
def bucket_counts(spark, sf_dir):
    return bucket_distribution(_exact_deciles(spark, sf_dir), "value_bucket")


@PLANS.add(
    f"""
    SELECT l_orderkey,
           CAST(len(list_filter(list_distinct(edges), lambda e: l_quantity >= e)) AS INTEGER) AS bin
    FROM lineitem, (SELECT quantile_disc(l_quantity, {DECILES}) AS edges FROM lineitem)
    """
)
def scale_then_bin(spark, sf_dir):
    """Two fitted steps chained in a Spark ML pipeline."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    steps = Pipeline(
        stages=[
            StandardScaler(["l_quantity"]),
            QuantileDiscretizer(["scaled_l_quantity"], ["bin"], method="exact"),
        ]
    )
    return steps.fit(rows).transform(rows).select("l_orderkey", "bin")


@PLANS.add(
    f"""
    SELECT CAST(len(list_filter(list_distinct(edges), lambda e: l_quantity >= e)) AS INTEGER)
               AS bucket,
           count(*) AS cnt
    FROM lineitem, (SELECT quantile_disc(l_quantity, {DECILES}) AS edges FROM lineitem)
    GROUP BY 1
    """
)
def stream_bucket_counts(spark, sf_dir):
    """Steps fitted on a table, applied to the same rows arriving as a stream."""
    rows = table(spark, sf_dir, "lineitem").select("l_quantity")
    scaler = StandardScaler(["l_quantity"]).fit(rows)
    binner = QuantileDiscretizer(["scaled_l_quantity"], ["bin"], method="exact").fit(
        scaler.transform(rows)
    )
    schema = table(spark, sf_dir, "lineitem").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet")
    stream = files.parquet(sf_dir)
    scored = apply_steps(stream.select("l_quantity"), scaler, binner)
    name = f"bucket_counts_{uuid.uuid4().hex}"
    running_bucket_counts(scored, "bin", name, scratch_path(spark, "stream")).awaitTermination()
    return spark.table(name).select(F.col("bucket"), F.col("cnt"))
