"""Quantiles with a bounded relative error in value, from counts in logarithmic buckets.

Bucket i holds the magnitudes in (g**(i-1), g**i] with g = (1 + error) / (1 - error), so its middle value
is off by at most ``error`` of any of them. Signs and zero are apart. A table of buckets is one count per bucket that
occurs: its size depends on the range of the values and the error, not on the rows, the result does
not depend on the order of the rows, and tables of parts of the data add up to that of the whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.probabilities import rank_column

# Bucket of infinite values, beyond that of every finite one at any error from LEAST_ERROR.
INFINITE = 2_000_000_000
LEAST_ERROR = 1e-6


def _base(relative_error: float) -> float:
    if not LEAST_ERROR <= relative_error < 1:
        raise ValueError(f"relative_error must lie in [{LEAST_ERROR}, 1)")
    return (1 + relative_error) / (1 - relative_error)


def log_buckets(df: DataFrame, columns: Sequence[str], relative_error: float) -> DataFrame:
    """``(column_name, sign, bucket, cnt)``: how many values of each column fall in each bucket.

    Null and NaN are left out; a zero has sign and bucket 0. One scan for all columns, one shuffle of
    counts.
    """
    step = log(_base(relative_error))
    values = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in columns]
    rows = df.select(F.explode(F.array(*values)).alias("v")).select("v.*")
    rows = rows.filter(F.col("x").isNotNull() & ~F.isnan("x"))
    size = F.abs("x")
    bucket = F.when(size == 0, 0).when(size == float("inf"), INFINITE).otherwise(F.ceil(F.log(size) / step))
    keys = [F.col("column_name"), F.signum("x").cast("int").alias("sign"), bucket.cast("int").alias("bucket")]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))


def merged_buckets(*tables: DataFrame) -> DataFrame:
    """The buckets of all rows, from the buckets of parts of them at the same error."""
    together = reduce(DataFrame.unionByName, tables)
    return together.groupBy("column_name", "sign", "bucket").agg(F.sum("cnt").alias("cnt"))


def _middle(relative_error: float) -> Column:
    """The value whose relative distance from both ends of the bucket is the error."""
    base = _base(relative_error)
    # In two factors, as the power of the largest bucket alone may pass a double.
    size = F.pow(F.lit(base), F.col("bucket") - 1) * (2 * base / (base + 1))
    size = F.when(F.col("bucket") == INFINITE, float("inf")).otherwise(size)
    return F.when(F.col("sign") == 0, F.lit(0.0)).otherwise(F.col("sign") * size)


def log_bucket_quantiles(buckets: DataFrame, probabilities: Sequence[float], relative_error: float) -> DataFrame:
    """``(column_name, prob, value)`` at rank ceil(p * n), off by at most ``relative_error`` of the exact one.

    ``buckets`` is a table of ``log_buckets`` at the same error. A column without values gives no row.
    """
    middle = _middle(relative_error)
    order = F.col("sign") * F.col("bucket")
    # The positive buckets ascend with their numbers, the negative ones descend.
    running = Window.partitionBy("column_name").orderBy("sign", order)
    whole = Window.partitionBy("column_name")
    upto = F.sum("cnt").over(running)
    placed = buckets.select("column_name", middle.alias("value"), "cnt", upto.alias("upto"), F.sum("cnt").over(whole).alias("n"))
    ranks = [F.struct(F.lit(float(p)).alias("prob"), rank_column(p, "n").alias("rank")) for p in probabilities]
    reached = F.filter(F.array(*ranks), lambda r: (r["rank"] <= F.col("upto")) & (r["rank"] > F.col("upto") - F.col("cnt")))
    return placed.select("column_name", F.explode(reached).alias("r"), "value").select("column_name", "r.prob", "value")
