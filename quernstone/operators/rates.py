"""Fits of a whole family of nested samples from one scan.

Rows carry the smallest rate whose sample holds them, so the sample at a rate is all rows of that rate and
below. One aggregation by that rate gives states that add up (counts, means, squared deviations, extremes, term
counts); the state of each sample is that of the rates before it and its own. States of rows that come
later are added in the same way, without another look at the earlier ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.numeric import present_sql
from quernstone.operators.scaling import MinMaxScaler, MinMaxScalerModel, StandardScaler, StandardScalerModel
from quernstone.operators.text import term_statistics

RATE_COLUMN = "first_rate"


def moments(df: DataFrame, columns: Sequence[str], rate_column: str = RATE_COLUMN) -> DataFrame:
    """``(rate_column, n_<c>, mean_<c>, m2_<c>, min_<c>, max_<c> ...)``: one state per rate.

    ``m2`` is the sum of squared deviations from the mean. Null and NaN are left out.
    """
    found = []
    for c in columns:
        value = present_sql(c)
        found += [
            F.expr(f"count({value})").alias(f"n_{c}"),
            F.expr(f"avg({value})").alias(f"mean_{c}"),
            F.expr(f"var_pop({value}) * count({value})").alias(f"m2_{c}"),
            F.expr(f"min({value})").alias(f"min_{c}"),
            F.expr(f"max({value})").alias(f"max_{c}"),
        ]
    return df.groupBy(rate_column).agg(*found)


def _combined(states: Column, column: str) -> list[Column]:
    """The state of all rows of an array of states of a column."""
    held = F.filter(states, lambda s: s[f"n_{column}"] > 0)

    def total(of) -> Column:
        return F.aggregate(F.transform(held, of), F.lit(0.0), lambda a, b: a + b)

    n = F.aggregate(F.transform(held, lambda s: s[f"n_{column}"]), F.lit(0).cast("bigint"), lambda a, b: a + b)
    mean = F.when(n > 0, total(lambda s: s[f"mean_{column}"] * s[f"n_{column}"]) / n)
    away = total(lambda s: s[f"m2_{column}"] + s[f"n_{column}"] * F.pow(s[f"mean_{column}"] - mean, F.lit(2.0)))
    return [
        n.alias(f"n_{column}"),
        mean.alias(f"mean_{column}"),
        F.when(n > 0, away).alias(f"m2_{column}"),
        F.array_min(F.transform(held, lambda s: s[f"min_{column}"])).alias(f"min_{column}"),
        F.array_max(F.transform(held, lambda s: s[f"max_{column}"])).alias(f"max_{column}"),
    ]


def merged_moments(states: DataFrame, columns: Sequence[str], rate_column: str = RATE_COLUMN) -> DataFrame:
    """One state per rate from several tables of ``moments``, put together by ``unionByName``."""
    fields = [c for c in states.columns if c != rate_column]
    several = states.groupBy(rate_column).agg(F.collect_list(F.struct(*fields)).alias("states"))
    return several.select(rate_column, *[x for c in columns for x in _combined(F.col("states"), c)])


def moments_by_rate(
    states: DataFrame, columns: Sequence[str], rates: Sequence[int], rate_column: str = RATE_COLUMN
) -> DataFrame:
    """``(rate, n_<c>, mean_<c>, std_<c>, min_<c>, max_<c> ...)`` of the sample at each rate.

    ``states`` is a table of ``moments``: one row per rate, so a hundred at most. The deviation is that of a
    sample, null below two values.
    """
    fields = [c for c in states.columns if c != rate_column]
    whole = states.agg(F.collect_list(F.struct(rate_column, *fields)).alias("states"))
    rows = whole.select(F.explode(F.array(*[F.lit(int(r)) for r in rates])).alias("rate"), "states")
    within = rows.select("rate", F.filter("states", lambda s: s[rate_column] <= F.col("rate")).alias("states"))
    merged = within.select("rate", *[x for c in columns for x in _combined(F.col("states"), c)])
    out = [F.col("rate")]
    for c in columns:
        deviation = F.when(F.col(f"n_{c}") > 1, F.sqrt(F.col(f"m2_{c}") / (F.col(f"n_{c}") - 1)))
        out += [F.col(f"n_{c}"), F.col(f"mean_{c}"), deviation.alias(f"std_{c}"), F.col(f"min_{c}"), F.col(f"max_{c}")]
    return merged.select(*out)


def fit_by_rate(
    scaler: StandardScaler | MinMaxScaler, df: DataFrame, rates: Sequence[int], rate_column: str = RATE_COLUMN
) -> dict[int, StandardScalerModel | MinMaxScalerModel]:
    """The model that ``scaler`` would fit on the sample of each rate, all from one scan of ``df``.

    Null and NaN are left out whatever ``invalid`` says; the models keep it for their transform. A scaler with
    ``ddof=0`` is refused, as is one that skips rows by other columns.
    """
    if getattr(scaler, "ddof", 1) != 1 or (scaler.invalid == "skip" and len(scaler.columns) > 1):
        raise ValueError("fits by rate have ddof=1 and look at each column by itself")
    kind = StandardScalerModel if isinstance(scaler, StandardScaler) else MinMaxScalerModel
    found = moments_by_rate(moments(df, scaler.columns, rate_column), scaler.columns, rates, rate_column)
    return {row["rate"]: kind(scaler, row) for row in found.collect()}  # one row per rate


def term_statistics_by_rate(
    df: DataFrame, rates: Sequence[int], tokens_column: str = "tokens", rate_column: str = RATE_COLUMN
) -> DataFrame:
    """``(rate, term, tf, df)`` of the sample at each rate, for the terms it holds.

    The terms are counted once per rate that first holds them and added up along the rates of a term.
    """
    counted = term_statistics(df, tokens_column, by=[rate_column])
    steps = sorted({int(r) for r in rates})
    # The first of the asked rates that takes a row in; rows beyond the last are in none.
    joins = F.coalesce(*[F.when(F.col(rate_column) <= r, F.lit(r)) for r in steps])
    placed = counted.withColumn("rate", joins).filter(F.col("rate").isNotNull())
    placed = placed.groupBy("term", "rate").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    along = Window.partitionBy("term").orderBy("rate")
    upto = placed.select(
        "term",
        "rate",
        F.sum("tf").over(along).alias("tf"),
        F.sum("df").over(along).alias("df"),
        F.lead("rate").over(along).alias("until"),
    )
    # A state holds until the next rate that adds to it.
    later = F.filter(F.array(*map(F.lit, steps)), lambda r: (r >= F.col("rate")) & (F.col("until").isNull() | (r < F.col("until"))))
    return upto.select(F.explode(later).alias("rate"), "term", "tf", "df")
