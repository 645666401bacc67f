"""Standardising and min-max scaling.

A fit is one aggregation over all columns. Its state has one pair of numbers per column and is
written into the transform as literals, so a transform is a projection in codegen: no join, no
shuffle, and the same plan on a stream.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import ElementwiseProduct
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from quernstone.functions.numeric import (
    min_max_scaled,
    missing_sql,
    present_sql,
    standardised,
    unless_missing,
)
from quernstone.operators.base import FitStep, FittedStep, check_invalid, output_names
from quernstone.support.names import unused


def _check_ddof(ddof: int) -> int:
    if ddof not in (0, 1):
        raise ValueError("ddof must be 0 (population) or 1 (sample)")
    return ddof


def _spread_sql(value: str, ddof: int) -> str:
    return f"stddev_samp({value})" if ddof else f"stddev_pop({value})"


def _standard_aggregates(columns: Sequence[str], ddof: int) -> list[Column]:
    found = []
    for c in columns:
        value = present_sql(c)
        found.append(F.expr(f"avg({value})").alias(f"mean_{c}"))
        found.append(F.expr(_spread_sql(value, ddof)).alias(f"std_{c}"))
    return found


def _min_max_aggregates(columns: Sequence[str]) -> list[Column]:
    found = []
    for c in columns:
        value = present_sql(c)
        found.append(F.expr(f"min({value})").alias(f"min_{c}"))
        found.append(F.expr(f"max({value})").alias(f"max_{c}"))
    return found


def standard_statistics(df: DataFrame, columns: Sequence[str], ddof: int = 1) -> DataFrame:
    """One row with ``mean_<c>`` and ``std_<c>`` per column; null and NaN are left out."""
    return df.agg(*_standard_aggregates(columns, _check_ddof(ddof)))


def min_max_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with ``min_<c>`` and ``max_<c>`` per column; null and NaN are left out."""
    return df.agg(*_min_max_aggregates(columns))


def _usable_rows(df: DataFrame, columns: Sequence[str], invalid: str) -> DataFrame:
    if invalid != "skip":
        return df
    return df.filter(" AND ".join(f"NOT {missing_sql(c)}" for c in columns))


class _ColumnScaler(FitStep):
    """Shared parts of the two scalers over named columns."""

    def __init__(
        self, columns: Sequence[str], output_columns: Sequence[str] | None, invalid: str
    ):
        super().__init__()
        self.columns = list(columns)
        self.output_columns = output_names(self.columns, output_columns, "scaled_{}")
        self.invalid = check_invalid(invalid)

    def _fitted_row(self, df: DataFrame, aggregates: list[Column]) -> Row:
        """One row of statistics by one job, which under ``error`` also looks for missing values."""
        if self.invalid == "error":
            missing = [F.expr(f"count_if({missing_sql(c)})") for c in self.columns]
            row = df.agg(*aggregates, F.array(*missing).alias("_missing")).first()
            bad = [c for c, n in zip(self.columns, row["_missing"], strict=True) if n]
            if bad:
                raise ValueError(f"{bad} hold a null or NaN; use invalid='skip' or 'keep'")
            return row
        return _usable_rows(df, self.columns, self.invalid).agg(*aggregates).first()


class _ScaledColumns(FittedStep):
    """Applies one expression per column under the missing-value policy of the fit."""

    def __init__(self, scaler: _ColumnScaler):
        super().__init__()
        self.columns = scaler.columns
        self.output_columns = scaler.output_columns
        self.invalid = scaler.invalid

    def _scaled(self, column: str) -> str:
        """SQL expression of the scaled column."""
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        usable = _usable_rows(df, self.columns, self.invalid)
        added = {}
        for c, out in zip(self.columns, self.output_columns, strict=True):
            scaled = self._scaled(c)
            added[out] = unless_missing(c, scaled) if self.invalid == "error" else F.expr(scaled)
        return usable.withColumns(added)


class StandardScaler(_ColumnScaler):
    """``(x - mean) / std`` per column into ``scaled_<c>`` or the given output columns.

    ``ddof`` is 1 for the sample deviation, 0 for the population deviation. ``invalid``:
    ``error`` refuses null and NaN, ``skip`` drops rows holding one in any of the columns,
    ``keep`` leaves them out of the statistics and passes them through.
    """

    def __init__(
        self,
        columns: Sequence[str],
        output_columns: Sequence[str] | None = None,
        with_mean: bool = True,
        with_std: bool = True,
        ddof: int = 1,
        invalid: str = "error",
    ):
        super().__init__(columns, output_columns, invalid)
        self.with_mean = with_mean
        self.with_std = with_std
        self.ddof = _check_ddof(ddof)

    def _fit(self, df: DataFrame) -> StandardScalerModel:
        row = self._fitted_row(df, _standard_aggregates(self.columns, self.ddof))
        return StandardScalerModel(self, row)


class StandardScalerModel(_ScaledColumns):
    """``mean`` and ``std`` map each column to its fitted numbers (None on an empty table)."""

    def __init__(self, scaler: StandardScaler, row: Row):
        super().__init__(scaler)
        self.mean = {c: row[f"mean_{c}"] for c in self.columns}
        self.std = {c: row[f"std_{c}"] for c in self.columns}
        self.with_mean = scaler.with_mean
        self.with_std = scaler.with_std

    def _scaled(self, column: str) -> str:
        mean, std = self.mean[column], self.std[column]
        if mean is not None and not self.with_mean:
            mean = 0.0
        return standardised(column, mean, std if self.with_std else 1.0)


class MinMaxScaler(_ColumnScaler):
    """Map each column's range onto ``[low, high]``; a constant column goes to the middle."""

    def __init__(
        self,
        columns: Sequence[str],
        output_columns: Sequence[str] | None = None,
        low: float = 0.0,
        high: float = 1.0,
        invalid: str = "error",
    ):
        super().__init__(columns, output_columns, invalid)
        self.low = low
        self.high = high

    def _fit(self, df: DataFrame) -> MinMaxScalerModel:
        row = self._fitted_row(df, _min_max_aggregates(self.columns))
        return MinMaxScalerModel(self, row)


class MinMaxScalerModel(_ScaledColumns):
    def __init__(self, scaler: MinMaxScaler, row: Row):
        super().__init__(scaler)
        self.min = {c: row[f"min_{c}"] for c in self.columns}
        self.max = {c: row[f"max_{c}"] for c in self.columns}
        self.low = scaler.low
        self.high = scaler.high

    def _scaled(self, column: str) -> str:
        return min_max_scaled(column, self.min[column], self.max[column], self.low, self.high)


class VectorStandardScaler(FitStep):
    """Standardise an assembled feature column, ``array<double>`` or ML vector, element by element.

    The output has the type of the input. The width need not be known: elements are aggregated by
    their position, with partial sums in every task. A null feature value or element, or a NaN,
    is left out of the statistics and passed through; the assembler decides whether to refuse it.

    ML vectors without ``with_mean`` stay sparse: their statistics are summed up from the elements
    that are stored, and one vector of factors multiplies them. There a NaN is not left out but makes
    its element's deviation NaN.
    """

    def __init__(
        self,
        input_column: str = "features",
        output_column: str = "scaled_features",
        with_mean: bool = True,
        with_std: bool = True,
        ddof: int = 1,
    ):
        super().__init__()
        self.input_column = input_column
        self.output_column = output_column
        self.with_mean = with_mean
        self.with_std = with_std
        self.ddof = _check_ddof(ddof)

    def _elements(self, df: DataFrame) -> Column:
        kind = df.schema[self.input_column].dataType
        value = F.col(self.input_column)
        if not isinstance(kind, ArrayType):
            value = vector_to_array(value)
        return value.cast("array<double>")

    def _sparse(self, df: DataFrame) -> bool:
        return not self.with_mean and not isinstance(df.schema[self.input_column].dataType, ArrayType)

    def _fit_sparse(self, df: DataFrame) -> VectorStandardScalerModel:
        """By Spark ML's summary: one row with one number per element."""
        held = df.filter(F.col(self.input_column).isNotNull())
        if held.isEmpty():
            return VectorStandardScalerModel(self, [])
        summary = Summarizer.metrics("count", "mean", "std").summary(F.col(self.input_column)).alias("s")
        row = held.select(summary).select("s.count", "s.mean", "s.std").first()
        n = row["count"]
        factor = 1.0 if self.ddof or n < 2 else math.sqrt((n - 1) / n)
        pairs = zip(row["mean"].toArray().tolist(), row["std"].toArray().tolist(), strict=True)
        return VectorStandardScalerModel(self, [(mean, std * factor) for mean, std in pairs])

    def _fit(self, df: DataFrame) -> VectorStandardScalerModel:
        if self._sparse(df):
            return self._fit_sparse(df)
        spread_out = df.select(F.posexplode(self._elements(df)).alias("place", "value"))
        value = present_sql("value")
        # One row per element of the vector: bounded by its width.
        rows = (
            spread_out.groupBy("place")
            .agg(
                F.expr(f"avg({value})").alias("mean"),
                F.expr(_spread_sql(value, self.ddof)).alias("std"),
            )
            .orderBy("place")
            .collect()
        )
        return VectorStandardScalerModel(self, [(r["mean"], r["std"]) for r in rows])


class VectorStandardScalerModel(FittedStep):
    """``mean`` and ``std`` list the fitted numbers by element position."""

    def __init__(self, scaler: VectorStandardScaler, pairs: list[tuple]):
        super().__init__()
        self.scaler = scaler
        self.mean = [mean for mean, _ in pairs]
        self.std = [std for _, std in pairs]

    def _transform(self, df: DataFrame) -> DataFrame:
        scaler = self.scaler
        if scaler._sparse(df):
            return self._transform_sparse(df)
        elements = scaler._elements(df)
        flat, unknown = float("inf"), float("nan")
        shift = [(unknown if m is None else m) if scaler.with_mean else 0.0 for m in self.mean]
        # An infinite divisor marks an element without spread.
        divide = [(s or flat) if scaler.with_std else 1.0 for s in self.std]
        fitted = F.arrays_zip(
            F.lit(shift).cast("array<double>").alias("shift"),
            F.lit(divide).cast("array<double>").alias("divide"),
        )

        def scale(x: Column, f: Column) -> Column:
            level = F.when(F.isnan(x), x).when(x.isNotNull(), F.lit(0.0))
            return F.when(f["divide"] == flat, level).otherwise((x - f["shift"]) / f["divide"])

        scaled = F.zip_with(elements, fitted, scale)
        if not isinstance(df.schema[scaler.input_column].dataType, ArrayType):
            scaled = array_to_vector(scaled)
        return df.withColumn(scaler.output_column, scaled)

    def _transform_sparse(self, df: DataFrame) -> DataFrame:
        scaler, width = self.scaler, len(self.std)
        if width == 0:  # fitted on no vector at all
            nothing = F.when(F.lit(False), F.col(scaler.input_column))
            return df.withColumn(scaler.output_column, nothing)
        factors = [(1 / s if s else 0.0) if scaler.with_std else 1.0 for s in self.std]
        # The product refuses a null, so an empty vector stands in for it.
        stored = f'{{"v":{{"type":0,"size":{width},"indices":[],"values":[]}}}}'
        empty = F.from_json(F.lit(stored), StructType([StructField("v", VectorUDT())]))["v"]
        value = F.col(scaler.input_column)
        present, product_of = unused([*df.columns, scaler.output_column], "_present", "_scaled")
        held = df.withColumn(present, F.coalesce(value, empty))
        product = ElementwiseProduct(scalingVec=Vectors.dense(factors), inputCol=present, outputCol=product_of)
        scaled = F.when(value.isNotNull(), F.col(product_of))
        return product.transform(held).withColumn(scaler.output_column, scaled).drop(present, product_of)
