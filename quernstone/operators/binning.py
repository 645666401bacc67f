"""Equal-frequency and custom-edge binning.

Edges are a short list bounded by the number of bins; a transform is one CASE expression per
column, evaluated in codegen with log2(bins) comparisons per row.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.numeric import missing_sql
from quernstone.functions.probabilities import even_probabilities
from quernstone.functions.steps import bin_left_closed, bin_right_closed
from quernstone.operators.base import FitStep, FittedStep, PlainStep, check_invalid, output_names
from quernstone.operators.quantiles import quantiles_by


def _unless(bad: Column, message: str, bucket: Column) -> Column:
    """The bucket; the query fails on the first bad row."""
    return F.when(bad, F.raise_error(F.lit(message)).cast("int")).otherwise(bucket)


class QuantileDiscretizer(FitStep):
    """Equal-frequency buckets ``[a, b)`` numbered from 0 in ``<c>_bucket``.

    The outer buckets are unbounded, so every number falls in one. Equal quantiles collapse, which
    leaves fewer buckets. A null stays null. ``invalid`` decides on NaN: ``error`` fails the query,
    ``skip`` drops the row (as it does for null), ``keep`` gives NaN a bucket of its own after the
    others. ``method`` is ``exact``, ``summary`` or ``sketch``, see ``quantiles_by``.
    """

    def __init__(
        self,
        columns: Sequence[str],
        output_columns: Sequence[str] | None = None,
        num_buckets: int = 10,
        relative_error: float = 0.001,
        method: str = "summary",
        invalid: str = "error",
    ):
        super().__init__()
        self.columns = list(columns)
        self.output_columns = output_names(self.columns, output_columns, "{}_bucket")
        self.num_buckets = num_buckets
        self.relative_error = relative_error
        self.method = method
        self.invalid = check_invalid(invalid)

    def _fit(self, df: DataFrame) -> QuantileDiscretizerModel:
        probabilities = even_probabilities(self.num_buckets)
        found = quantiles_by(df, self.columns, probabilities, self.method, self.relative_error)
        inner = {c: sorted({v for v in q if v is not None}) for c, q in found.items()}
        return QuantileDiscretizerModel(self, inner)


class QuantileDiscretizerModel(FittedStep):
    """``splits`` maps each column to its distinct edges, infinite at both ends."""

    def __init__(self, step: QuantileDiscretizer, inner: dict[str, list[float]]):
        super().__init__()
        self.columns = step.columns
        self.output_columns = step.output_columns
        self.invalid = step.invalid
        self.inner = inner
        self.splits = {c: [float("-inf"), *v, float("inf")] for c, v in inner.items()}

    def _transform(self, df: DataFrame) -> DataFrame:
        added = {}
        for c, out in zip(self.columns, self.output_columns, strict=True):
            value, inner = F.col(c).cast("double"), self.inner[c]
            bucket = bin_left_closed(c, inner)
            if self.invalid == "skip":
                df = df.filter(f"NOT {missing_sql(c)}")
            elif self.invalid == "error":
                bucket = _unless(F.isnan(value), f"column {c} holds a NaN", bucket)
            else:
                bucket = F.when(F.isnan(value), F.lit(len(inner) + 1)).otherwise(bucket)
            added[out] = bucket
        return df.withColumns(added)


class CustomBinner(PlainStep):
    """Bin columns at given edges, without a fit, into ``<c>_bucket`` numbered from 0.

    ``closed="right"`` bins ``(a, b]``, and ``include_lowest`` puts the lowest edge itself in the
    first bin. ``closed="left"`` bins ``[a, b)`` with the last bin closed on both sides.
    ``duplicates="drop"`` collapses repeated edges, ``"raise"`` refuses them. A null stays null.
    ``invalid`` decides on NaN and on values outside the edges: ``error`` fails the query, ``skip``
    drops the row (as it does for null), ``keep`` gives a null bucket.
    """

    def __init__(
        self,
        bins: Mapping[str, Sequence[float]],
        output_columns: Sequence[str] | None = None,
        closed: str = "right",
        include_lowest: bool = False,
        duplicates: str = "raise",
        invalid: str = "error",
    ):
        super().__init__()
        if closed not in ("left", "right"):
            raise ValueError("closed must be 'left' or 'right'")
        if duplicates not in ("raise", "drop"):
            raise ValueError("duplicates must be 'raise' or 'drop'")
        self.columns = list(bins)
        self.output_columns = output_names(self.columns, output_columns, "{}_bucket")
        self.closed = closed
        self.include_lowest = include_lowest
        self.invalid = check_invalid(invalid)
        self.edges = {c: self._clean(c, edges, duplicates) for c, edges in bins.items()}

    @staticmethod
    def _clean(column: str, edges: Sequence[float], duplicates: str) -> list[float]:
        given = [float(e) for e in edges]
        if given != sorted(given):
            raise ValueError(f"edges of {column} must increase")
        distinct = sorted(set(given))
        if len(distinct) < len(given) and duplicates == "raise":
            raise ValueError(f"edges of {column} repeat; use duplicates='drop'")
        if len(distinct) < 2:
            raise ValueError(f"{column} needs at least two distinct edges")
        return distinct

    def _outside(self, value: Column, edges: list[float]) -> Column:
        """Not in any bin; NaN compares above every number."""
        low, high = F.lit(edges[0]), F.lit(edges[-1])
        if self.closed == "right" and not self.include_lowest:
            return F.coalesce((value <= low) | (value > high), F.lit(False))
        return F.coalesce((value < low) | (value > high), F.lit(False))

    def _transform(self, df: DataFrame) -> DataFrame:
        number = bin_right_closed if self.closed == "right" else bin_left_closed
        added = {}
        for c, out in zip(self.columns, self.output_columns, strict=True):
            value, edges = F.col(c).cast("double"), self.edges[c]
            outside, bucket = self._outside(value, edges), number(c, edges[1:-1])
            if self.invalid == "skip":
                df = df.filter(value.isNotNull() & ~outside)
            elif self.invalid == "error":
                message = f"column {c} holds a value outside its edges, or a NaN"
                bucket = _unless(outside, message, bucket)
            else:
                bucket = F.when(~outside, bucket)
            added[out] = bucket
        return df.withColumns(added)


def distinct_buckets(df: DataFrame, bucket_column: str) -> DataFrame:
    """The bucket values in use, one row each."""
    return df.select(bucket_column).distinct()


def actual_bucket_count(df: DataFrame, bucket_column: str, requested: int) -> int:
    """Number of non-null buckets in use; warns when there are fewer than requested."""
    actual = df.agg(F.count_distinct(bucket_column)).first()[0]
    if actual < requested:
        warnings.warn(
            f"{actual} buckets in use, {requested} requested; edges may repeat", stacklevel=2
        )
    return actual


def bucket_distribution(df: DataFrame, bucket_column: str) -> DataFrame:
    """``(bucket, cnt)``: rows per bucket, null included."""
    return df.groupBy(F.col(bucket_column).alias("bucket")).agg(F.count(F.lit(1)).alias("cnt"))
