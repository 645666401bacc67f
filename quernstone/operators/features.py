"""Projection, feature assembly, caching and row counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.numeric import double_sql, missing_sql, unless_missing
from quernstone.operators.base import PlainStep, check_invalid


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the named columns; the scan reads no others."""
    return df.select(*columns)


def row_count(df: DataFrame) -> DataFrame:
    """One row with the number of rows, ``n_rows``. Transform columns are pruned, not run."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


@contextmanager
def cached(df: DataFrame) -> Iterator[DataFrame]:
    """Keep ``df`` in memory, spilling to disk, for the repeated fits inside the block."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()


class FeatureAssembler(PlainStep):
    """Several numeric columns into one ``array<double>`` column, or an ML vector.

    ``invalid``: ``error`` fails the query on a null or NaN, ``skip`` drops the row, ``keep``
    stores NaN for it.
    """

    def __init__(
        self,
        columns: Sequence[str],
        output_column: str = "features",
        invalid: str = "error",
        as_vector: bool = False,
    ):
        super().__init__()
        self.columns = list(columns)
        self.output_column = output_column
        self.invalid = check_invalid(invalid)
        self.as_vector = as_vector

    def _transform(self, df: DataFrame) -> DataFrame:
        numbers = {c: F.expr(double_sql(c)) for c in self.columns}
        if self.invalid == "skip":
            for c in self.columns:
                df = df.filter(f"NOT {missing_sql(c)}")
        elif self.invalid == "error":
            numbers = {c: unless_missing(c, double_sql(c)) for c in self.columns}
        else:
            numbers = {c: F.coalesce(v, F.lit(float("nan"))) for c, v in numbers.items()}
        packed = F.array(*numbers.values())
        return df.withColumn(
            self.output_column, array_to_vector(packed) if self.as_vector else packed
        )
