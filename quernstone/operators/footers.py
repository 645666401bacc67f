"""Row counts and extremes of Parquet tables from their footers, without reading a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType, IntegralType

# The settings under which Spark answers an aggregate from Parquet footers.
_SETTINGS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def footer_statistics(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """One row: ``row_count``, and ``min_<c>`` and ``max_<c>`` of each column, for the table at ``path``.

    Whole-number and date columns are answered from the footers, each file by its own. Others are read: footers
    cut long strings short, and know nothing of NaN, which orders above all numbers. Null is left out. The result
    belongs to a session of its own with the settings that this needs, which shares the application.
    """
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and session.conf.isModifiable(key):
            session.conf.set(key, value)
    for key, value in _SETTINGS.items():
        session.conf.set(key, value)
    table = session.read.parquet(path)

    def extremes(names: Sequence[str]) -> list:
        found = []
        for c in names:
            value = F.col(c)
            if isinstance(table.schema[c].dataType, (DoubleType, FloatType)):
                value = F.nanvl(value, value)  # the value itself, which no footer holds
            found += [F.min(value).alias(f"min_{c}"), F.max(value).alias(f"max_{c}")]
        return found

    stated = [c for c in columns if isinstance(table.schema[c].dataType, (IntegralType, DateType))]
    rest = [c for c in columns if c not in stated]
    found = table.agg(F.count(F.lit(1)).alias("row_count"), *extremes(stated))
    out = ["row_count", *[f"{n}_{c}" for c in columns for n in ("min", "max")]]
    if rest:
        both = found.unionByName(table.agg(*extremes(rest)), allowMissingColumns=True)
        found = both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in out])
    # A table without rows may have no footer to count by.
    return found.select(F.coalesce("row_count", F.lit(0)).alias("row_count"), *out[1:])
