"""A named query over the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Plan:
    """``sql`` is None where no SQL is deterministic enough to compare with."""

    query: Query
    sql: str | None


class Plans(dict[str, Plan]):
    """Collects plans by name; ``add`` is a decorator."""

    def add(self, sql: str | None, name: str | None = None):
        def register(query: Query) -> Query:
            key = name or query.__name__
            if key in self:
                raise ValueError(f"plan {key} is registered twice")
            self[key] = Plan(query, sql)
            return query

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds of a time without zone, whatever the zone of the session."""
    local = F.col(column).cast("timestamp")
    return F.unix_micros(F.from_utc_timestamp(local, F.current_timezone()))
