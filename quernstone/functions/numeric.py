"""Numeric column expressions with defined results for null, NaN and zero spread.

Transforms are built as SQL text, one parse per column; fitted numbers become exact literals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions.steps import name_sql, number_sql


def double_sql(column: str) -> str:
    return f"CAST({name_sql(column)} AS DOUBLE)"


def missing_sql(column: str) -> str:
    value = double_sql(column)
    return f"({value} IS NULL OR isnan({value}))"


def present_sql(column: str) -> str:
    """The value as a double, null for NaN, so that aggregates skip both."""
    return f"nanvl({double_sql(column)}, CAST(NULL AS DOUBLE))"


def unless_missing(column: str, result: str) -> Column:
    """The SQL expression ``result``; the query fails on the first null or NaN of ``column``."""
    name = column.replace("\\", "\\\\").replace("'", "\\'")
    message = f"column {name} holds a null or NaN; use invalid=skip or invalid=keep"
    return F.expr(
        f"CASE WHEN {missing_sql(column)} "
        f"THEN CAST(raise_error('{message}') AS DOUBLE) ELSE {result} END"
    )


def standardised(column: str, mean: float | None, std: float | None) -> str:
    """``(value - mean) / std``; 0 where the fitted column had no spread."""
    value = double_sql(column)
    if mean is None:
        return "CAST(NULL AS DOUBLE)"
    if not std:
        return f"CASE WHEN isnan({value}) THEN {value} WHEN {value} IS NOT NULL THEN 0D END"
    return f"({value} - {number_sql(mean)}) / {number_sql(std)}"


def min_max_scaled(
    column: str, low: float | None, high: float | None, to_low: float, to_high: float
) -> str:
    """Map ``[low, high]`` onto ``[to_low, to_high]``; the midpoint where both ends are equal."""
    value = double_sql(column)
    if low is None or high is None:
        return "CAST(NULL AS DOUBLE)"
    if low == high:
        middle = number_sql(0.5 * (to_low + to_high))
        return f"CASE WHEN isnan({value}) THEN {value} WHEN {value} IS NOT NULL THEN {middle} END"
    unit = f"({value} - {number_sql(low)}) / {number_sql(high - low)}"
    return f"{unit} * {number_sql(to_high - to_low)} + {number_sql(to_low)}"
