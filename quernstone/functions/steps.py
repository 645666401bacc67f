"""Bucket numbers as balanced CASE expressions: log2(edges) comparisons per row, in codegen.

The expressions are built as SQL text: one parse, however many edges there are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_sql(column: str) -> str:
    """A column name, quoted."""
    return "`" + column.replace("`", "``") + "`"


def number_sql(value: float) -> str:
    """A double, exactly."""
    number = float(value)
    return f"{number!r}D" if math.isfinite(number) else f"double('{number}')"


def count_passed(tests: Sequence[str]) -> str:
    """How many tests hold, given that each one implies all tests before it."""

    def search(first: int, last: int) -> str:
        if first == last:
            return str(first)
        middle = (first + last) // 2
        above, below = search(middle + 1, last), search(first, middle)
        return f"CASE WHEN {tests[middle]} THEN {above} ELSE {below} END"

    return search(0, len(tests))


def _bin(column: str, inner: Sequence[float], comparison: str) -> Column:
    value = f"CAST({name_sql(column)} AS DOUBLE)"
    bucket = count_passed([f"{value} {comparison} {number_sql(e)}" for e in inner])
    return F.expr(f"CASE WHEN {name_sql(column)} IS NOT NULL THEN {bucket} END")


def bin_left_closed(column: str, inner: Sequence[float]) -> Column:
    """Bucket of ``[a, b)`` intervals cut at the ``inner`` edges; null for a null value."""
    return _bin(column, inner, ">=")


def bin_right_closed(column: str, inner: Sequence[float]) -> Column:
    """Bucket of ``(a, b]`` intervals cut at the ``inner`` edges; null for a null value."""
    return _bin(column, inner, ">")


def interval_tag(column: str, brackets: Sequence[tuple[float, float]]) -> Column:
    """Of disjoint increasing closed brackets: 2j + 1 inside bracket j, 2j in the gap before it."""
    value, tests = name_sql(column), []
    for low, high in brackets:
        tests += [f"{value} >= {number_sql(low)}", f"{value} > {number_sql(high)}"]
    return F.expr(f"CASE WHEN {value} IS NOT NULL THEN {count_passed(tests)} END")
