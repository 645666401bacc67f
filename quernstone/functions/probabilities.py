"""Small helpers on probabilities and sketch sizes."""

from __future__ import annotations

from fractions import Fraction
from math import ceil

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sizes that Spark's sketch accepts, and its published error curve.
LEAST_SKETCH_SIZE = 8
MOST_SKETCH_SIZE = 65_535
ERROR_FACTOR = 2.296
ERROR_POWER = 0.9021


def even_probabilities(num_buckets: int) -> list[float]:
    """The ``num_buckets - 1`` inner cut probabilities of equal-frequency buckets."""
    if num_buckets < 2:
        raise ValueError("num_buckets must be at least 2")
    return [i / num_buckets for i in range(1, num_buckets)]


def sketch_error(size: int) -> float:
    """Rank error, as a share of the rows, that a sketch of this size keeps with 99% confidence."""
    return ERROR_FACTOR / size**ERROR_POWER


def sketch_size(relative_error: float) -> int:
    """Smallest sketch size whose rank error is within ``relative_error`` with 99% confidence."""
    if not 0 < relative_error <= 1:
        raise ValueError("relative_error must lie in (0, 1]")
    size = max(LEAST_SKETCH_SIZE, ceil((ERROR_FACTOR / relative_error) ** (1 / ERROR_POWER)))
    if size > MOST_SKETCH_SIZE:
        least = sketch_error(MOST_SKETCH_SIZE)
        raise ValueError(
            f"no sketch keeps an error of {relative_error}: the least is {least:.3g}; "
            "use the summary or exact quantiles"
        )
    return size


def check_sketch_size(size: int) -> int:
    """The size, if Spark has sketches of it."""
    if not LEAST_SKETCH_SIZE <= size <= MOST_SKETCH_SIZE:
        raise ValueError(f"sketch sizes are {LEAST_SKETCH_SIZE} to {MOST_SKETCH_SIZE}, not {size}")
    return size


def rank_of(probability: float, n: int) -> int:
    """1-based rank of the discrete quantile: ceil(p * n), at least 1.

    The product is exact for the short fraction the float stands for, so that 0.07 of 100 rows
    is rank 7 and 5/7 of 70 rows is rank 50, whatever the float's last bit.
    """
    return max(1, ceil(_short(probability) * n))



def rank_column(probability: float, n: str) -> Column:
    """The same rank of a column of counts below 10**15, in whole numbers."""
    exact = _short(probability)
    above, below = (f"cast({x} AS decimal(20,0))" for x in (exact.numerator, exact.denominator))
    return F.expr(f"greatest(1L, (cast({n} AS decimal(15,0)) * {above} + {below} - 1) div {below})")


def _short(probability: float) -> Fraction:
    """The short fraction the float stands for, else the float itself."""
    short = Fraction(probability).limit_denominator(100_000)
    return short if float(short) == probability else Fraction(probability)
