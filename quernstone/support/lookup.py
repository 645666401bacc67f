"""Join a large table with a small keyed one, broadcasting only below a measured size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.support.cut import Size, cut, measure
from quernstone.support.names import unused

# Largest table sent to every executor, as measured rows and bytes.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024

# Most frequent keys of the large side that are joined without a shuffle in any case.
HEAVY_KEYS = 1000


def same_key(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str]) -> Column:
    """Null-safe equality, so that a null key is a key like any other."""
    pairs = [left[a].eqNullSafe(right[b]) for a, b in zip(left_on, right_on, strict=True)]
    return reduce(lambda a, b: a & b, pairs)


def lookup_join(
    large: DataFrame,
    small: DataFrame,
    on: list[str],
    size: Size | None = None,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """Inner join of ``large`` with ``small`` on null-safe keys.

    ``small`` has few rows per key. It is broadcast when its measured rows and bytes allow it;
    without a ``size`` (its own or an upper bound) it is counted first. Otherwise the most frequent keys of
    ``large`` are found by counting, and their few rows of ``small`` are broadcast, so that only keys
    without a large share are shuffled.
    """
    limit = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    size = measure(small) if size is None else size
    keys = unused([*large.columns, *small.columns], *[f"_key_{i}" for i in range(len(on))])
    small = small.withColumnsRenamed(dict(zip(on, keys, strict=True)))
    if size.rows <= limit and size.bytes <= BROADCAST_BYTES:
        return large.join(F.broadcast(small), same_key(large, small, on, keys)).drop(*keys)
    (n,) = unused(on, "_n")
    counted = large.groupBy(*on).agg(F.count(F.lit(1)).alias(n))
    often = cut(counted.orderBy(F.desc(n)).limit(HEAVY_KEYS).select(*on), "heavy-keys")
    heavy = F.broadcast(small.join(F.broadcast(often), same_key(small, often, keys, on), "left_semi"))
    frequent = large.join(heavy, same_key(large, heavy, on, keys)).drop(*keys)
    rest = large.join(F.broadcast(often), same_key(large, often, on, on), "left_anti")
    rare = rest.join(small, same_key(rest, small, on, keys)).drop(*keys)
    return frequent.unionByName(rare)
