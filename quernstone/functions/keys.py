"""Repeatable pseudo-random keys: a hash of the row's key, independent of partitioning."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading hex digits of the hash that a threshold sample compares.
THRESHOLD_DIGITS = 8


def hash_key(seed: int, *key: str) -> Column:
    """32 hex digits that order rows pseudo-randomly, the same on every run.

    Each part goes in with its length, and a null as a mark, so different keys differ. A null key is
    one key: its rows share a hash.
    """
    parts = []
    for k in key:
        text = F.col(k).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def hash_threshold(percent: float) -> str:
    """Hex prefix below which ``percent`` of all hashes fall."""
    if not 0 <= percent <= 100:
        raise ValueError("percent must lie in [0, 100]")
    space = 16**THRESHOLD_DIGITS
    bound = -(-Fraction(str(percent)) * space // 100)
    # "g" sorts after every hex digit: nothing is left out at 100 percent.
    return "g" if bound >= space else format(int(bound), f"0{THRESHOLD_DIGITS}x")


def below_percent(hash_column: Column, percent: float) -> Column:
    return F.substring(hash_column, 1, THRESHOLD_DIGITS) < F.lit(hash_threshold(percent))
