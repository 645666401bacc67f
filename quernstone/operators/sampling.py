"""Repeatable samples: exact within strata, nested over rates, and by hash threshold.

A row's place in the sampling order is a hash of its key, so a sample depends on the data alone:
not on partitioning, task order or retries. Rows sharing a key within a stratum are kept or dropped
together; with a unique key a sample holds exactly ``ceil(percent * n / 100)`` rows per stratum.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.keys import below_percent, hash_key
from quernstone.support.cut import Size, cut_measured
from quernstone.support.lookup import lookup_join
from quernstone.support.names import unused

# Hex digits of a hash; of the first slices of a stratum (4,096 of them); and the most by which a
# large slice is split again (1,048,576).
HASH_DIGITS = 32
FIRST_DIGITS = 3
MORE_DIGITS = 5

# Rows of a slice whose keys one task may order.
SLICE_ROWS = 1_000_000


def _rates(percents: Sequence[int]) -> list[int]:
    rates = sorted(set(percents))
    if not rates or any(p != int(p) or not 0 < p <= 100 for p in rates):
        raise ValueError("percents must be whole numbers in 1..100")
    return [int(p) for p in rates]


def _reached(asked: DataFrame) -> DataFrame:
    """Keep the slices in which a wanted count is reached, and what is left to keep in them."""
    hit = (F.col("_upto") >= F.col("_room")) & (F.col("_before") < F.col("_room"))
    return asked.filter(hit).withColumn("_room", F.col("_room") - F.col("_before"))


def _placed(counted: DataFrame, parent: list[str]) -> DataFrame:
    """Rows up to and before each slice ``_next`` of its parent slice."""
    upto = F.sum("_rows").over(Window.partitionBy(*parent).orderBy("_next"))
    return counted.select(
        "*", upto.alias("_upto"), (upto - F.col("_rows")).alias("_before")
    )


def sample_cuts(
    df: DataFrame,
    strata: Sequence[str],
    key: Sequence[str],
    percents: Sequence[int],
    seed: int = 0,
    slice_rows: int = SLICE_ROWS,
    broadcast_rows: int | None = None,
) -> tuple[DataFrame, Size]:
    """``(strata..., cut_<percent>...)``, the last hash kept per stratum and rate, and its size.

    No stratum is ever sorted as a whole. Rows are counted per slice of the hash space, and the
    slice holding the last kept row is found from the counts. A slice still holding more than
    ``slice_rows`` rows is sliced again; then its keys alone are ordered. The passes read only the
    stratum and key columns.
    """
    rates = _rates(percents)
    by = list(strata)
    hashed = df.select(*by, hash_key(seed, *key).alias("_hash"))
    rows = F.count(F.lit(1)).alias("_rows")

    digits = FIRST_DIGITS
    counted = hashed.groupBy(*by, F.substring("_hash", 1, digits).alias("_next")).agg(rows)
    sized = _placed(counted, by).withColumn("_n", F.sum("_rows").over(Window.partitionBy(*by)))
    goals = [F.struct(F.lit(p).alias("rate"), _goal(p).alias("room")) for p in rates]
    # Most slices are no rate's last one: only those that are become rows.
    ends_here = F.filter(
        F.array(*goals), lambda g: (F.col("_upto") >= g["room"]) & (F.col("_before") < g["room"])
    )
    asked = sized.select("*", F.explode(ends_here).alias("_g")).select(
        *by, "_next", "_rows", "_upto", "_before",
        F.col("_g.rate").alias("_rate"), F.col("_g.room").alias("_room"),
    )
    reached, size = cut_measured(_reached(asked), "sample-slices")

    while digits < HASH_DIGITS:
        largest = reached.agg(F.max("_rows")).first()[0] or 0
        deeper = _next_digits(digits, largest, slice_rows)
        wanted = reached.select(*by, F.col("_next").alias("_slice"), "_rate", "_room")
        parent = [*by, "_slice"]
        slices = wanted.select(*parent).distinct()
        sliced = hashed.withColumn("_slice", F.substring("_hash", 1, digits))
        inside = lookup_join(sliced, slices, parent, size, broadcast_rows)
        counted = inside.groupBy(*parent, F.substring("_hash", 1, deeper).alias("_next")).agg(rows)
        placed = _placed(counted, parent)
        asked = lookup_join(placed, wanted, parent, size, broadcast_rows)
        reached, size = cut_measured(_reached(asked).drop("_slice"), "sample-slices")
        digits = deeper

    cuts = reached.groupBy(*by).agg(
        *[F.max(F.when(F.col("_rate") == p, F.col("_next"))).alias(f"cut_{p}") for p in rates]
    )
    return cuts, size  # as many hashes as there were rows before


def _next_digits(digits: int, largest: int, slice_rows: int) -> int:
    """The whole hash for small slices, else as many digits as should make them small."""
    if largest <= slice_rows:
        return HASH_DIGITS
    more, expected = 1, largest / 16
    while expected > slice_rows and more < MORE_DIGITS:
        more, expected = more + 1, expected / 16
    return min(HASH_DIGITS, digits + more)


def _goal(percent: int) -> Column:
    """Rows to keep of ``_n``: the percentage rounded up, in whole numbers."""
    return F.expr(f"({percent} * _n + 99) div 100")


def nested_samples(
    df: DataFrame,
    strata: Sequence[str],
    key: Sequence[str],
    percents: Sequence[int],
    seed: int = 0,
    slice_rows: int = SLICE_ROWS,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """Rows of the largest sample, with ``first_rate``: the smallest rate that holds the row.

    The sample at rate r is ``first_rate <= r``, so each smaller one lies inside each larger one,
    and one table partitioned by ``first_rate`` stores the whole family once.
    """
    rates = _rates(percents)
    cuts, size = sample_cuts(df, strata, key, rates, seed, slice_rows, broadcast_rows)
    place, *limits = unused(df.columns, "_hash", *[f"cut_{p}" for p in rates])
    cuts = cuts.withColumnsRenamed({f"cut_{p}": limit for p, limit in zip(rates, limits, strict=True)})
    hashed = df.withColumn(place, hash_key(seed, *key))
    joined = lookup_join(hashed, cuts, list(strata), size, broadcast_rows)
    first = F.coalesce(
        *[F.when(F.col(place) <= F.col(limit), F.lit(p)) for p, limit in zip(rates, limits, strict=True)]
    )
    marked = joined.withColumn("first_rate", first).filter(F.col("first_rate").isNotNull())
    return marked.select(*df.columns, "first_rate")


def stratified_sample(
    df: DataFrame,
    strata: Sequence[str],
    key: Sequence[str],
    percent: int,
    seed: int = 0,
    slice_rows: int = SLICE_ROWS,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """Exactly ``ceil(percent * n / 100)`` rows of each stratum (see the module on equal keys)."""
    nested = nested_samples(df, strata, key, [percent], seed, slice_rows, broadcast_rows)
    return nested.drop("first_rate")


def hash_sample(df: DataFrame, key: Sequence[str], percent: float, seed: int = 0) -> DataFrame:
    """About ``percent`` of the rows by a threshold on the key's hash: a filter, no shuffle."""
    return df.filter(below_percent(hash_key(seed, *key), percent))


def hash_sample_by(
    df: DataFrame, stratum: str, percents: Mapping[object, float], key: Sequence[str], seed: int = 0
) -> DataFrame:
    """About ``percents[stratum]`` of each stratum's rows, none of a stratum not named."""
    row_hash = hash_key(seed, *key)
    kept = F.lit(False)
    for value, percent in percents.items():
        same = F.col(stratum).eqNullSafe(F.lit(value))
        kept = F.when(same, below_percent(row_hash, percent)).otherwise(kept)
    return df.filter(kept)


def random_sample_by(
    df: DataFrame, stratum: str, fractions: Mapping[object, float], seed: int
) -> DataFrame:
    """Spark's own ``sampleBy``: a random draw per row, which changes with the partitioning."""
    return df.sampleBy(stratum, dict(fractions), seed)
