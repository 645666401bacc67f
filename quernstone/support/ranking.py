"""Positions in a total order and running sums, without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.support.cut import Size, cut

# Up to this measured size a single window task is cheaper than a range shuffle.
SINGLE_TASK_ROWS = 1_000_000
SINGLE_TASK_BYTES = 256 * 1024 * 1024

# Positions per block of the running sum, and levels of blocks.
BLOCK = 4096
LEVELS = 3


def rank_rows(
    df: DataFrame,
    order: list[Column],
    index: str,
    size: Size,
    limit: int | None = None,
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> DataFrame:
    """Add the 0-based position of each row in ``order`` and keep the first ``limit``.

    ``order`` must be a total order and ``size`` a measured bound on ``df``. Small inputs use one
    window. Larger ones are range-partitioned on the order; the position is the row number inside
    the range plus the sizes of all ranges before it. It is an ``int``: more rows than that can
    number fail the query.
    """
    place = F.row_number().over(Window.orderBy(*order))
    if size.rows <= single_task_rows and size.bytes <= SINGLE_TASK_BYTES:
        ranked = df.withColumn("_place", place)
        if limit is not None:
            # In this form Spark drops rows past the limit in every task, before the window.
            ranked = ranked.filter(F.col("_place") <= limit)
        return ranked.withColumn(index, F.col("_place") - 1).drop("_place")
    placed = cut(
        df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    sizes = placed.groupBy("_range").count().orderBy("_range").collect()  # one row per range
    starts, before = [], 0
    for row in sizes:
        if limit is None or before < limit:
            starts.append((row["_range"], before))
        before += row["count"]
    offsets = df.sparkSession.createDataFrame(starts, "_range int, _before long")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    ranked = (
        placed.join(F.broadcast(offsets), "_range")
        .withColumn(index, (inside - 1 + F.col("_before")).cast("int"))
        .drop("_range", "_before")
    )
    return ranked if limit is None else ranked.filter(F.col(index) < limit)


def running_sum_before(
    df: DataFrame, position: str, amount: str, total: str, following: str
) -> DataFrame:
    """Add the sum of ``amount`` over all smaller positions, and the next larger position.

    ``position`` is an integer, unique per row. Rows are summed inside blocks of consecutive
    positions, blocks inside blocks of blocks and those once more, so the only unpartitioned window
    has one row per 4096**3 positions.
    """
    rows = df.withColumnsRenamed({position: "_at", amount: "_amount"})
    summed = _sums_before(rows.withColumn("_first", F.col("_at")), LEVELS)
    return summed.select(
        *[F.col({position: "_at", amount: "_amount"}.get(c, c)).alias(c) for c in df.columns],
        F.col("_before").alias(total),
        F.col("_next").alias(following),
    )


def _sums_before(rows: DataFrame, levels: int) -> DataFrame:
    """Add ``_before``, the sum of ``_amount`` at smaller ``_at``, and ``_next``, the next ``_first``."""
    if levels == 0:
        place = Window.orderBy("_at")
    else:
        rows = rows.withColumn("_block", F.floor(F.col("_at") / BLOCK).cast("long"))
        place = Window.partitionBy("_block").orderBy("_at")
    smaller = place.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns(
        {"_before": F.coalesce(F.sum("_amount").over(smaller), F.lit(0)), "_next": F.lead("_first").over(place)}
    )
    if levels == 0:
        return local
    blocks = rows.groupBy("_block").agg(F.sum("_amount").alias("_amount"), F.min("_first").alias("_first"))
    above = _sums_before(blocks.withColumnRenamed("_block", "_at"), levels - 1).select(
        F.col("_at").alias("_block"), F.col("_before").alias("_earlier"), F.col("_next").alias("_later")
    )
    joined = local.join(above, "_block")
    return joined.withColumns(
        {"_before": F.col("_before") + F.col("_earlier"), "_next": F.coalesce("_next", "_later")}
    ).drop("_block", "_earlier", "_later")
