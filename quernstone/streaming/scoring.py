"""Apply fitted steps to a streaming table, and keep running bucket counts of the result."""

from __future__ import annotations

from pyspark.ml.base import Transformer
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quernstone.operators.binning import bucket_distribution


def apply_steps(df: DataFrame, *steps: Transformer) -> DataFrame:
    """Apply fitted steps in order; works alike on a stream and on a table."""
    for step in steps:
        df = step.transform(df)
    return df


def append_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every new row to a Parquet table and stop when the input available is used up."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def running_bucket_counts(
    stream: DataFrame, bucket_column: str, name: str, checkpoint: str
) -> StreamingQuery:
    """Running rows per bucket in the in-memory table ``name``: one row per bucket."""
    return (
        bucket_distribution(stream, bucket_column)
        .writeStream.format("memory")
        .queryName(name)
        .option("checkpointLocation", checkpoint)
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )
