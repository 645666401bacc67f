"""Parquet and CSV tables on any file system Spark can reach (``s3a://``, ``hdfs://``, ``file:``).

Credentials and endpoints are Spark settings (``spark.hadoop.fs.s3a.*``) of the session.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quernstone.support.cut import scratch_path


def read_parquet(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    schema: StructType | str | None = None,
) -> DataFrame:
    """Scan a Parquet table; with ``columns`` the scan reads only those."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    table = reader.parquet(path)
    return table if columns is None else table.select(*columns)


# Rows from which a table that few tasks would read is dealt out anew.
SPREAD_ROWS = 20_000
# Tasks per core that it is dealt out to.
SPREAD_TASKS = 4


def spread_rows(df: DataFrame, by: Sequence[str], least_rows: int = SPREAD_ROWS) -> DataFrame:
    """``df``, dealt out by a hash of the columns ``by`` if one task would read over twice a core's even share of it.

    One task reads a Parquet row group, and a file may hold all its rows in one. The rows of each task are counted from
    footers, by a job that reads no column. A table that many tasks read, or of few rows, is returned as it is. Rows equal
    in ``by`` come to one task, so it should name a key.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    tasks = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"))
    seen = tasks.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    if not seen["rows"] or seen["rows"] < least_rows or seen["most"] * cores <= 2 * seen["rows"]:
        return df
    return df.repartition(SPREAD_TASKS * cores, *by)


def read_rate(
    spark: SparkSession, base: str, rate: int, columns: Sequence[str] | None = None
) -> DataFrame:
    """Scan the table stored for one sample rate, ``<base>/<rate>``."""
    return read_parquet(spark, f"{base.rstrip('/')}/{rate}", columns)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_rates(df: DataFrame, base: str, percents: Sequence[int]) -> None:
    """Write one table per rate, ``<base>/<rate>``, from the result of ``nested_samples``.

    The family is computed and written once; each rate copies its partitions of it.
    """
    path = scratch_path(df.sparkSession, "family")
    write_nested(df, path)
    for rate in percents:
        write_parquet(read_nested(df.sparkSession, path, rate), f"{base.rstrip('/')}/{rate}")


def write_nested(df: DataFrame, path: str) -> None:
    """Write the result of ``nested_samples`` once, partitioned by ``first_rate``."""
    df.write.partitionBy("first_rate").parquet(path)


def read_nested(
    spark: SparkSession, path: str, rate: int, columns: Sequence[str] | None = None
) -> DataFrame:
    """The sample at ``rate`` from such a table; the other partitions are not read."""
    sample = spark.read.parquet(path).filter(F.col("first_rate") <= rate).drop("first_rate")
    return sample if columns is None else sample.select(*columns)


# Times with all six digits of a second and their zone.
CSV_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    null_value: str = "NA",
    header: bool = True,
    quote: str = '"',
    escape: str = '"',
    multi_line: bool = False,
    empty_value: str = "",
    **options: str,
) -> DataFrame:
    """Scan CSV files under a declared schema, so that nothing is read twice to guess types.

    A quote inside a quoted value is doubled, unless ``escape`` says otherwise. ``multi_line`` allows
    line breaks in quoted values, at the price that a file is not split over tasks. Further options
    are Spark's.
    """
    return spark.read.schema(schema).options(**options).csv(
        path,
        header=header,
        nullValue=null_value,
        mode="FAILFAST",
        enforceSchema=False,
        quote=quote,
        escape=escape,
        multiLine=multi_line,
        emptyValue=empty_value,
    )


def write_csv(df: DataFrame, path: str, null_value: str = "NA", quote: str = '"', escape: str = '"') -> None:
    """Write CSV files that ``read_csv`` with the times of ``CSV_TIMES`` reads back as they were."""
    df.write.options(**CSV_TIMES).csv(
        path,
        header=True,
        nullValue=null_value,
        emptyValue="",
        quote=quote,
        escape=escape,
        quoteAll=True,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def csv_to_parquet(
    spark: SparkSession,
    csv_path: str,
    parquet_path: str,
    schema: StructType | str,
    null_value: str = "NA",
    **options,
) -> DataFrame:
    """Convert CSV files to a Parquet table and return the table. Options are those of ``read_csv``."""
    read_csv(spark, csv_path, schema, null_value, **options).write.parquet(parquet_path)
    return spark.read.parquet(parquet_path)
