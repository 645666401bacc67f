"""CSV files with line breaks inside quoted values, read by many tasks per file.

A line break ends a record where the quotes before it are even in number. Files are read as lines, block
by block; each run of lines of a block is counted by itself for both cases, an even and an odd number of quotes
before it, and running sums over the runs tell which case holds and how many records begin before. Lines that
are whole records are parsed where they are; only the lines of longer records are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quernstone.support.cut import cut, cut_measured
from quernstone.support.lookup import lookup_join

# Lines of a block that are counted together, at most (as a power of two).
RUN_BITS = 12


def quoted_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """``(file, record, value)``: the text of every record, numbered from 1 in each file.

    A quote inside a quoted value must be doubled. Line breaks are those of the file; one at the end of a record is not
    part of it. A file that ends inside a quoted value has all of its rest as one record.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    # A block as a whole would be one group, and blocks are too few to fall evenly on tasks.
    lines = lines.withColumn("run", F.shiftright("at", RUN_BITS))
    run = ["file", "block", "run"]
    quotes = (F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))).cast("long")
    in_run = Window.partitionBy(*run).orderBy("at")
    counted = lines.withColumn("quotes", quotes)
    before = F.sum("quotes").over(in_run) - F.col("quotes")
    placed = counted.withColumn("inside", before % 2).select(
        "*",
        # Records that begin up to this line, if the run begins outside of quotes, or inside.
        F.sum(1 - F.col("inside")).over(in_run).alias("outside_starts"),
        F.sum("inside").over(in_run).alias("inside_starts"),
    )
    placed = cut(placed, "lines")
    runs = placed.groupBy(*run).agg(
        F.sum("quotes").alias("quotes"),
        F.max("outside_starts").alias("outside_starts"),
        F.max("inside_starts").alias("inside_starts"),
    )
    along = Window.partitionBy("file").orderBy("block", "run")
    earlier = runs.withColumn("odd", (F.sum("quotes").over(along) - F.col("quotes")) % 2)
    starts = F.when(F.col("odd") == 0, F.col("outside_starts")).otherwise(F.col("inside_starts"))
    earlier = earlier.select(*run, "odd", (F.sum(starts).over(along) - starts).alias("first"))
    earlier, size = cut_measured(earlier, "runs")
    known = lookup_join(placed, earlier, run, size)
    own = F.when(F.col("odd") == 0, F.col("outside_starts")).otherwise(F.col("inside_starts"))
    begins = F.col("inside") == F.col("odd")
    numbered = known.select(
        "file", "block", "at", "value", (F.col("first") + own).alias("record"), (begins & (F.col("quotes") % 2 == 0)).alias("whole")
    )
    longer = numbered.filter(~F.col("whole")).groupBy("file", "record")
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "value")))
    joined = longer.agg(F.array_join(parts["value"], "\n").alias("value"))
    return numbered.filter("whole").select("file", "record", "value").unionByName(joined)


def read_quoted_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    null_value: str = "NA",
    header: bool = True,
    quote: str = '"',
    empty_value: str = "",
    **options: str,
) -> tuple[DataFrame, DataFrame]:
    """The rows of CSV files under a declared schema, and ``(file, record, value)`` of the records that break it.

    The same rows as ``read_csv`` with ``multi_line`` gives, but a file is read by many tasks, and a bad record ends
    nothing. With ``header`` the first record of each file is left out. Empty lines between records are no rows.
    """
    fields = spark.createDataFrame([], schema).schema.fields
    bad = "_bad"
    while any(f.name.lower() == bad for f in fields):
        bad += "_"
    declared = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{bad}` string"
    records = quoted_records(spark, path, quote)
    if header:
        records = records.filter(F.col("record") > 1)
    ended = F.when(F.endswith(F.col("value"), F.lit("\r")), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    records = records.withColumn("value", ended).filter(F.col("value") != "")
    settings = {
        "nullValue": null_value,
        "emptyValue": empty_value,
        "quote": quote,
        "escape": quote,
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": bad,
        # Line breaks inside values stay as they are.
        "multiLine": "true",
        **options,
    }
    parsed = records.withColumn("row", F.from_csv("value", declared, settings))
    broken: Column = F.col("row").isNull() | F.col("row")[bad].isNotNull()
    good = parsed.filter(~broken).select(*[F.col("row")[f.name].alias(f.name) for f in fields])
    return good, parsed.filter(broken).select("file", "record", "value")


def quoted_csv_to_parquet(
    spark: SparkSession,
    csv_path: str,
    parquet_path: str,
    schema: StructType | str,
    bad_path: str | None = None,
    **options: str,
) -> tuple[DataFrame, int]:
    """Convert such files to a Parquet table; return the table, and the number of records that broke the schema.

    They are written as a table to ``bad_path``; without one the first of them ends the job before anything
    is written. Options are those of ``read_quoted_csv``.
    """
    rows, bad = read_quoted_csv(spark, csv_path, schema, **options)
    if bad_path is None:
        first = bad.first()
        if first is not None:
            raise ValueError(f"record {first['record']} of {first['file']} breaks the schema")
        number = 0
    else:
        bad.write.parquet(bad_path)
        number = spark.read.parquet(bad_path).count()
    rows.write.parquet(parquet_path)
    return spark.read.parquet(parquet_path), number
