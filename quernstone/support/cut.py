"""Cut lineage by writing a table in the folder named by ``spark.checkpoint.dir``.

A table that several later jobs read is written once to shared storage, so a lost
executor costs a re-read and never a second pass over the raw input.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructType

_SETTING = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables of this application."""
    root = spark.conf.get(_SETTING, None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {_SETTING} to a folder that every executor can reach")
        root = _local_root(spark.sparkContext.applicationId)
    return f"{root.rstrip('/')}/quernstone-{spark.sparkContext.applicationId}"


@cache
def _local_root(application: str) -> str:
    """A folder of a local application, whose tasks all run on this machine."""
    return tempfile.mkdtemp(prefix="quernstone-")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def row_width(schema: StructType) -> Column:
    """Bytes of a row's text, and 8 for every other field."""
    width = F.lit(0)
    for field in schema.fields:
        text = isinstance(field.dataType, (StringType, BinaryType))
        width = width + (F.coalesce(F.octet_length(field.name), F.lit(0)) if text else F.lit(8))
    return width


@dataclass(frozen=True)
class Size:
    """Measured size of a table."""

    rows: int
    bytes: int


def measure(table: DataFrame) -> Size:
    """Size by a counting job."""
    width = F.coalesce(F.sum(row_width(table.schema)), F.lit(0))
    row = table.agg(F.count(F.lit(1)).alias("rows"), width.alias("bytes")).first()
    return Size(row["rows"], row["bytes"])


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the scratch folder and return the table read back."""
    return cut_measured(df, label)[0]


def cut_measured(df: DataFrame, label: str) -> tuple[DataFrame, Size]:
    """The same, with the size observed by the writing job."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    seen = Observation()
    width = F.coalesce(F.sum(row_width(df.schema)), F.lit(0))
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), width.alias("bytes"))
    counted.write.parquet(path)
    size = Size(seen.get["rows"], seen.get["bytes"])
    return spark.read.schema(df.schema).parquet(path), size


def discard(table: DataFrame) -> None:
    """Delete the files of a table that ``cut`` wrote and that nothing will read again."""
    spark = table.sparkSession
    root = scratch_root(spark).split(":", 1)[-1].lstrip("/")
    folders = {file.rsplit("/", 1)[0] for file in table.inputFiles()}
    for folder in folders:
        if root in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
