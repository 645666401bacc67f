"""Sources, sinks, projection, caching and row counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators.features import FeatureAssembler, cached, project, row_count
from quernstone.operators.footers import footer_statistics
from quernstone.operators.scaling import StandardScaler
from quernstone.plans.registry import Plans, micros, table
from quernstone.sources.quoted import quoted_csv_to_parquet
from quernstone.sources.tables import (
    CSV_TIMES,
    csv_to_parquet,
    read_parquet,
    write_csv,
    write_parquet,
)
from quernstone.support.cut import scratch_path

PLANS = Plans()

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@PLANS.add(
    "SELECT l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem"
)
def parquet_projection(spark, sf_dir):
    return read_parquet(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", *FEATURES])


@PLANS.add("SELECT count(*) AS n_rows FROM lineitem")
def row_count_lineitem(spark, sf_dir):
    return row_count(table(spark, sf_dir, "lineitem"))


@PLANS.add(
    """
    SELECT count(*) AS row_count, min(l_orderkey) AS min_l_orderkey, max(l_orderkey) AS max_l_orderkey,
           min(l_linenumber) AS min_l_linenumber, max(l_linenumber) AS max_l_linenumber,
           min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity
    FROM lineitem
    """
)
def footer_counts_and_extremes(spark, sf_dir):
    """Row count and whole-number extremes from Parquet footers, those of doubles by a scan."""
    path = f"{sf_dir.rstrip('/')}/lineitem.parquet"
    return footer_statistics(spark, path, ["l_orderkey", "l_linenumber", "l_quantity"])


@PLANS.add(
    """
    SELECT l_orderkey, 4 AS width, l_quantity AS f0, l_extendedprice AS f1,
           l_discount AS f2, l_tax AS f3
    FROM lineitem
    """
)
def assemble_features(spark, sf_dir):
    rows = project(table(spark, sf_dir, "lineitem"), ["l_orderkey", *FEATURES])
    packed = FeatureAssembler(FEATURES).transform(rows)
    parts = [F.col("features")[i].alias(f"f{i}") for i in range(len(FEATURES))]
    return packed.select("l_orderkey", F.size("features").alias("width"), *parts)


@PLANS.add(
    """
    SELECT l_orderkey, l_quantity AS f0, nullif(l_discount, 0) AS f1
    FROM lineitem WHERE l_discount <> 0
    """
)
def assemble_features_skip(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", F.expr("nullif(l_discount, 0D)").alias("discount")
    )
    packed = FeatureAssembler(["l_quantity", "discount"], invalid="skip").transform(rows)
    return packed.select(
        "l_orderkey", F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1")
    )


@PLANS.add(
    """
    SELECT ddof, round(CASE ddof WHEN 1 THEN stddev_samp(l_quantity)
                       ELSE stddev_pop(l_quantity) END, 6) AS std
    FROM lineitem, (SELECT unnest([0, 1]) AS ddof) GROUP BY ddof
    """
)
def cached_refit(spark, sf_dir):
    """Two fits over one projected, cached input."""
    with cached(project(table(spark, sf_dir, "lineitem"), ["l_quantity"])) as held:
        fits = [(d, StandardScaler(["l_quantity"], ddof=d).fit(held)) for d in (0, 1)]
    found = [(d, m.std["l_quantity"]) for d, m in fits]
    return spark.createDataFrame(found, "ddof int, std double").withColumn(
        "std", F.round("std", 6)
    )


@PLANS.add(
    """
    SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type, props,
           CASE WHEN value >= 1 THEN value END AS value
    FROM events
    """
)
def csv_conversion(spark, sf_dir):
    """Write all of events as CSV with missing values, convert that to Parquet, read it back."""
    rows = table(spark, sf_dir, "events").withColumn("value", F.expr("CASE WHEN value >= 1 THEN value END"))
    csv_path = scratch_path(spark, "events-csv")
    write_csv(rows, csv_path)
    back = csv_to_parquet(spark, csv_path, scratch_path(spark, "events"), rows.schema, **CSV_TIMES)
    return back.withColumn("ts_us", micros("ts")).drop("ts")


@PLANS.add(
    """
    SELECT doc_id, n_chars, lang, source, md5(concat(text, ' "said", ', chr(10), lang)) AS text_md5 FROM documents
    """
)
def csv_quoted_texts(spark, sf_dir):
    """Whole texts with quotes, separators and line breaks by way of CSV."""
    quoted = F.concat("text", F.lit(' "said", \n'), "lang").alias("text")
    rows = table(spark, sf_dir, "documents").select("doc_id", quoted, "lang", "source", "n_chars")
    csv_path = scratch_path(spark, "documents-csv")
    write_csv(rows, csv_path)
    path = scratch_path(spark, "documents")
    back = csv_to_parquet(spark, csv_path, path, rows.schema, multi_line=True)
    return back.select("doc_id", "n_chars", "lang", "source", F.md5("text").alias("text_md5"))


@PLANS.add(
    """
    SELECT doc_id, n_chars, lang, source, md5(concat(text, ' "said", ', chr(10), lang)) AS text_md5, 0::BIGINT AS bad
    FROM documents
    """
)
def csv_quoted_texts_in_parallel(spark, sf_dir):
    """The same with each file read by lines, in as many tasks as it has blocks."""
    quoted = F.concat("text", F.lit(' "said", \n'), "lang").alias("text")
    rows = table(spark, sf_dir, "documents").select("doc_id", quoted, "lang", "source", "n_chars")
    csv_path = scratch_path(spark, "documents-csv")
    write_csv(rows, csv_path)
    path, bad_path = scratch_path(spark, "documents"), scratch_path(spark, "documents-bad")
    back, bad = quoted_csv_to_parquet(spark, csv_path, path, rows.schema, bad_path)
    return back.select("doc_id", "n_chars", "lang", "source", F.md5("text").alias("text_md5"), F.lit(bad).cast("long").alias("bad"))


@PLANS.add(
    """
    SELECT l_orderkey,
           round((l_quantity - (SELECT avg(l_quantity) FROM lineitem))
                 / (SELECT stddev_samp(l_quantity) FROM lineitem), 6) AS scaled_l_quantity
    FROM lineitem
    """
)
def parquet_sink(spark, sf_dir):
    """Write a transformed table and read it back."""
    rows = project(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_quantity"])
    path = scratch_path(spark, "scaled")
    write_parquet(StandardScaler(["l_quantity"]).fit_transform(rows), path)
    written = read_parquet(spark, path, ["l_orderkey", "scaled_l_quantity"])
    return written.withColumn("scaled_l_quantity", F.round("scaled_l_quantity", 6))
