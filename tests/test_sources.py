"""CSV conversion, and fitted steps on a stream."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import quernstone as q
from quernstone.plans import tables
from quernstone.sources import quoted
from quernstone.sources.quoted import quoted_csv_to_parquet, quoted_records, read_quoted_csv
from quernstone.sources.tables import csv_to_parquet, read_parquet, spread_rows, write_csv
from quernstone.streaming.scoring import append_to_parquet, apply_steps

SCHEMA = "year int, delay double, note string"


def test_csv_becomes_the_same_table(spark, tmp_path):
    (tmp_path / "in.csv").write_text('year,delay,note\n1999,1.5,"a, b"\n2000,NA,NA\n2001,-3,\n')
    table = csv_to_parquet(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), SCHEMA)
    assert [f.dataType.simpleString() for f in table.schema] == ["int", "double", "string"]
    rows = [tuple(r) for r in table.orderBy("year").collect()]
    assert rows == [(1999, 1.5, "a, b"), (2000, None, None), (2001, -3.0, None)]


def test_csv_that_breaks_its_schema_fails(spark, tmp_path):
    (tmp_path / "in.csv").write_text("year,delay,note\n1999,late,x\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ|malformed"):
        csv_to_parquet(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), SCHEMA)
    (tmp_path / "other.csv").write_text("delay,year,note\n1.5,1999,x\n")
    with pytest.raises(Exception):
        csv_to_parquet(spark, str(tmp_path / "other.csv"), str(tmp_path / "out2"), SCHEMA)


def test_stream_gives_the_rows_of_the_batch(spark, load, sf_dir, tmp_path):
    rows = load("events").select("event_id", "value")
    scaler = q.StandardScaler(["value"]).fit(rows)
    binner = q.QuantileDiscretizer(["scaled_value"], ["bin"]).fit(scaler.transform(rows))
    files = spark.readStream.schema(load("events").schema)
    stream = files.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    scored = apply_steps(stream.select("event_id", "value"), scaler, binner)
    assert scored.isStreaming
    out = str(tmp_path / "scored")
    append_to_parquet(scored, out, str(tmp_path / "progress")).awaitTermination()
    batch = apply_steps(rows, scaler, binner)
    written = read_parquet(spark, out, batch.columns)
    assert written.exceptAll(batch).count() == 0
    assert written.count() == batch.count()


ODD = [
    (1, 'plain, "quoted" and\nbroken\n\nlines', 1.5),
    (2, '"""', None),
    (3, "carriage\r\nreturn\rhere", -3.0),
    (4, "", 0.0),
    (5, None, 2.0),
    (6, "\n" * 40 + '"' * 9, 1e9),
    (7, "é漢🎉 " * 30, 7.0),
]


@pytest.mark.parametrize("block", [16, 57, 1000, 1 << 20])
def test_quoted_csv_in_blocks_of_any_size(spark, tmp_path, block):
    rows = [(i * 10 + k, note, delay) for i in range(6) for k, note, delay in ODD]
    frame = spark.createDataFrame(rows, "id int, note string, delay double")
    write_csv(frame.coalesce(1), str(tmp_path / "in"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        records = quoted_records(spark, str(tmp_path / "in"))
        if block < 1000:
            assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 4
        assert sorted(r.record for r in records.select("record").collect()) == list(range(1, len(rows) + 2))
        good, bad = read_quoted_csv(spark, str(tmp_path / "in"), frame.schema)
        assert sorted(map(tuple, good.collect())) == sorted(rows) and bad.count() == 0
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_quoted_csv_in_runs_of_few_lines(spark, tmp_path, monkeypatch):
    """Runs begin inside and outside of quotes, and a file's records are numbered across them."""
    monkeypatch.setattr(quoted, "RUN_BITS", 2)
    rows = [(i * 10 + k, note, delay) for i in range(9) for k, note, delay in ODD]
    frame = spark.createDataFrame(rows, "id int, note string, delay double")
    write_csv(frame.repartition(3), str(tmp_path / "in"))
    records = quoted_records(spark, str(tmp_path / "in"))
    ends = {r.file: (r.n, r.last) for r in records.groupBy("file").agg(F.count("*").alias("n"), F.max("record").alias("last")).collect()}
    assert len(ends) == 3 and all(n == last for n, last in ends.values())
    good, bad = read_quoted_csv(spark, str(tmp_path / "in"), frame.schema)
    assert sorted(map(tuple, good.collect())) == sorted(rows) and bad.count() == 0


def test_csv_of_documents_is_written_by_many_tasks(spark, load, tmp_path):
    """No task reads the whole table."""
    load("documents").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    written = []

    def kept(rows, path):
        written.append(path)
        write_csv(rows, path)

    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 16)
        spark.conf.set("spark.sql.files.openCostInBytes", 1 << 16)
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(tables, "write_csv", kept)
            got = tables.PLANS["csv_quoted_texts_in_parallel"].query(spark, str(tmp_path))
            assert got.count() == load("documents").count()
        files = spark.read.text(written).select(F.input_file_name()).distinct().count()
        assert files >= 5
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_bad_records_go_to_a_table_of_their_own(spark, tmp_path):
    text = 'year,delay,note\r\n1999,1.5,"a\r\nb"\r\n2000,late,x\r\n\r\n2001,NA,y\r\n2002,1,z,too,many\r\n2003,2,"torn\r\nend'
    (tmp_path / "in.csv").write_bytes(text.encode())
    table, number = quoted_csv_to_parquet(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), SCHEMA, str(tmp_path / "bad"))
    assert sorted(map(tuple, table.filter("year < 2003").collect())) == [(1999, 1.5, "a\r\nb"), (2001, None, "y")]
    bad = {r.record: r.value for r in spark.read.parquet(str(tmp_path / "bad")).collect()}
    assert number == len(bad) and bad[3] == "2000,late,x" and "2002,1,z,too,many" in bad.values()
    with pytest.raises(ValueError, match="record 3|record 6"):
        quoted_csv_to_parquet(spark, str(tmp_path / "in.csv"), str(tmp_path / "out2"), SCHEMA)
    (tmp_path / "empty.csv").write_text("")
    good, bad = read_quoted_csv(spark, str(tmp_path / "empty.csv"), SCHEMA)
    assert good.count() == bad.count() == 0


def tasks_of(df):
    return df.groupBy(F.spark_partition_id()).count().count()


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    """A file of one row group, which one task reads, and the same rows in many files, which stay as they are."""
    path = str(tmp_path / "one")
    spark.range(3000).coalesce(1).write.parquet(path)
    one = spark.read.parquet(path)
    assert tasks_of(one) == 1
    spread = spread_rows(one, ["id"], least_rows=3000)
    assert tasks_of(spread) >= 8 and spread.exceptAll(one).count() == 0 and spread.count() == 3000
    assert spread_rows(one, ["id"], least_rows=3001) is one
    many = spark.range(3000).repartition(16)
    assert spread_rows(many, ["id"], least_rows=0) is many
    none = one.filter("id < 0")
    assert spread_rows(none, ["id"], least_rows=0) is none
