"""Benchmark of the headline operators: prints one JSON line.

Every input is projected, spread over the cores, persisted and counted before timing, but for the
steps named scan, csv, whole and write, which go from files to files or a sink. All steps are
run once to warm up, and each one three times more; the median counts. Fit and transform are timed
apart, and a transform ends in a ``noop`` write of its output, because ``count()`` would prune it.
``peers`` times Spark ML's own operators on the same cached input, ended the same way, next to the
step they compare with.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.ml import feature as ml  # noqa: E402
from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import quernstone as q  # noqa: E402
from quernstone.session import local_session  # noqa: E402
from quernstone.sources.tables import CSV_TIMES, csv_to_parquet, write_csv, write_rates  # noqa: E402
from quernstone.support.cut import scratch_path  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TAIL = [0.9, 0.95, 0.99]
VOCAB_SIZE = 200_000
RATES = list(range(5, 96, 10))


def write_out(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def median_time(step: Callable[[], object]) -> tuple[float, list[float]]:
    raw = []
    for _ in range(RUNS):
        start = time.perf_counter()
        step()
        raw.append(round(time.perf_counter() - start, 4))
    return statistics.median(raw), raw


def main() -> None:
    spark = local_session(CPUS, "bench")
    cores = spark.sparkContext.defaultParallelism

    def load(name: str, *columns) -> DataFrame:
        held = spark.read.parquet(f"{SF_DIR}/{name}.parquet").select(*columns)
        held = held.repartition(cores).persist()
        held.count()
        return held

    lineitem = load("lineitem", *FEATURES)
    events = load("events", "event_id", "ts", "value")
    documents = load("documents", "doc_id", "text")
    orders = load("orders", "o_orderkey", F.year("o_orderdate").alias("stratum"))

    scaler = q.StandardScaler(FEATURES)
    scaled = scaler.fit(lineitem)
    min_max = q.MinMaxScaler(FEATURES)
    tokens = q.Tokenizer().transform(documents)
    vectorizer = q.CountVectorizer(vocab_size=VOCAB_SIZE, min_df=2)
    counts = vectorizer.fit(tokens)
    by_value = q.QuantileDiscretizer(["value"])
    binned = by_value.fit(events)
    edges = q.bin_edges(events, "value", 10, "sketch", 0.01)
    cutter = q.CustomBinner({"value": edges}, include_lowest=True, duplicates="drop")
    joined = q.CountVectorizerModel(counts.vocabulary, local_terms=50_000)
    vectors = counts.transform(tokens).select("features")
    sparse_scaler = q.VectorStandardScaler(with_mean=False)
    whole_orders = spark.read.parquet(f"{SF_DIR}/orders.parquet").withColumn("stratum", F.year("o_orderdate"))
    whole_events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    csv_path, csv_schema = scratch_path(spark, "bench-csv"), whole_events.schema
    write_csv(whole_events, csv_path)

    def read_documents() -> DataFrame:
        return spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")

    start = F.unix_millis(F.col("ts").cast("timestamp"))
    end = start + F.ceil("value").cast("long") * 1000

    steps = {
        "scaler_fit": lambda: scaler.fit(lineitem),
        "scaler_transform": lambda: write_out(scaled.transform(lineitem)),
        "min_max_fit_transform": lambda: write_out(min_max.fit_transform(lineitem)),
        "tokenize": lambda: write_out(tokens),
        "vocabulary_fit_200k": lambda: vectorizer.fit(tokens),
        "count_vector_long_200k": lambda: write_out(counts.transform_long(tokens, ["doc_id"])),
        "count_vector_sparse_200k": lambda: write_out(counts.transform(tokens).select("features")),
        "exact_quantiles_tail": lambda: q.exact_quantiles(events, ["value"], TAIL),
        "exact_quantiles_4_columns": lambda: q.exact_quantiles(lineitem, FEATURES, TAIL),
        "approx_quantiles_gk": lambda: q.approx_quantiles(events, ["value"], TAIL, 0.001),
        "approx_quantiles_kll": lambda: q.sketch_quantiles(events, ["value"], TAIL, 1000),
        "discretizer_fit": lambda: by_value.fit(events),
        "discretizer_transform": lambda: write_out(binned.transform(events)),
        "custom_bins_transform": lambda: write_out(cutter.transform(events)),
        "bucket_counts": lambda: q.bucket_distribution(
            binned.transform(events), "value_bucket"
        ).collect(),
        "stratified_sample_exact": lambda: write_out(
            q.stratified_sample(orders, ["stratum"], ["o_orderkey"], 5, 7)
        ),
        "nested_samples_10_rates": lambda: write_out(
            q.nested_samples(orders, ["stratum"], ["o_orderkey"], RATES, 7)
        ),
        "hash_sample": lambda: write_out(q.hash_sample(orders, ["o_orderkey"], 15, 7)),
        "count_vector_joined_200k": lambda: write_out(joined.transform(tokens).select("features")),
        "vector_scaler_sparse": lambda: write_out(sparse_scaler.fit_transform(vectors)),
        "whole_row_sample": lambda: write_out(q.stratified_sample(whole_orders, ["stratum"], ["o_orderkey"], 5, 7)),
        # From files to files, nothing held in memory.
        "scan_scale_sink": lambda: write_out(
            scaler.fit_transform(spark.read.parquet(f"{SF_DIR}/lineitem.parquet").select(*FEATURES))
        ),
        "scan_vocabulary_sink": lambda: write_out(
            vectorizer.fit_transform(q.Tokenizer().transform(read_documents())).select("features")
        ),
        "csv_conversion": lambda: csv_to_parquet(spark, csv_path, scratch_path(spark, "bench"), csv_schema, **CSV_TIMES),
        "write_3_rates": lambda: write_rates(
            q.nested_samples(orders, ["stratum"], ["o_orderkey"], [5, 15, 25], 7), scratch_path(spark, "rates"), [5, 15, 25]
        ),
        "utilisation_by_minute": lambda: write_out(q.utilisation(events, start, end, 60_000)),
    }

    assembled = ml.VectorAssembler(inputCols=FEATURES, outputCol="features").transform(lineitem)
    assembled = assembled.select("features").persist()
    assembled.count()
    ml_scaler = ml.StandardScaler(
        inputCol="features", outputCol="scaled", withMean=True, withStd=True
    )
    ml_scaled = ml_scaler.fit(assembled)
    ml_tokens = ml.Tokenizer(inputCol="text", outputCol="tokens").transform(documents)
    ml_vectorizer = ml.CountVectorizer(
        inputCol="tokens", outputCol="features", vocabSize=VOCAB_SIZE, minDF=2
    )
    ml_counts = ml_vectorizer.fit(ml_tokens)
    ml_discretizer = ml.QuantileDiscretizer(
        inputCol="value", outputCol="bucket", numBuckets=10, relativeError=0.001
    )
    ml_binned = ml_discretizer.fit(events)
    peers = {
        "scaler_fit": lambda: ml_scaler.fit(assembled),
        "scaler_transform": lambda: write_out(ml_scaled.transform(assembled)),
        "tokenize": lambda: write_out(ml_tokens),
        "vocabulary_fit_200k": lambda: ml_vectorizer.fit(ml_tokens),
        "count_vector_sparse_200k": lambda: write_out(
            ml_counts.transform(ml_tokens).select("features")
        ),
        "exact_quantiles_tail": lambda: events.approxQuantile("value", TAIL, 0.0),
        "discretizer_fit": lambda: ml_discretizer.fit(events),
        "discretizer_transform": lambda: write_out(ml_binned.transform(events)),
    }

    for step in [*steps.values(), *peers.values()]:
        step()
    timed, peer_timed = {}, {}
    for name, step in steps.items():
        timed[name] = median_time(step)
        if name in peers:
            peer_timed[name] = median_time(peers[name])
    print(
        json.dumps(
            {
                "metric": "sum of median step times",
                "value": round(sum(t for t, _ in timed.values()), 4),
                "unit": "sec",
                "queries": {name: t for name, (t, _) in timed.items()},
                "sf": SF_DIR.rsplit("/sf", 1)[-1],
                "peers": {name: t for name, (t, _) in peer_timed.items()},
                "raw": {name: raw for name, (_, raw) in timed.items()},
                "rows": {
                    "lineitem": lineitem.count(),
                    "events": events.count(),
                    "documents": documents.count(),
                    "orders": orders.count(),
                },
                "cores": cores,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
