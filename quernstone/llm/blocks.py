"""Tables of vectors as packed blocks, and a stated query set held against all rows block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.support.cut import cut_measured

QUERY_ROWS = 4096
# About the bytes of queries that a task of a search holds, and its tasks at most, unless the queries alone need more.
QUERY_BYTES = 8 * 1024 * 1024
TASKS = 8192


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>): rows with an id and a vector that is neither null nor empty and holds
    only finite numbers."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite)


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def block_count(rows: int, per_block: int) -> int:
    return max(1, -(-rows // per_block))


def pack(rows: DataFrame, count: int, per_block: int) -> DataFrame:
    """(dims, block, ids, data): about ``per_block`` vectors of one length in a row, by ascending id.

    Rows go to blocks by a hash of id and vector, so equal ids and hot vectors are spread.
    """
    block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(block_count(count, per_block)))

    def join(key: tuple, table: pa.Table) -> pa.Table:
        dims = key[0].as_py()
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        data = matrix(table.column("v"), dims)[order].astype(np.float64)
        return pa.table(
            {
                "dims": pa.array([dims], pa.int32()),
                "block": [key[1].as_py()],
                "ids": pa.array([ids[order].tobytes()], pa.binary()),
                "data": pa.array([data.tobytes()], pa.binary()),
            }
        )

    keyed = rows.select(F.size("v").alias("dims"), block.alias("block"), "vec_id", "v")
    return keyed.groupBy("dims", "block").applyInArrow(join, "dims int, block long, ids binary, data binary")


def search(
    rows: DataFrame,
    is_query: Column,
    k: int,
    per_block: int,
    best: Callable[[dict, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]],
    score_type: str,
    prepare: Callable[[DataFrame], DataFrame] = lambda blocks: blocks,
) -> DataFrame:
    """The k best rows (query_id, rank, vec_id, score) of each query, higher scores and smaller ids first.

    Each block of rows meets each block of queries of the same length once. ``best(block, ids, data)``
    gets a row of the prepared blocks and a block of queries, and returns at least the k best of its
    rows for each: query numbers, ids and scores. A row whose id is the query's own is no candidate;
    queries that share an id are searched one by one. A task reads some blocks of rows and about ``QUERY_BYTES``
    of queries where they lie, so no query is written once per block of rows or sent through the driver.
    """
    kept, size = cut_measured(rows, "vectors")
    asking = kept.filter(is_query)
    queries, asked = cut_measured(pack(asking, asking.count(), QUERY_ROWS), "queries")
    blocks = prepare(pack(kept, size.rows, per_block))
    columns = [c for c in blocks.columns if c != "dims"]
    q_parts = block_count(asked.bytes, QUERY_BYTES)
    parts = max(1, min(block_count(size.rows, per_block), TASKS // q_parts))
    sent = queries.select(
        F.col("dims").alias("_dims"),
        F.col("block").alias("q_block"),
        F.col("ids").alias("q_ids"),
        F.col("data").alias("q_data"),
    )
    # Numbered blocks are dealt out evenly. Every part of the rows meets every part of the queries; the hint keeps
    # Spark from a broadcast, whose size it would guess from the compressed file.
    held = blocks.repartitionById(parts, F.pmod("block", F.lit(parts)).cast("int")).hint("shuffle_replicate_nl")
    sent = sent.repartitionById(q_parts, F.pmod("q_block", F.lit(q_parts)).cast("int")).hint("shuffle_replicate_nl")
    pairs = held.join(sent, F.col("dims") == F.col("_dims"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                ids = np.frombuffer(row["q_ids"], np.int64)
                number, vec_id, value = best(row, ids, np.frombuffer(row["q_data"]).reshape(-1, row["dims"]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[number]),
                        pa.array(number.astype(np.int64) + (row["q_block"] << 32)),
                        pa.array(np.full(len(number), row["dims"], np.int32)),
                        pa.array(vec_id),
                        pa.array(value),
                    ],
                    ["query_id", "query_no", "dims", "vec_id", "score"],
                )

    found = pairs.select("dims", "q_block", "q_ids", "q_data", *columns).mapInArrow(
        score, f"query_id long, query_no long, dims int, vec_id long, score {score_type}"
    )
    order = Window.partitionBy("dims", "query_no").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest finite scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero((scores >= least) & (scores > -np.inf))
    else:
        at = np.flatnonzero(scores > -np.inf)
    return at[np.lexsort((ids[at], -scores[at]))][:k]
