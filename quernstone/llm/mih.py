"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: a learned rotation of the principal axes, then signs. A code is split
into substrings, each indexed by its value. Codes within a radius of the query's agree with it in
some substring up to that substring's share of the radius, so probing all values that near finds every one of
them; what is found is checked by the whole code and reranked by the vectors themselves. The
rotation and the radius are learned from a bounded sample; all rows are indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.blocks import search, top_rows

BITS = 64
SUBSTRINGS = 4
WIDTH = BITS // SUBSTRINGS
BLOCK_ROWS = 16_384

# Vectors of each length that rotation and radius are learned from, at most, and those asked.
SAMPLE = 8192
SAMPLE_QUERIES = 256
ROTATIONS = 40
# Share of the sample's neighbours that the radius takes in.
COVERED = 0.96


@dataclass(frozen=True)
class Coder:
    """Signs of (v - mean) @ axes are the code; codes within ``radius`` bits are looked at."""

    mean: np.ndarray
    axes: np.ndarray
    radius: int

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        signs = np.zeros((len(vectors), BITS), bool)
        signs[:, : self.axes.shape[1]] = (vectors - self.mean) @ self.axes > 0
        return np.packbits(signs, axis=1, bitorder="little").view(np.uint64)[:, 0]


def learn(sample: np.ndarray, total: int, k: int, seed: int = 5) -> Coder:
    """Rotation that brings the principal axes nearest to their signs, and the radius.

    The radius covers neighbours whose rank in the sample is that of the k-th in ``total`` rows.
    """
    if not len(sample):
        sample = np.zeros((1, sample.shape[1]))
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :BITS]
    flat = centred @ axes
    random = np.random.default_rng(seed)
    turn = np.linalg.qr(random.normal(size=(axes.shape[1], axes.shape[1])))[0]
    for _ in range(ROTATIONS):
        left, _, right = np.linalg.svd(np.sign(flat @ turn).T @ flat)
        turn = (left @ right).T
    coder = Coder(mean, axes @ turn, 0)
    # Drawn at random: ids that lie together may be alike.
    codes, asked = coder.codes(sample), random.permutation(len(sample))[:SAMPLE_QUERIES]
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    near = min(len(sample) - 1, max(1, round(k * len(sample) / max(total, 1))))
    if near < 1:
        return coder
    best = np.argpartition(-scores, near - 1, axis=1)[:, :near]
    away = np.bitwise_count(codes[asked][:, None] ^ codes[best])
    return Coder(mean, coder.axes, int(np.quantile(away, COVERED, method="higher")))


@cache
def _masks() -> tuple[np.ndarray, np.ndarray]:
    """All masks of a substring, fewest bits first, and how many have up to t bits."""
    every = np.arange(1 << WIDTH, dtype=np.uint32)
    bits = np.bitwise_count(every)
    return every[np.argsort(bits, kind="stable")], np.cumsum(np.bincount(bits))


def shares(radius: int) -> list[int]:
    """Bits that each substring may differ in, so that no code within the radius is missed; -1: none."""
    whole, more = divmod(radius + 1, SUBSTRINGS)
    return [whole - 1 + (s < more) for s in range(SUBSTRINGS)]


def substring_values(codes: np.ndarray) -> np.ndarray:
    return codes.view(np.uint16).reshape(-1, SUBSTRINGS).T


def probe(code: np.uint64, index: list[tuple[np.ndarray, np.ndarray]], radius: int) -> np.ndarray:
    """Rows that share a value near enough with the code in some substring (each once)."""
    masks, upto = _masks()
    found = []
    parts = substring_values(np.array([code], np.uint64))[:, 0]
    for part, share, (order, starts) in zip(parts, shares(radius), index, strict=True):
        if share < 0:
            continue
        values = masks[: upto[min(share, WIDTH)]] ^ np.uint32(part)
        begin, size = starts[values], starts[values + 1] - starts[values]
        some = size > 0
        begin, size = begin[some], size[some]
        at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        found.append(order[at])
    seen = np.zeros(len(index[0][0]), bool)
    for rows in found:
        seen[rows] = True
    return np.flatnonzero(seen)


def nearest(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score double): up to k rows of largest inner product found per query.

    ``vectors`` has (vec_id long, v array<double>) without zero vectors. A block that holds fewer than k
    codes within the radius is probed further until it gives k or all it has, so no query goes
    short. Vectors of different lengths do not meet. Equal scores go by the smaller id; queries that share an id are
    searched one by one, and no row with a query's own id is found.
    """
    lengths = vectors.groupBy(F.size("v").alias("dims")).count().collect()  # one row per vector length
    coders = {}
    for row in lengths:
        own = vectors.filter(F.size("v") == row["dims"])
        # By a threshold on the hash, a little below the bound, so that nothing has to be ordered.
        below = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < int(min(1.0, 0.95 * SAMPLE / row["count"]) * (1 << 30))
        sample = (own.filter(below) if row["count"] > SAMPLE else own).limit(SAMPLE).collect()
        sample = np.array([r["v"] for r in sorted(sample)], np.float64)
        coders[row["dims"]] = learn(sample.reshape(-1, row["dims"]), row["count"], k)

    def index(blocks: DataFrame) -> DataFrame:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes, orders, starts = [], [], []
                for dims, data in zip(batch.column("dims").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    code = coders[dims].codes(np.frombuffer(data).reshape(-1, dims))
                    parts = substring_values(code)
                    order = np.argsort(parts, axis=1, kind="stable").astype(np.int32)
                    begin = [np.searchsorted(p[o], np.arange((1 << WIDTH) + 1)) for p, o in zip(parts, order, strict=True)]
                    codes.append(code.tobytes())
                    orders.append(order.tobytes())
                    starts.append(np.array(begin, np.int32).tobytes())
                more = [pa.array(c, pa.binary()) for c in (codes, orders, starts)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "codes", "orders", "starts"])

        return blocks.mapInArrow(add, "dims int, block long, ids binary, data binary, codes binary, orders binary, starts binary")

    def best(block: dict, q_ids: np.ndarray, q_data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, codes = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["codes"], np.uint64)
        data, coder = np.frombuffer(block["data"]).reshape(len(ids), -1), coders[block["dims"]]
        orders = np.frombuffer(block["orders"], np.int32).reshape(SUBSTRINGS, -1)
        starts = np.frombuffer(block["starts"], np.int32).reshape(SUBSTRINGS, -1)
        tables = list(zip(orders, starts, strict=True))
        number, vec_id, score = [], [], []
        for i, code in enumerate(coder.codes(q_data)):
            radius = coder.radius
            while True:
                rows = probe(code, tables, radius)
                rows = rows[(np.bitwise_count(codes[rows] ^ code) <= radius) & (ids[rows] != q_ids[i])]
                if len(rows) >= k or radius >= BITS:
                    break
                radius = min(BITS, radius + SUBSTRINGS)
            # Summed row by row, so that equal vectors have equal scores.
            own = (data[rows] * q_data[i]).sum(axis=1)
            places = top_rows(own, ids[rows], k)
            number.append(np.full(len(places), i))
            vec_id.append(ids[rows][places])
            score.append(own[places])
        return np.concatenate(number), np.concatenate(vec_id), np.concatenate(score)

    return search(vectors, is_query, k, BLOCK_ROWS, best, "double", index)
