"""Exact top-k by term-at-a-time accumulation.

A block of rows is a set of postings: for each term (component) the rows where it is not zero and
their weights. The queries' weights of a term are scattered over its postings into dense arrays of
scores; after all terms the best of each query are selected, and merged over the blocks.
"""

from __future__ import annotations

from fractions import Fraction
from math import floor

import numpy as np
from pyspark.sql import Column, DataFrame

from quernstone.llm.blocks import search, top_rows

BLOCK_ROWS = 8192
# Queries accumulated together, so that their scores stay in a core's cache.
TILE = 32

# Doubles below it hold every whole number.
EXACT = 2.0**53


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of integral queries and rows, exactly, as doubles.

    Sums that could pass 2**53 must be told apart elsewhere; they are refused here.
    """
    bound = rows.shape[1] * float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0))
    if bound >= EXACT:
        raise OverflowError("scores may exceed 2**53")
    kind = np.float32 if bound < 2**24 else np.float64
    postings = []
    for term in range(rows.shape[1]):
        held = np.flatnonzero(rows[:, term])
        # A term that most rows hold is scattered to all of them.
        where = slice(None) if 2 * len(held) > len(rows) else held
        postings.append((where, rows[where, term].astype(kind)))
    scores = np.zeros((len(queries), len(rows)), kind)
    for at in range(0, len(queries), TILE):
        tile = scores[at : at + TILE]
        for term, (where, weights) in enumerate(postings):
            asked = queries[at : at + TILE, term].astype(kind)
            if len(weights) and asked.any():
                tile[:, where] += asked[:, None] * weights[None, :]
    return scores.astype(np.float64)


def weights(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * component); infinite where that is no double."""
    with np.errstate(over="ignore"):
        return np.floor(scale * vectors)


def whole_products(rows: np.ndarray, query: np.ndarray, scale: float) -> np.ndarray:
    """Inner products of weights of any size, as Python's whole numbers, term by term where 64 bits do not hold them."""
    plain, asked = weights(rows, scale), weights(query, scale)
    if rows.shape[1] * np.abs(plain).max(initial=0) * np.abs(asked).max(initial=0) < 2.0**62:
        return (plain.astype(np.int64) @ asked.astype(np.int64)).astype(object)
    total = np.zeros(len(rows), object)
    for term in np.flatnonzero(query):
        asked = floor(Fraction(float(query[term])) * Fraction(scale))
        held = np.flatnonzero(rows[:, term])
        total[held] += [asked * floor(Fraction(float(x)) * Fraction(scale)) for x in rows[held, term]]
    return total


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: float) -> DataFrame:
    """(query_id, rank, vec_id, score long): best k by the inner product of floor(scale * component).

    ``vectors`` has (vec_id long, v array<double>). Ties go to the smaller id; fewer candidates than k
    are all returned. Vectors of different lengths do not meet. Sums are exact at any size of the components, one
    by one where doubles could not tell them apart; a score among the best that no long holds fails the query.
    """

    def best(block: dict, q_ids: np.ndarray, q_data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.frombuffer(block["ids"], np.int64)
        data = np.frombuffer(block["data"]).reshape(len(ids), -1)
        rows, asked = weights(data, scale), weights(q_data, scale)
        # A row or query with large weights takes no other out of the dense scores.
        cap = np.sqrt(EXACT / (2 * rows.shape[1]))
        plain = np.flatnonzero(np.abs(asked).max(axis=1, initial=0) < cap)
        small = np.abs(rows).max(axis=1, initial=0) < cap
        small, large = np.flatnonzero(small), np.flatnonzero(~small)
        held, found = rows[small] if len(large) else rows, {}
        for at in range(0, len(plain), TILE):
            some = plain[at : at + TILE]
            scores = accumulate(asked[some], held)
            for i, own in zip(some, scores, strict=True):
                own[ids[small] == q_ids[i]] = -np.inf
                places = top_rows(own, ids[small], k)
                found[i] = (ids[small][places], own[places].astype(np.int64).astype(object))
        number, vec_id, score = [], [], []
        for i in range(len(q_ids)):
            near, own = found.get(i, (np.zeros(0, np.int64), np.zeros(0, object)))
            rest = large if i in found else np.arange(len(ids))
            rest = rest[ids[rest] != q_ids[i]]
            if len(rest):
                near, own = np.concatenate([near, ids[rest]]), np.concatenate([own, whole_products(data[rest], q_data[i], scale)])
            places = sorted(range(len(near)), key=lambda j, near=near, own=own: (-own[j], near[j]))[:k]
            number.append(np.full(len(places), i))
            vec_id.append(near[places])
            score.append(own[places])
        return np.concatenate(number), np.concatenate(vec_id), np.array(np.concatenate(score), np.int64)

    return search(vectors, is_query, k, BLOCK_ROWS, best, "long")
