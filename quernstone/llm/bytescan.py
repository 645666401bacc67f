"""Words of whole texts by scanning Arrow string buffers with numpy.

A word is a maximal run of bytes other than space and U+0009 to U+000D. A null text is empty.
Texts are looked at in slices of about a megabyte, so the working memory of a task is bounded by the
slice and by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

# Odd multipliers of the word and window hashes.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about ``limit`` bytes, one row at least."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes.astype(np.int64)) // limit
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for first, last in zip(cuts, cuts[1:], strict=False):
        if last > first:
            yield batch.slice(first, last - first)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offset at which each text begins (one more than rows)."""
    texts = pc.fill_null(pc.cast(column, pa.large_binary()), b"")
    if texts.offset or len(texts) == 0:
        texts = pa.array(texts.to_pylist(), pa.large_binary())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1) if len(texts) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[bounds[0] : bounds[-1]], bounds - bounds[0]


@dataclass(frozen=True)
class Words:
    """``starts`` and ``ends`` in ``data``; text i has the words from ``first[i]`` to ``first[i+1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(data: np.ndarray, bounds: np.ndarray, gaps: np.ndarray = SPACE) -> Words:
    """Runs of bytes outside ``gaps``, a table over the byte values."""
    solid = ~gaps[data]
    before = np.zeros_like(solid)
    before[1:] = solid[:-1]
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    after = np.zeros_like(solid)
    after[:-1] = solid[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, bounds))


def spaced(found: Words) -> Words:
    """The same words with exactly one space after each, so that runs of words are byte ranges."""
    keep = np.zeros(len(found.data) + 1, bool)
    keep[:-1] = ~SPACE[found.data]
    room = np.concatenate([found.data, np.zeros(1, np.uint8)])
    # The byte after a word is white space, or belongs to the next text: then one is put in.
    lengths = found.ends - found.starts
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    data = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
    inside = np.ones(len(data), bool)
    inside[ends] = False
    data[inside] = room[keep]
    return Words(data, starts, ends, found.first)


def powers(base: int, count: int) -> np.ndarray:
    """base ** i modulo 2 ** 64."""
    out = np.full(count, base, np.uint64)
    if count:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of 64 over all others."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


def range_hashes(terms: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of terms[start:end] for each pair, the same wherever the run stands."""
    # Sums of term * base**i; the difference of two is brought to a common position by the inverse.
    up = powers(base, len(terms))
    sums = np.zeros(len(terms) + 1, np.uint64)
    np.cumsum(terms * up, out=sums[1:])
    down = powers(pow(base, -1, 1 << 64), len(terms) + 1)
    return (sums[ends] - sums[starts]) * down[starts]


def word_hashes(found: Words, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word."""
    table = mixed(np.arange(1, 257, dtype=np.uint64) + np.uint64(seed << 32))
    base = (BYTE_BASE + 2 * seed * WORD_BASE) & _MASK | 1
    whole = range_hashes(table[found.data], found.starts, found.ends, base)
    return mixed(whole + (found.ends - found.starts).astype(np.uint64))
