"""Sets of 64-bit hashes that tasks can ask, as Bloom filters of bounded size.

A larger set is cut into slices by the first bits of the hashes; each slice is a filter of its own, and what is not
in the slice passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from quernstone.llm.bytescan import BYTE_BASE, mixed

# Cells of a filter per hash, least and most (as powers of two), cells asked per hash, cells merged in one task.
CELLS = 16
LEAST_BITS, MOST_BITS = 16, 28
PROBES = 3
RANGE_BITS = 22


def _cells(hashes: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return mixed(hashes + np.uint64(probe * BYTE_BASE % (1 << 64))) >> np.uint64(64 - bits)


def slice_of(hashes: np.ndarray, split: int) -> np.ndarray:
    """The first ``split`` bits."""
    return hashes >> np.uint64(64 - split) if split else np.zeros(len(hashes), np.uint64)


@dataclass
class Filter:
    """``rows`` hashes of the column ``hash``, in 2**split slices of 2**bits cells."""

    entries: DataFrame
    rows: int
    split: int = field(init=False)
    bits: int = field(init=False)
    whole: Loaded | None = field(init=False, default=None)

    def __post_init__(self):
        wanted = max(LEAST_BITS, (CELLS * max(self.rows, 1) - 1).bit_length())
        self.bits = min(wanted, MOST_BITS)
        self.split = wanted - self.bits

    def load(self, number: int) -> Loaded:
        """One slice, built by ranges of cells. The driver holds its bits once, 2**MOST_BITS at most.

        A filter of one slice is built once.
        """
        if self.whole is not None:
            return self.whole
        bits, split = self.bits, self.split
        range_bits = min(RANGE_BITS, bits)

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hashes = batch.column("hash").to_numpy().view(np.uint64)
                hashes = hashes[slice_of(hashes, split) == number]
                cells = np.unique(np.concatenate([_cells(hashes, k, bits) for k in range(PROBES)]))
                of = cells >> np.uint64(range_bits)
                low = (cells & np.uint64((1 << range_bits) - 1)).astype("<u4")
                ranges = np.unique(of)
                ends = np.searchsorted(of, ranges, "right").tolist()
                packed = [low[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ranges.astype(np.int64)), pa.array(packed, pa.binary())], ["range", "cells"]
                )

        def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(1 << range_bits, bool)
            for batch in batches:
                for cells in batch.column("cells"):
                    held[np.frombuffer(cells.as_py(), "<u4")] = True
            bitmap = np.packbits(held, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([bitmap], pa.binary())], ["range", "bitmap"])

        partial = self.entries.select("hash").mapInArrow(build, "range long, cells binary")
        merged = partial.groupBy("range").applyInArrow(merge, "range long, bitmap binary")
        size = (1 << range_bits) // 8
        out = np.zeros((1 << bits) // 8, np.uint8)
        for part in merged.collect():  # 2**MOST_BITS bits at most
            out[part["range"] * size : (part["range"] + 1) * size] = np.frombuffer(part["bitmap"], np.uint8)
        loaded = Loaded(self.entries.sparkSession.sparkContext.broadcast(out), bits, split, number)
        if not split:
            self.whole = loaded
        return loaded

    def release(self, loaded: Loaded) -> None:
        """Free a slice of several that has been used."""
        if self.split:
            loaded.bitmap.unpersist()

    def covering(self, run: int, split: int) -> Loaded:
        """The slice that holds all hashes with these first bits, ``split`` or more than the filter's."""
        return self.load(run >> split - self.split)


@dataclass(frozen=True)
class Loaded:
    """A slice inside a task."""

    bitmap: Broadcast
    bits: int
    split: int
    number: int

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        """False where a hash is surely not in the set; hashes of other slices pass."""
        out = np.ones(len(hashes), bool)
        at = np.flatnonzero(slice_of(hashes, self.split) == self.number)
        held = self.bitmap.value
        for k in range(PROBES):
            cell = _cells(hashes[at], k, self.bits)
            hit = (held[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            out[at[~hit]] = False
            at = at[hit]
        return out
