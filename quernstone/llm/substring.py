"""Substring deduplication: words covered by a window that starts in an earlier document go.

Texts that equal an earlier one's are known to go whole, so only the first of equal texts is looked into. A
count-min sketch of its windows, built per task and merged by ranges of cells, overestimates how many texts
hold each one. A window is counted through its anchor, the least hash among the shorter runs of words in
it: equal windows have equal anchors, and neighbours mostly share one, so the sketch has an entry for few
windows in a hundred. Its cells grow with the corpus and stay in the tasks that merge them; what
tasks are told is the few cells counted twice, in a Bloom filter, slice by slice beyond its bound. Only windows
estimated to occur twice are grouped exactly, by 96 bits of hash. Windows are reduced to their least
document before the shuffle, and a hot window meets that in a join whose partitions Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.bloom import Filter, Loaded, slice_of
from quernstone.llm.bytescan import (
    BYTE_BASE,
    WORD_BASE,
    Words,
    flat,
    mixed,
    range_hashes,
    slices,
    spaced,
    word_hashes,
    words,
)
from quernstone.support.cut import Size, cut, cut_measured
from quernstone.support.lookup import lookup_join

WINDOW = 50

# Rows of the sketch, and cells of a row: 16 an anchor for one in 80 bytes of text, within these powers of two.
ROWS = 2
LEAST_BITS, MOST_BITS = 16, 60
CELLS, BYTES_PER_ANCHOR = 16, 80
# Cells merged in one task.
RANGE_BITS = 22
# Anchors that a task gathers before it hands them on.
GATHERED = 1 << 20

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 16 << 20


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(found: Words, own: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """First word of every window, the text it is in, and its anchor.

    The anchor is the least hash of the runs of half as many words in the window.
    """
    gram = max(1, window // 2)
    counts = found.counts
    per_text = np.maximum(counts - window + 1, 0)
    row = np.repeat(np.arange(len(counts)), per_text)
    place = np.arange(len(row)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    first = found.first[:-1][row] + place
    if not len(first):
        return first, row, np.zeros(0, np.uint64)
    at = np.arange(len(own) - gram + 1)
    # Runs across two texts are in no window.
    least = _least_of(mixed(range_hashes(own, at, at + gram, WORD_BASE)), window - gram + 1)
    return first, row, least[first]


def _runs(row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Where a new text or anchor begins."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
    return np.flatnonzero(new)


def _cell(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mixed(hashes + np.uint64(row)) >> np.uint64(64 - bits)


def _cell_hash(cells: np.ndarray, row: int) -> np.ndarray:
    return mixed(cells << np.uint64(1) | np.uint64(row))


def sketch(docs: DataFrame, window: int, bits: int) -> Filter:
    """The cells of all rows that count two texts or more, over all documents."""
    range_bits = min(RANGE_BITS, bits)

    def packed(row: int, cells: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Ascending cells by range, as their low bits."""
        part = cells >> np.uint64(range_bits)
        parts = np.unique(part)
        begin, end = np.searchsorted(part, parts), np.searchsorted(part, parts, "right")
        low = (cells & np.uint64((1 << range_bits) - 1)).astype("<u4")
        pieces = [low[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        columns = [np.full(len(parts), row), parts.astype(np.int64)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(pieces, pa.binary())], ["row", "range", "cells"])

    def handed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate(held)
        for row in range(ROWS):
            cells = np.sort(_cell(hashes, row, bits))
            new = np.ones(len(cells), bool)
            new[1:] = cells[1:] != cells[:-1]
            # Twice in one task is as good as any number of times.
            for some in (cells[new], np.unique(cells[~new])):
                yield from packed(row, some)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, gathered = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                found = words(*flat(part.column("text")))
                _, row, anchor = anchors(found, word_hashes(found), window)
                at = _runs(row, anchor)
                row, anchor = row[at], anchor[at]
                order = np.lexsort((anchor, row))
                row, anchor = row[order], anchor[order]
                # Each text counts an anchor once.
                held.append(anchor[_runs(row, anchor)])
                gathered += len(held[-1])
                if gathered > GATHERED:
                    yield from handed(held)
                    held, gathered = [], 0
        if held:
            yield from handed(held)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, part = key[0].as_py(), key[1].as_py()
        counts = np.zeros(1 << range_bits, np.uint8)
        for batch in batches:
            for some in batch.column("cells"):
                cells = np.frombuffer(some.as_py(), "<u4")
                counts[cells] = np.minimum(counts[cells] + 1, 2)
        several = np.flatnonzero(counts == 2).astype(np.uint64) | np.uint64(part << range_bits)
        yield pa.RecordBatch.from_arrays([pa.array(_cell_hash(several, row).view(np.int64))], ["hash"])

    partial = docs.select("text").mapInArrow(build, "row long, range long, cells binary")
    several, size = cut_measured(partial.groupBy("row", "range").applyInArrow(merge, "hash long"), "several")
    return Filter(several, size.rows)


def proposed_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(hash, check, doc_id, text_key, place) of all windows that the sketch estimates to be in two texts or more."""
    letters = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip((CELLS * max(letters, 1) // BYTES_PER_ANCHOR).bit_length(), LEAST_BITS, MOST_BITS))
    several = sketch(docs, window, bits)
    loaded = [several.load(number) for number in range(1 << several.split)]

    def propose(some: Loaded):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    found = words(*flat(part.column("text")))
                    own = word_hashes(found)
                    first, row, anchor = anchors(found, own, window)
                    runs = _runs(row, anchor)
                    cells = [_cell_hash(_cell(anchor[runs], k, bits), k) for k in range(ROWS)]
                    likely = slice_of(cells[0], some.split) == some.number
                    for hashes in cells:
                        likely &= some.passes(hashes)
                    at = np.flatnonzero(np.repeat(likely, np.diff(runs, append=len(row))))
                    begin, end = first[at], first[at] + window
                    hashes = mixed(range_hashes(own, begin, end, WORD_BASE))
                    other = mixed(own ^ np.uint64(BYTE_BASE))
                    checks = mixed(range_hashes(other, begin, end, BYTE_BASE)).astype(np.uint32)
                    where = pa.array(row[at])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(hashes.view(np.int64)),
                            pa.array(checks.view(np.int32)),
                            part.column("doc_id").take(where),
                            part.column("text_key").take(where),
                            pa.array((begin - found.first[row[at]]).astype(np.int32)),
                        ],
                        ["hash", "check", "doc_id", "text_key", "place"],
                    )

        return scan

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"hash long, check int, doc_id {kind}, text_key long, place int"
    source = docs.select("doc_id", "text_key", "text")
    return reduce(DataFrame.unionByName, [source.mapInArrow(propose(some), schema) for some in loaded])


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, spans): words to remove, as pairs of 32-bit word numbers, the end exclusive.

    ``docs`` has doc_id, text and text_key. A word goes if a window over it also starts in a document with a
    smaller id; a null id is larger than all others. Rows that share id and text share their spans.
    """
    # Proposed twice, which costs less than keeping them.
    proposed = proposed_windows(docs, window)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for places in batch.column("places"):
                at = np.unique(places.values.to_numpy())
                new = np.flatnonzero(np.diff(at, prepend=at[:1] - window - 1) > window)
                end = at[np.append(new[1:], len(at)) - 1] + window
                packed.append(np.stack([at[new], end], 1).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(packed, pa.binary())],
                ["doc_id", "text_key", "spans"],
            )

    groups = proposed.groupBy("hash", "check").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max(F.col("doc_id").isNull()).alias("nulls")
    )
    groups = groups.filter(F.col("least").isNotNull() & (F.col("nulls") | (F.col("least") < F.col("most"))))
    # Written, so that both sides of the join are shuffled and Spark can split a hot window.
    groups = cut(groups.select(F.col("hash").alias("_hash"), F.col("check").alias("_check"), "least"), "windows")
    again = proposed.join(groups, (F.col("hash") == F.col("_hash")) & (F.col("check") == F.col("_check")))
    again = again.filter(F.col("doc_id").isNull() | (F.col("least") < F.col("doc_id")))
    gathered = again.groupBy("doc_id", "text_key").agg(F.collect_list("place").alias("places"))
    return gathered.mapInArrow(join_runs, f"doc_id {kind}, text_key long, spans binary")


def _later_copies(keyed: DataFrame) -> DataFrame:
    """(doc_id, text_key) of rows whose whole text also is that of a smaller id."""
    groups = keyed.groupBy("text_key", "text_check").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    groups, size = cut_measured(groups.filter("rows > 1 AND least IS NOT NULL").drop("rows"), "copies")
    met = lookup_join(keyed, groups, ["text_key", "text_check"], size)
    return met.filter(F.col("doc_id").isNull() | (F.col("least") < F.col("doc_id"))).select("doc_id", "text_key").distinct()


def _same_row(left: DataFrame, right: DataFrame, size: Size) -> tuple[DataFrame, Column]:
    """The right side, broadcast within a measured bound, and the condition of a join on id and text."""
    named = right.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    if size.rows <= BROADCAST_ROWS and size.bytes <= BROADCAST_BYTES:
        named = F.broadcast(named)
    return named, left["doc_id"].eqNullSafe(named["_id"]) & (left["text_key"] == named["_key"])


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each text without its repeated windows, words joined by a space.

    Windows are judged on the input. Texts shorter than a window, empty and null ones lose nothing.
    Repeated rows with the same id are no earlier documents to each other. The table may be empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("text")).withColumn("text_key", F.xxhash64("text"))
    keyed = cut(rows.select("doc_id", "text_key", F.xxhash64(F.lit(1), "text").alias("text_check")), "texts")
    copies, n_copies = cut_measured(_later_copies(keyed), "later")
    named, same = _same_row(rows, copies, n_copies)
    spans = repeated_spans(rows.join(named, same, "left_anti"), window)
    # A later copy goes whole, which no spans stand for.
    whole = copies.select("doc_id", "text_key", F.lit(b"").alias("spans"))
    spans, size = cut_measured(spans.unionByName(whole), "spans")
    named, same = _same_row(rows, spans, size)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, bounds = flat(part.column("text"))
                found = spaced(words(data, bounds))
                held, kept, removed = found.data.tobytes(), [], []
                for i, packed in enumerate(part.column("spans").to_pylist()):
                    first, last = found.first[i], found.first[i + 1]
                    if first == last:
                        kept.append(b"")
                        removed.append(0)
                        continue
                    if packed == b"" and last - first >= window:
                        kept.append(b"")
                        removed.append(int(last - first))
                        continue
                    at, pieces, gone = first, [], 0
                    for a, b in np.frombuffer(packed or b"", "<i4").reshape(-1, 2).tolist():
                        if first + a > at:
                            pieces.append(held[found.starts[at] : found.ends[first + a - 1]])
                        at, gone = first + b, gone + b - a
                    if at < last:
                        pieces.append(held[found.starts[at] : found.ends[last - 1]])
                    kept.append(b" ".join(pieces))
                    removed.append(gone)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(found.counts.astype(np.int64)),
                        pa.array(removed, pa.int64()),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    joined = rows.join(named, same, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(keep, f"doc_id {kind}, n_words long, n_removed long, kept string")
