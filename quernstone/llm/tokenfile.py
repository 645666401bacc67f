"""Token ids on disk as wavelet matrices, one per shard of consecutive documents.

A shard is one binary value: a header, the directory of its documents, and a wavelet matrix: a bit
plane per bit of the largest id, the top bit first, every plane stably sorted by the bits above, with
the ones counted up to each block. Any id, the count of an id before a place and the place of its
k-th occurrence come from these planes alone; nothing else holds the ids. Shards are written as rows
of a Parquet table, so they go through Spark's committed writers into any store it can reach.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.bytescan import slices
from quernstone.support.cut import scratch_path
from quernstone.support.ranking import running_sum_before

# Fixed values of the file format.
MAGIC = b"WMX1"
HEADER = struct.Struct("<4sBQQ")
BLOCK_BITS = 512

# Ids after which a shard is closed at the next end of a document.
SHARD_IDS = 1 << 20


class WaveletMatrix:
    """A sequence of non-negative integers as bit planes with rank and select."""

    def __init__(self, planes: list[np.ndarray], ranks: list[np.ndarray], zeros: np.ndarray, length: int):
        self.planes, self.ranks, self.zeros, self.length = planes, ranks, zeros, length
        self._sums: dict[int, np.ndarray] = {}

    @classmethod
    def build(cls, values: np.ndarray) -> WaveletMatrix:
        values = np.asarray(values)
        bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        small = np.uint16 if bits <= 16 else np.uint32
        order, planes, ranks, zeros = values.astype(small), [], [], []
        for bit in range(bits - 1, -1, -1):
            ones = (order >> small(bit) & small(1)).astype(bool)
            plane = np.packbits(ones, bitorder="little")
            whole = np.zeros(-(-len(order) // BLOCK_BITS) * BLOCK_BITS // 8, np.uint8)
            whole[: len(plane)] = plane
            per_block = np.bitwise_count(whole.view(np.uint64)).reshape(-1, BLOCK_BITS // 64).sum(axis=1)
            planes.append(whole)
            ranks.append(np.concatenate([[0], np.cumsum(per_block)]).astype(np.uint32))
            zeros.append(len(order) - int(per_block.sum()))
            order = np.concatenate([order.compress(~ones), order.compress(ones)])
        return cls(planes, ranks, np.array(zeros, np.int64), len(values))

    def _rank(self, level: int, at: int) -> int:
        """Ones of a plane before a place."""
        block, rest = divmod(at, BLOCK_BITS)
        ones = int(self.ranks[level][block])
        if rest:
            begin = block * BLOCK_BITS // 8
            part = self.planes[level][begin : begin + -(-rest // 8)].tobytes()
            ones += (int.from_bytes(part, "little") & ((1 << rest) - 1)).bit_count()
        return ones

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th one or zero (from 0) of a plane, by halving."""
        low, high = 0, self.length
        while low < high:
            middle = (low + high) // 2
            ones = self._rank(level, middle + 1)
            if (ones if bit else middle + 1 - ones) > k:
                high = middle
            else:
                low = middle + 1
        return low

    def access(self, at: int) -> int:
        value = 0
        for level in range(len(self.planes)):
            bit = int(self.planes[level][at >> 3]) >> (at & 7) & 1
            ones = self._rank(level, at)
            at = int(self.zeros[level]) + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        """Places in the last order that hold ``value`` from the first ``end`` places."""
        begin, bits = 0, len(self.planes)
        if value >> bits:
            return 0, 0
        for level in range(bits):
            b, e = self._rank(level, begin), self._rank(level, end)
            if value >> (bits - 1 - level) & 1:
                begin, end = int(self.zeros[level]) + b, int(self.zeros[level]) + e
            else:
                begin, end = begin - b, end - e
        return begin, end

    def count(self, value: int, end: int | None = None) -> int:
        """Occurrences of a value before a place."""
        begin, end = self._range(value, self.length if end is None else end)
        return end - begin

    def locate(self, value: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of a value."""
        begin, end = self._range(value, self.length)
        if not 0 <= k < end - begin:
            raise IndexError(f"{value} occurs {end - begin} times")
        at, bits = begin + k, len(self.planes)
        for level in range(bits - 1, -1, -1):
            bit = value >> (bits - 1 - level) & 1
            at = self._select(level, bit, at - int(self.zeros[level]) if bit else at)
        return at

    def values(self) -> np.ndarray:
        """The whole sequence, from the last plane up."""
        bits = len(self.planes)
        small = np.uint16 if bits <= 16 else np.uint32
        order = np.zeros(self.length, small)
        for level in range(bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.length, bitorder="little").view(bool)
            before, zeros = np.empty_like(order), int(self.zeros[level])
            # Places are faster to write to than a mask of random bits.
            before[np.flatnonzero(~ones)] = order[:zeros]
            before[np.flatnonzero(ones)] = order[zeros:] | small(1 << (bits - 1 - level))
            order = before
        return order

    def to_bytes(self) -> bytes:
        head = struct.pack("<BQ", len(self.planes), self.length) + self.zeros.astype("<i8").tobytes()
        return head + b"".join(
            r.astype("<u4").tobytes() + p.tobytes() for r, p in zip(self.ranks, self.planes, strict=True)
        )

    @classmethod
    def from_bytes(cls, data: bytes | memoryview) -> WaveletMatrix:
        bits, length = struct.unpack_from("<BQ", data)
        at = struct.calcsize("<BQ")
        zeros = np.frombuffer(data, "<i8", bits, at)
        at += 8 * bits
        blocks = -(-length // BLOCK_BITS)
        planes, ranks = [], []
        for _ in range(bits):
            ranks.append(np.frombuffer(data, "<u4", blocks + 1, at))
            at += 4 * (blocks + 1)
            planes.append(np.frombuffer(data, np.uint8, blocks * BLOCK_BITS // 8, at))
            at += blocks * BLOCK_BITS // 8
        return cls(planes, ranks, zeros, length)


def write_shard(ids: list[np.ndarray]) -> bytes:
    """The bytes of a shard whose documents have these ids."""
    lengths = np.array([len(i) for i in ids], "<u4")
    joined = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
    matrix = WaveletMatrix.build(joined).to_bytes()
    return HEADER.pack(MAGIC, 1, len(ids), len(joined)) + lengths.tobytes() + matrix


def read_shard(data: bytes | memoryview) -> tuple[np.ndarray, WaveletMatrix]:
    """Lengths of the documents of a shard, and their ids end to end."""
    magic, version, documents, length = HEADER.unpack_from(data)
    if (magic, version) != (MAGIC, 1):
        raise ValueError("not a token shard")
    lengths = np.frombuffer(data, "<u4", documents, HEADER.size).astype(np.int64)
    matrix = WaveletMatrix.from_bytes(memoryview(data)[HEADER.size + 4 * documents :])
    if matrix.length != length:
        raise ValueError("a token shard is cut short")
    return lengths, matrix


def write_tokens(docs: DataFrame, encode: Callable[[], Callable[[list[bytes]], list[np.ndarray]]], path: str) -> None:
    """Write the ids of all documents in ascending doc_id order (null first, then by a hash of the text)
    as shards: rows (place, doc_ids, n_ids, shard) of a Parquet table at ``path``.

    ``encode`` is called once in a worker and returns what turns UTF-8 texts into ids. ``place`` orders the
    shards. Documents are ranged over the tasks by a sampled distribution of ids; a null text is
    empty. Repeated rows are documents of their own, next to each other; an empty table gives no shard.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, part = encode(), TaskContext.get().partitionId()
        names, held, size, number, id_type = [], [], 0, 0, None

        def shard() -> pa.RecordBatch:
            doc_ids = pa.array([pa.concat_arrays(names).to_pylist()], pa.list_(id_type))
            columns = [pa.array([part << 32 | number], pa.int64()), doc_ids, pa.array([size], pa.int64())]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array([write_shard(held)], pa.binary())], ["place", "doc_ids", "n_ids", "shard"]
            )

        for batch in batches:
            for piece in slices(batch, "text"):
                ids, begun = work(piece.column("text").cast(pa.binary()).to_pylist()), 0
                id_type = piece.column("doc_id").type
                for i, of_text in enumerate(ids):
                    held.append(of_text)
                    size += len(of_text)
                    if size >= SHARD_IDS:
                        names.append(piece.column("doc_id").slice(begun, i + 1 - begun))
                        yield shard()
                        names, held, size, number, begun = [], [], 0, number + 1, i + 1
                if begun < len(ids):
                    names.append(piece.column("doc_id").slice(begun))
        if held:
            yield shard()

    shards = ordered.select("doc_id", "text").mapInArrow(
        scan, f"place long, doc_ids array<{kind}>, n_ids long, shard binary"
    )
    shards.write.option("compression", "zstd").parquet(path)


def read_tokens(docs_schema_id: str, shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the shards alone.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is taken over its ids as
    little-endian unsigned 32-bit integers.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, matrix = read_shard(batch.column("shard")[i].as_buffer())
                ids = matrix.values().astype("<u4")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n : e]) for n, e in zip(lengths.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(lengths), batch.column("place")[i].as_py())),
                        batch.column("doc_ids").slice(i, 1).flatten(),
                        pa.array(ends - lengths),
                        pa.array(lengths),
                        pa.array(crc, pa.int64()),
                    ],
                    ["place", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    read = shards.select("place", "doc_ids", "shard").mapInArrow(
        scan, f"place long, doc_id {docs_schema_id}, inside long, n_tokens long, ids_crc32 long"
    )
    offsets = running_sum_before(shards.select("place", "n_ids"), "place", "n_ids", "before", "following")
    offsets = offsets.select(F.col("place").alias("_place"), "before")
    return read.join(offsets, F.col("place") == F.col("_place")).select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


# Visible ASCII signs and all bytes of U+00C0 to U+017F and U+0400 to U+04FF in UTF-8. The letters there make pairs of
# cases one by one, and no sign joins them.
PLAIN = bytes([*range(0x21, 0x7F), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5, *range(0xD0, 0xD4)])
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u017f\u0400-\u0481\u048a-\u04ff"


def _byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if visible, one from U+0100 on if not."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordTokens(dict):
    """Ids of texts by a tokenizer file that lower-cases and drops white space, with an end id.

    No match of its pattern crosses white space, so each word without it is encoded once and remembered: as a
    key of this dictionary, with its ids as bytes. Words of plain bytes are cut into matches here, which the tokenizer's
    model merges and which are remembered like words; all others go through the whole tokenizer.
    """

    # Words that a worker remembers from slice to slice, and bytes of each.
    REMEMBERED = 1_000_000
    LONGEST = 64
    MATCHES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[!-/:-@\[-`{{-~]+").findall

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.signs = _byte_signs()
        self.end = array("I", [end_id]).tobytes()
        self.marks = {mark: self._library(chr(mark)) for mark in b".,"}

    def _library(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _match(self, signs: str) -> bytes:
        """Ids of a match of the pattern, in lower case."""
        if not signs.isascii():
            signs = signs.encode().decode("latin-1").translate(self.signs)
        return array("I", [t.id for t in self.merges(signs)]).tobytes()

    def _plain(self, word: bytes) -> bytes:
        """Ids of a word of plain bytes."""
        signs = word.decode().lower()
        if signs.isalpha():
            return self._match(signs)
        matches = self.MATCHES(signs)
        if sum(map(len, matches)) < len(signs):
            return self._library(word.decode())
        if len(matches) == 1:
            return self._match(signs)
        return b"".join([self[match.encode()] for match in matches])

    def __missing__(self, word: bytes) -> bytes:
        if word[-1] in self.marks and word[-2:-1].isalpha():
            # A stop or comma after a letter is a match of its own.
            ids = self[word[:-1]] + self.marks[word[-1]]
        elif word.translate(None, PLAIN) or b"<|" in word:
            # Other signs, and what can be the name of a special token.
            ids = self._library(word.decode())
        else:
            ids = self._plain(word)
        if len(word) <= self.LONGEST:
            self[word] = ids
        return ids

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self) > self.REMEMBERED:
            self.clear()
        out = []
        for text in texts:
            # Names of special tokens are told apart by case.
            words = (text if b"<|" in text else text.lower()).split()
            out.append(np.frombuffer(b"".join([*map(self.__getitem__, words), self.end]), np.uint32))
        return out


_word_tokens: dict[tuple[str, int], WordTokens] = {}


def word_tokens(path: str, end_id: int) -> WordTokens:
    """One tokenizer per worker and file."""
    key = (path, end_id)
    if key not in _word_tokens:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _word_tokens[key] = WordTokens(path, end_id)
    return _word_tokens[key]


def token_file(docs: DataFrame, path: str, end_id: int) -> tuple[DataFrame, str]:
    """Write all documents through the tokenizer at ``path`` and return the shards read back, and where."""
    at = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, lambda: word_tokens(path, end_id), at)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.sparkSession.read.schema(f"place long, doc_ids array<{kind}>, n_ids long, shard binary").parquet(at), at
