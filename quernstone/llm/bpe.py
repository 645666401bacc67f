"""Byte-level BPE with a segment tree over byte positions.

A leaf stands for a position where a token begins and holds the rank of its merge with the next live
token; an inner node holds the least (rank, position) below it, so the root is the leftmost pair of
least rank. A merge writes three leaves (the merged token, its left neighbour, the dead one) and
their paths to the root. Short pieces are merged many at a time, each with a tree in one row of a
matrix; long ones one by one. Equal pieces of a task are encoded once, within a bounded memory.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.bytescan import slices

NONE = np.iinfo(np.int32).max
# Pieces up to this many bytes go into matrices of trees.
SHORT = 64
# Low bits of a leaf of such a tree that hold the position.
SHIFT = 7
# Pieces and chunks, each of SHORT bytes or signs at most, that a worker remembers from slice to slice.
REMEMBERED = 300_000
PIECES_AT_ONCE = 1 << 12


class Ranks:
    """The ranks of a vocabulary file: base64 of the bytes and the rank, one token per line."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ids = {base64.b64decode(token): int(rank) for token, rank in pairs}
        size = max(self.ids.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ids.items():
            self.tokens[rank] = token
        self.byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        joined: dict[int, int] = {}
        for token, rank in self.ids.items():
            for at in range(1, len(token)):
                left, right = self.ids.get(token[:at]), self.ids.get(token[at:])
                if left is not None and right is not None:
                    joined[left << 32 | right] = rank
        self.joined = joined
        self.pairs = np.array(sorted(joined), np.int64)
        self.merged = np.array([joined[p] for p in self.pairs.tolist()] + [0], np.int32)
        if size << SHIFT > NONE:
            raise ValueError(f"{path} has more than {NONE >> SHIFT} ranks")
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.lengths, self.begins = lengths, np.cumsum(lengths) - lengths
        self.all_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair joined, NONE where the vocabulary has no such token."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pairs, key)
        found = self.pairs[np.minimum(at, len(self.pairs) - 1)] == key
        return np.where(found, self.merged[at], np.int32(NONE))

    def encode_long(self, piece: bytes) -> list[int]:
        """One tree over the positions of a piece."""
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        shift, none = size.bit_length(), 1 << 62
        token = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.joined.get

        def leaf(at: int) -> int:
            after = following[at]
            rank = get(token[at] << 32 | token[after]) if after < n else None
            return none if rank is None else rank << shift | at

        tree = [none] * (2 * size)
        tree[size : size + n] = [leaf(i) for i in range(n)]
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(at: int, value: int) -> None:
            node = size + at
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        while (top := tree[1]) != none:
            at = top & ((1 << shift) - 1)
            token[at] = top >> shift
            dead = following[at]
            after = following[at] = following[dead]
            if after < n:
                before[after] = at
            token[dead] = -1
            put(dead, none)
            put(at, leaf(at))
            if before[at] >= 0:
                put(before[at], leaf(before[at]))
        return [t for t in token if t >= 0]

    def encode_short(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of at most SHORT bytes, as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.array([len(p) for p in pieces])
        size = 2
        while size <= SHORT:
            rows = np.flatnonzero((lengths <= size) & (lengths > (size // 2 if size > 2 else 0)))
            for at in range(0, len(rows), PIECES_AT_ONCE):
                some = rows[at : at + PIECES_AT_ONCE]
                for row, ids in zip(some.tolist(), self._encode_rows([pieces[i] for i in some], size), strict=True):
                    out[row] = ids
            size *= 2
        return out

    def _encode_rows(self, pieces: list[bytes], size: int) -> list[bytes]:
        m, shift = len(pieces), SHIFT
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(m, size)
        live = np.arange(size)[None, :] < lengths[:, None]
        token = np.where(live, self.byte[raw], np.int32(-1))
        following = np.tile(np.arange(1, size + 1, dtype=np.int32), (m, 1))
        before = np.tile(np.arange(-1, size - 1, dtype=np.int32), (m, 1))
        tree = np.full((m, 2 * size), NONE, np.int32)
        paired = live[:, 1:]
        rank = self.rank(token[:, :-1][paired], token[:, 1:][paired])
        where = np.nonzero(paired)
        tree[where[0], size + where[1]] = np.where(rank == NONE, rank, rank << shift | where[1])
        for node in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray | int) -> None:
            node = size + at
            tree[rows, node] = value
            while size > 1 and node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        def renew(rows: np.ndarray, at: np.ndarray) -> None:
            after = following[rows, at]
            inside = after < lengths[rows]
            rank = np.full(len(rows), NONE, np.int32)
            r, a = rows[inside], at[inside]
            rank[inside] = self.rank(token[r, a], token[r, after[inside]])
            put(rows, at, np.where(rank == NONE, rank, rank << shift | at))

        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            top = tree[rows, 1]
            at = top & ((1 << shift) - 1)
            token[rows, at] = top >> shift
            dead = following[rows, at]
            after = following[rows, dead]
            following[rows, at] = after
            inside = after < lengths[rows]
            before[rows[inside], after[inside]] = at[inside]
            token[rows, dead] = -1
            put(rows, dead, NONE)
            renew(rows, at)
            left = before[rows, at]
            has = left >= 0
            if has.any():
                renew(rows[has], left[has])
            rows = rows[tree[rows, 1] != NONE]
        kept = token >= 0
        flat = token[kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(axis=1)).tolist()
        return [flat[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        source = np.repeat(self.begins[ids] - (ends - lengths), lengths)
        source += np.arange(len(source))
        return self.all_bytes[source].tobytes()


class Encoder:
    """Texts to ids: each match of the pattern by itself, without special tokens.

    The pattern takes at most one space before a word, so a space between two signs that are not white
    space always begins a match. Texts are cut there, and equal chunks are looked up; a text with
    another space is matched as a whole.
    """

    def __init__(self, path: str, pattern: str):
        self.ranks = Ranks(path)
        self.split = regex.compile(pattern).findall
        self.loose = regex.compile(r"^\s|^$|\s$").search
        self.pieces: dict[str, bytes] = {}
        self.long: list[str] = []
        # None for a chunk that can't be cut off.
        self.chunks: dict[str, bytes | None] = {}

    def _learn(self, pieces: set[str]) -> None:
        short = []
        for piece in pieces.difference(self.pieces):
            data = piece.encode()
            whole = self.ranks.ids.get(data)
            if whole is not None:
                self.pieces[piece] = whole.to_bytes(4, "little")
            elif len(data) <= SHORT:
                short.append((piece, data))
            else:
                self.pieces[piece] = np.array(self.ranks.encode_long(data), "<u4").tobytes()
                self.long.append(piece)
        ids = self.ranks.encode_short([data for _, data in short])
        self.pieces.update(zip((piece for piece, _ in short), ids, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [text.split(" ") for text in texts]
        chunks = set().union(*cut)
        new = {c: None if self.loose(c) else self.split(" " + c) for c in chunks.difference(self.chunks)}
        first = [self.split(parts[0]) for parts in cut]
        self._learn(set().union(*filter(None, new.values()), *first))
        find = self.pieces.__getitem__
        for chunk, pieces in new.items():
            self.chunks[chunk] = None if pieces is None else b"".join(map(find, pieces))
        out = []
        for text, parts, start in zip(texts, cut, first, strict=True):
            ids = [self.chunks[c] for c in parts]
            if None in ids:
                pieces = self.split(text)
                self._learn(set(pieces))
                ids = list(map(find, pieces))
            else:
                ids[0] = b"".join(map(find, start))
            out.append(b"".join(ids))
        # Few and short ones are remembered, so the memory is bounded.
        for chunk in new:
            if len(chunk) > SHORT:
                del self.chunks[chunk]
        for piece in self.long:
            del self.pieces[piece]
        self.long.clear()
        for held in (self.pieces, self.chunks):
            if len(held) > REMEMBERED:
                held.clear()
        return out


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    key = (path, pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(path, pattern)
    return _encoders[key]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): ids of each whole text as little-endian unsigned 32-bit integers, and the
    bytes that these ids decode to.

    ``path`` names the vocabulary on every machine. A null or empty text has no ids. Repeated rows give
    repeated rows, an empty table none. Texts are encoded whole, however long; other columns, whatever their names,
    are not looked at.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = work.encode(part.column("text").to_pylist())
                decoded = [work.ranks.decode(np.frombuffer(i, "<u4")) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())],
                    ["doc_id", "ids", "decoded"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, ids binary, decoded binary")


def digests(encoded: DataFrame, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of a table of ``encode``, and the ids if asked for."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *(["ids"] if keep_ids else []),
    )
