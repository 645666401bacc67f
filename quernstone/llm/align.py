"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Each token list is a dictionary from the byte offset at which a token ends to its index. The offsets in
both dictionaries, by hash-set intersection and in order, slice the two lists into groups; within a
slice every pair of tokens whose bytes overlap is a link. Links of an id pair are counted over the
whole corpus.

Both tokenizers begin a token at a space between two signs that are not white space, so texts are
cut there, and a chunk is encoded and aligned once and remembered: all groups and links lie within chunks.
A text is read twice, for the counts and with them, and no link is written or shuffled before it is counted.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.bytescan import slices
from quernstone.support.cut import cut, cut_measured

# Id pairs with their counts that a task holds at once; a larger table is met slice by slice.
HELD_PAIRS = 2_000_000

# Chunks that a worker remembers, and the longest of them in characters.
REMEMBERED = 1 << 18
LONGEST = 48
# Counted pairs that a worker gathers before it hands them on.
GATHERED = 1 << 19

# Bytes of texts that are encoded end to end.
JOINED = 1 << 15

# Bits of each of the sums over a text that are held in one number.
BITS = 48

# U+180E is white space in some versions of Unicode.
_inner_space = re.compile(r"(?<=[^\s᠎]) (?=[^\s᠎])")
_loose = re.compile(r"^[\s᠎]|^$|[\s᠎]$").search


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Visible Latin-1 signs stand for themselves, the other bytes for the code points from 256 on.
    """
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Tokens:
    """What the two tokenizers share: the bytes of each id."""

    bytes: dict[int, bytes]

    def joined(self, lists: list[list[int]]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, chain.from_iterable(lists)))


class ByteTokens(_Tokens):
    """A byte-level tokenizer of the tokenizers library; names of special tokens are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte_of = byte_letters()
        self.merges = self.tokenizer.model.tokenize
        # Whether a space and letters are one piece, and nothing is done to them before.
        pieces = self.tokenizer.pre_tokenizer
        self.plain = self.tokenizer.normalizer is None and pieces is not None and len(pieces.pre_tokenize_str(" Word")) == 1
        self.space = next(letter for letter, byte in byte_of.items() if byte == ord(" "))
        self.bytes = {
            i: bytes(map(byte_of.__getitem__, token)) if byte_of.keys() >= set(token) else token.encode()
            for token, i in self.tokenizer.get_vocab().items()
        }

        self.lengths = _lengths(self.bytes)

    def encode(self, texts: list[str], whole: list[bytes], most: int) -> list[list[int]]:
        """Ids of a space and each text; ``whole`` is both as bytes.

        Several, up to ``most`` bytes, are encoded end to end, which is faster: each must begin a token.
        """
        out: list[list[int]] = [[]] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if self.plain and text.isascii() and text.isalpha():
                out[i] = [token.id for token in self.merges(self.space + text)]
            else:
                rest.append(i)
        begun = 0
        while begun < len(rest):
            end, size = begun, 0
            while end < len(rest) and (size < most or end == begun):
                size += len(whole[rest[end]])
                end += 1
            some = rest[begun:end]
            joined = " " + " ".join([texts[i] for i in some])
            ids = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids
            ends = np.cumsum(self.lengths[ids])
            cuts = np.searchsorted(ends, np.cumsum([len(whole[i]) for i in some]), "right").tolist()
            for i, a, b in zip(some, [0, *cuts[:-1]], cuts, strict=True):
                out[i] = ids[a:b]
            begun = end
        return out


def _lengths(tokens: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(max(tokens) + 1, np.int64)
    for i, token in tokens.items():
        out[i] = len(token)
    return out


class PieceTokens(_Tokens):
    """A sentencepiece tokenizer, which puts a space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size, piece = self.model.get_piece_size(), self.model.id_to_piece
        self.bytes = {
            i: bytes([int(piece(i)[3:-1], 16)]) if self.model.is_byte(i) else piece(i).replace("▁", " ").encode()
            for i in range(size)
        }
        self.lengths = _lengths(self.bytes)
        # A space after another sign begins a piece if no piece holds one there.
        self.cut = not any(re.search("[^▁]▁", piece(i)) for i in range(size))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def shared_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets at which tokens of both lists end, and the indices of these tokens in the one and the other."""
    index_a = dict(zip(ends_a.tolist(), range(len(ends_a)), strict=True))
    index_b = dict(zip(ends_b.tolist(), range(len(ends_b)), strict=True))
    shared = sorted(index_a.keys() & index_b.keys())
    last_a, last_b = (np.array([index[end] for end in shared], np.int64) for index in (index_a, index_b))
    return np.array(shared, np.int64), last_a, last_b


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of tokens whose bytes overlap, as indices, with the offset at which the common bytes end.

    The ends inside a slice cut it into stretches that one token of each list covers: each is a link.
    """
    ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    ends = ends[np.diff(ends, prepend=-1) > 0]
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends), ends


class Aligner:
    """Texts to what their chunks give, remembered by chunk."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokens(path_a), PieceTokens(path_b)
        size = max(max(self.a.bytes), max(self.b.bytes)) + 1
        # Ids as text, with the sign that follows: more of the group, its other side, its end.
        self.names = {sign: np.array([f"{i}{sign}" for i in range(size)], object) for sign in ",|;"}
        self.held: dict[str, tuple[int, str, bytes] | None] = {}

    def chunks(self, text: str) -> list[str]:
        if not self.b.cut:
            return [text]
        parts = text.split(" ")
        return _inner_space.split(text) if any(map(_loose, parts)) else parts

    def learn(self, chunks: set[str]) -> None:
        """Put into ``held``: (counts of both sides' tokens, groups and links in one number, groups as text, links as
        64-bit codes); None where the bytes of the two sides differ from the chunk's.
        """
        if len(self.held) > REMEMBERED:
            self.held.clear()
        new = sorted(chunks.difference(self.held))
        if not new:
            return
        whole = [b" " + chunk.encode() for chunk in new]
        lists_a, lists_b = self.a.encode(new, whole, JOINED if self.b.cut else 0), self.b.encode(new)
        joined = b"".join(whole)
        if not all(held.joined(lists) == joined for held, lists in ((self.a, lists_a), (self.b, lists_b))):
            good = [
                i for i, w in enumerate(whole) if self.a.joined(lists_a[i : i + 1]) == w == self.b.joined(lists_b[i : i + 1])
            ]
            self.held.update(dict.fromkeys(new))
            new, lists_a, lists_b = ([x[i] for i in good] for x in (new, lists_a, lists_b))
        if new:
            self._align(new, lists_a, lists_b)

    def _align(self, chunks: list[str], lists_a: list[list[int]], lists_b: list[list[int]]) -> None:
        """All chunks as one run of bytes, at whose cuts tokens of both sides end."""
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (lists_a, lists_b))
        ends_a, ends_b = np.cumsum(self.a.lengths[ids_a]), np.cumsum(self.b.lengths[ids_b])
        shared, last_a, last_b = shared_ends(ends_a, ends_b)
        link_a, link_b, link_ends = links(ends_a, ends_b)
        codes = ids_a[link_a] << 32 | ids_b[link_b]

        text_a, text_b = self.names[","][ids_a], self.names[","][ids_b]
        text_a[last_a] = self.names["|"][ids_a[last_a]]
        text_b[last_b] = self.names[";"][ids_b[last_b]]
        # Group by group, a before b.
        order = np.concatenate([2 * np.searchsorted(shared, ends_a), 2 * np.searchsorted(shared, ends_b) + 1])
        text = np.concatenate([text_a, text_b])[np.argsort(order, kind="stable")].tolist()

        n_a, n_b = np.array([len(x) for x in lists_a]), np.array([len(x) for x in lists_b])
        till_a, till_b = np.cumsum(n_a), np.cumsum(n_b)
        till = ends_a[till_a - 1]
        till_group, till_link = np.searchsorted(shared, till, "right"), np.searchsorted(link_ends, till, "right")
        n_groups, n_links = np.diff(till_group, prepend=0), np.diff(till_link, prepend=0)
        at = link = 0
        for chunk, a, b, groups, several in zip(
            chunks, n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), strict=True
        ):
            counts = a | b << BITS | groups << 2 * BITS | several << 3 * BITS
            self.held[chunk] = (counts, "".join(text[at : at + a + b]), codes[link : link + several].tobytes())
            at, link = at + a + b, link + several

    def forget_long(self, chunks: set[str]) -> None:
        """Few and short ones are remembered, so the memory is bounded."""
        for chunk in chunks:
            if len(chunk) > LONGEST:
                self.held.pop(chunk, None)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One per worker and pair of files."""
    key = (path_a, path_b)
    if key not in _aligners:
        _aligners[key] = Aligner(path_a, path_b)
    return _aligners[key]


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, ascending, with the sum of its counts."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.diff(codes, prepend=codes[:1] - 1)) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def linked(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, codes, times): every text aligned once, with its
    distinct links as a * 2**32 + b and how often it has them. ``row`` numbers the rows of the table.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, " + "".join(f"{c} long, " for c in _COUNTS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, low = aligner(path_a, path_b), (1 << BITS) - 1
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [work.chunks(text) if text else [] for text in part.column("text").to_pylist()]
                every = set().union(*texts)
                work.learn(every)
                counts, digests, codes, times = [], [], [], []
                for chunks in texts:
                    found = [work.held[c] for c in chunks]
                    if None in found:
                        found = []
                    sums, groups = sum([x[0] for x in found]), "".join([x[1] for x in found])[:-1]
                    counts.append([sums >> k * BITS & low for k in range(4)])
                    digests.append(hashlib.sha256(groups.encode()).hexdigest() if found else "")
                    flat = np.frombuffer(b"".join([x[2] for x in found]), np.int64)
                    of_text = np.unique(flat, return_counts=True)
                    codes.append(of_text[0])
                    times.append(of_text[1])
                work.forget_long(every)
                ends = pa.array(np.cumsum([0, *map(len, codes)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (codes, times)]
                columns = [pa.array(x, pa.int64()) for x in zip(*counts, strict=True)]
                numbers = pa.array(np.arange(row, row + len(texts)))
                row += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [numbers, part.column("doc_id"), *columns, pa.array(digests, pa.string()), *lists],
                    ["row", "doc_id", *_COUNTS, "groups_sha256", "codes", "times"],
                )

    return rows.mapInArrow(scan, schema + "groups_sha256 string, codes array<long>, times array<long>")


def pair_counts(texts: DataFrame) -> DataFrame:
    """(code, n, best): links of each id pair over all texts of a table of ``linked``, and whether no pair of its
    second id has more.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, gathered = [], 0

        def batch_of(found: list) -> pa.RecordBatch:
            codes, counts = _summed(*(np.concatenate(x) for x in zip(*found, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["code", "n"])

        for batch in batches:
            held.append(_summed(*(batch.column(c).flatten().to_numpy() for c in ("codes", "times"))))
            gathered += len(held[-1][0])
            if gathered > GATHERED:
                yield batch_of(held)
                held, gathered = [], 0
        if held:
            yield batch_of(held)

    counted = texts.select("codes", "times").mapInArrow(scan, "code long, n long")
    counted, _ = cut_measured(counted.groupBy("code").agg(F.sum("n").alias("n")), "pairs")
    of_b = F.col("code").bitwiseAND(F.lit((1 << 32) - 1))
    # At most one row per id of the second vocabulary.
    most = counted.groupBy(of_b.alias("_b")).agg(F.max("n").alias("_most"))
    joined = counted.join(most, of_b == F.col("_b"))
    return joined.select("code", "n", (F.col("n") == F.col("_most")).alias("best"))


def _held_slices(pairs: DataFrame, rows: int, most: int) -> list[Broadcast]:
    """The pairs as sorted codes with counts, in slices by hash of ``most`` rows or so."""
    number = max(1, -(-rows // most))
    context, out = pairs.sparkSession.sparkContext, []
    for i in range(number):
        some = pairs.filter(F.pmod(F.xxhash64("code"), F.lit(number)) == i) if number > 1 else pairs
        found = some.toArrow()
        codes = found.column("code").to_numpy()
        order = np.argsort(codes)
        best = found.column("best").to_numpy(zero_copy_only=False)
        out.append(context.broadcast((codes[order], found.column("n").to_numpy()[order], best[order].astype(bool))))
    return out


def alignments(docs: DataFrame, path_a: str, path_b: str, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    ``path_a`` names a byte-level tokenizer file, which encodes a space and the text, ``path_b`` a
    sentencepiece model, which adds the space itself; both on every machine. ``n_best`` counts the links
    whose pair has the most links of its second id over the corpus, ties included, ``count_sum`` adds up the
    counts of the pairs of all links. A text that is null, empty or not reproduced by both has zeros and ''.
    Whole texts are aligned, however long. Repeated rows are documents of their own, and give repeated
    rows; null ids stay. Other columns, whatever their names, are not looked at. An empty table gives none.
    """
    texts = cut(linked(docs, path_a, path_b), "linked")
    pairs, size = cut_measured(pair_counts(texts), "pairs-best")
    tables = _held_slices(pairs, size.rows, held_pairs)

    def met(table: Broadcast):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, counts, best = table.value
            for batch in batches:
                lists = batch.column("codes")
                flat, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
                sums = np.zeros((2, len(flat) + 1), np.int64)
                if len(codes):
                    at = np.minimum(np.searchsorted(codes, flat), len(codes) - 1)
                    times = np.where(codes[at] == flat, times, 0)
                    np.cumsum(times * best[at], out=sums[0, 1:])
                    np.cumsum(times * counts[at], out=sums[1, 1:])
                ends = np.cumsum(pc.list_value_length(lists).to_numpy())
                per_row = np.diff(sums[:, ends], axis=1, prepend=0)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-2], pa.array(per_row[0]), pa.array(per_row[1])],
                    [*batch.schema.names[:-2], "n_best", "count_sum"],
                )

        return scan

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields[:-2])
    shares = [texts.mapInArrow(met(table), schema + ", n_best long, count_sum long") for table in tables]
    out = ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"]
    if len(shares) == 1:
        return shares[0].select(out)
    # Each slice of the pairs adds its share to a row.
    alike = [F.first(c).alias(c) for c in ("doc_id", *_COUNTS, "groups_sha256")]
    summed = [F.sum(c).alias(c) for c in ("n_best", "count_sum")]
    return reduce(DataFrame.unionByName, shares).groupBy("row").agg(*alike, *summed).select(out)
