"""Collocations: phrases mined by Toivonen's sampling, scored by how well their parts predict each other.

A sample of the documents, at a lowered threshold, proposes frequent phrases. A full pass counts those and their
negative border exactly: every phrase whose two longest parts were proposed. A counted phrase that is
frequent although it was not proposed is a failure of the border; what it makes possible is
counted in a further pass, until a pass brings no failure. Frequent phrases of n words consist of frequent ones of
n - 1 words, so the result is exact, whatever the sample held.

A phrase is counted by 88 bits of hash over its language and words, and by them the passes
tell candidates from others in a Bloom filter of bounded size. A larger set of phrases is met in slices by
hash, each in a pass of its own. Counts travel as arrays, by ranges of the hash whose number grows with the texts.
The words themselves are read from the corpus only for frequent phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.bloom import Filter, Loaded, slice_of
from quernstone.llm.bytescan import BYTE_BASE, LOWER, WORD_BASE, flat, mixed, range_hashes, slices, word_hashes, words
from quernstone.support.cut import cut, cut_measured
from quernstone.support.lookup import lookup_join

MOST_WORDS = 3
LEAST_COUNT = 10
COVERED_PERCENT = 50
SCALE = 1_000_000
TOP = 2000

# Share of the documents in the sample, and of the count that a frequent phrase has there on average
# that proposes one.
SAMPLE_SHARE = 0.25
LOWERED = 0.8

SLICE_BYTES = 1 << 20

# Occurrences that a task sums up at a time, and bytes of text for each range of hashes that is summed up
# as one group, per word of the longest phrases.
HELD = 1 << 20
RANGE_BYTES = 4 << 20
# Fields of a counted phrase.
FIELDS = {"hash": "<u8", "check": "<u4", "n": "<i8", "bucket": "u1"}

# Longest phrases hashed word by word.
SHORT = 4

# Signs that end a piece of a text, and all that end a word.
BREAKS = np.zeros(256, bool)
BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
GAPS = BREAKS.copy()
GAPS[list(b" \t")] = True


@dataclass(frozen=True)
class Scanned:
    """Words of some texts, and hashes of the phrases that begin at each of them."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    # Number of the text of each word, and words from it to the end of its piece.
    row: np.ndarray
    room: np.ndarray
    own: np.ndarray
    lang: np.ndarray

    def phrases(self, length: int) -> np.ndarray:
        """First words of all phrases of a length. Each text with words has one empty phrase, at its first."""
        if length:
            return np.flatnonzero(self.room >= length)
        return np.flatnonzero(np.diff(self.row, prepend=-1))

    def hashes(self, first: np.ndarray, length: int) -> np.ndarray:
        """64 bits of hash of the phrases that begin at these words."""
        lang = mixed(self.lang + np.uint64(length))[self.row[first]]
        return mixed(_run_hashes(self.own, first, length, WORD_BASE) ^ lang)

    @cached_property
    def other(self) -> np.ndarray:
        return mixed(self.own ^ np.uint64(BYTE_BASE))

    def checks(self, first: np.ndarray, length: int) -> np.ndarray:
        """24 bits of another hash, with the length below."""
        checks = mixed(_run_hashes(self.other, first, length, BYTE_BASE) ^ ~self.lang[self.row[first]])
        return ((checks >> np.uint64(40) << np.uint64(8)) | np.uint64(length)).astype(np.uint32)


def _run_hashes(terms: np.ndarray, first: np.ndarray, length: int, base: int) -> np.ndarray:
    """The values of ``range_hashes`` for runs of one length."""
    if length > SHORT:
        return range_hashes(terms, first, first + length, base)
    out = np.zeros(len(first), np.uint64)
    for k in reversed(range(length)):
        out *= np.uint64(base)
        out += terms[first + k]
    return out


def scanned(part: pa.RecordBatch) -> Scanned:
    data, bounds = flat(part.column("text"))
    data = LOWER[data]
    found = words(data, bounds, GAPS)
    row = found.rows()
    piece = np.cumsum(BREAKS[data])[found.starts]
    ends_piece = np.ones(len(row), bool)
    ends_piece[:-1] = (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])
    last = np.flatnonzero(ends_piece)
    room = np.repeat(last, np.diff(last, prepend=-1)) - np.arange(len(row)) + 1 if len(row) else row
    lang = part.column("lang_key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return Scanned(data, found.starts, found.ends, row, room, word_hashes(found), lang)


def _texts(docs: DataFrame) -> DataFrame:
    """(text, lang, lang_key, bucket, sampled by a number from 0 to 1)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    key = F.xxhash64(F.lit("sample"), F.col("doc_id"), text)
    return docs.select(
        text.alias("text"),
        lang.alias("lang"),
        F.xxhash64(lang).alias("lang_key"),
        (F.shiftrightunsigned(key, 56)).cast("short").alias("bucket"),
        (F.pmod(key, F.lit(1 << 20)) / (1 << 20)).alias("draw"),
    )


def _summed(hashes: np.ndarray, checks: np.ndarray, n: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same fields by phrase, in the order of the hashes: sums of ``n``, least ``bucket``."""
    order = np.argsort(hashes)
    equal = np.diff(hashes[order]) == 0
    if (equal & (np.diff(checks[order].astype(np.int64)) != 0)).any():
        order = np.lexsort((checks, hashes))
    hashes, checks = hashes[order], checks[order]
    begins = np.ones(len(order), bool)
    begins[1:] = (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])
    at = np.flatnonzero(begins)
    return hashes[at], checks[at], np.add.reduceat(n[order], at), np.minimum.reduceat(bucket[order], at)


def _packed(held: list[tuple[np.ndarray, ...]], ranges: int) -> pa.RecordBatch:
    """Sums over what a task holds, a row per range of hashes."""
    summed = _summed(*(np.concatenate(field) for field in zip(*held, strict=True)))
    of, begins = np.unique((summed[0] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), return_index=True)
    bounds = [*begins.tolist(), len(summed[0])]
    columns = [pa.array(of.astype(np.int64))]
    for field, kind in zip(summed, FIELDS.values(), strict=True):
        field = field.astype(kind)
        packed = [field[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
        columns.append(pa.array(packed, pa.binary()))
    return pa.RecordBatch.from_arrays(columns, ["range", *FIELDS])


def _counted(
    texts: DataFrame,
    lengths: list[int],
    new: dict[int, Loaded],
    old: dict[int, Loaded],
    run: int,
    split: int,
    least: int,
    ranges: int,
) -> DataFrame:
    """(hash, check, n, bucket) of the phrases of these lengths whose two longest parts pass ``new`` and not both
    ``old``, over all texts, that occur ``least`` times or are empty; ``bucket`` is the least number among texts that
    hold the phrase.

    The filters are by length of part; a length without one is counted whole. ``run`` takes the phrases whose
    first part has these first ``split`` bits of hash. The sums are made in groups by ``ranges`` ranges of the hash.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                found = scanned(part)
                buckets = part.column("bucket").to_numpy().astype(np.uint8)
                for length in lengths:
                    first = found.phrases(length)
                    if length - 1 in new:
                        # The parts of a phrase begin at its first two words.
                        parts = found.phrases(length - 1)
                        hashes = found.hashes(parts, length - 1)
                        known = np.zeros((2, len(found.row) + 1), bool)
                        now = new[length - 1].passes(hashes)
                        known[0, parts] = now & (slice_of(hashes, split) == run)
                        known[1, parts] = now
                        first = first[known[0, first] & known[1, first + 1]]
                        if length - 1 in old and len(first):
                            # Only parts of what is left are looked up.
                            wanted = np.zeros(len(found.row) + 1, bool)
                            wanted[first] = wanted[first + 1] = True
                            some = wanted[parts]
                            before = np.zeros(len(found.row) + 1, bool)
                            before[parts[some]] = old[length - 1].passes(hashes[some])
                            first = first[~(before[first] & before[first + 1])]
                    hashes = found.hashes(first, length)
                    if length - 1 not in new and split:
                        taken = slice_of(hashes, split) == run
                        first, hashes = first[taken], hashes[taken]
                    if not len(first):
                        continue
                    row = found.row[first]
                    n = np.ones(len(first), np.int64) if length else np.bincount(found.row)[row]
                    held.append((hashes, found.checks(first, length), n, buckets[row]))
                    size += len(first)
                if size >= HELD:
                    yield _packed(held, ranges)
                    held, size = [], 0
        if held:
            yield _packed(held, ranges)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[flat(batch.column(c))[0].view(kind) for c, kind in FIELDS.items()] for batch in batches]
        hashes, checks, n, bucket = _summed(*(np.concatenate(field) for field in zip(*held, strict=True)))
        kept = (n >= least) | (checks & np.uint32(255) == 0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(hashes[kept].view(np.int64)),
                pa.array(checks[kept].view(np.int32)),
                pa.array(n[kept]),
                pa.array(bucket[kept].astype(np.int16)),
            ],
            ["hash", "check", "n", "bucket"],
        )

    packed = ", ".join(["range long", *[f"{c} binary" for c in FIELDS]])
    rows = texts.select("text", "lang_key", "bucket").mapInArrow(scan, packed)
    return rows.groupBy("range").applyInArrow(merge, "hash long, check int, n long, bucket short")


def length_of() -> Column:
    return F.col("check").bitwiseAND(F.lit(255))


def _missing(entries: DataFrame, known: Filter) -> DataFrame:
    """The entries that the filter does not hold."""

    def scan(one: Loaded):
        def unheld(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(~one.passes(batch.column("hash").to_numpy().view(np.uint64))))

        return unheld

    slices_of = [known.load(number) for number in range(1 << known.split)]
    return _together([entries.select("hash").mapInArrow(scan(one), "hash long") for one in slices_of])


def frequent_phrases(
    docs: DataFrame,
    most_words: int = MOST_WORDS,
    least: int = LEAST_COUNT,
    share: float = SAMPLE_SHARE,
    lowered: float = LOWERED,
) -> DataFrame:
    """(hash, check, n, bucket) of all phrases of up to ``most_words`` words that occur ``least`` times or more in
    their language, and of the empty phrase of each language, which every word begins.

    Exact for every sample: a small share or a high threshold costs passes.
    """
    if not 1 <= most_words < 256 or least < 1:
        raise ValueError("phrases have 1 to 255 words and occur once at least")
    texts = _texts(docs)
    parts = list(range(1, most_words))
    threshold = max(1, int(lowered * share * least))
    ranges = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = 1 + ranges * most_words // RANGE_BYTES
    new: dict[int, Filter] = {}
    if parts:
        sample = _counted(texts.filter(F.col("draw") < share), parts, {}, {}, 0, 0, threshold, 1 + int(ranges * share))
        proposed = cut(sample.select("hash", "check"), "proposed")
        for length in parts:
            some = proposed.filter(length_of() == length)
            new[length] = Filter(some, some.count())
    old: dict[int, Filter] = {}
    lengths, passes = list(range(most_words + 1)), []
    while lengths:
        used = [(new[m - 1], old.get(m - 1)) for m in lengths if m - 1 in new]
        split = max([0, *[f.split for both in used for f in both if f is not None]])
        for run in range(1 << split):
            now, before = ({k: f.covering(run, split) for k, f in x.items() if k + 1 in lengths} for x in (new, old))
            passes.append(cut(_counted(texts, lengths, now, before, run, split, least, ranges), "frequent"))
            for filters, loaded in ((new, now), (old, before)):
                for length, held in loaded.items():
                    filters[length].release(held)
        # Failures of the border: frequent phrases that the filter does not hold make longer ones possible. The next
        # pass knows all frequent phrases of that length, not only those, as another filter is full elsewhere.
        old, failed = dict(new), []
        for length in parts:
            if length not in lengths:
                continue
            found = _together(passes).filter(length_of() == length).select("hash")
            if not _missing(found, new[length]).isEmpty():
                new[length] = Filter(found, found.count())
                failed.append(length)
        lengths = [length + 1 for length in failed]
    return _together(passes)


def _together(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _in_bucket(hashes: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return mixed(hashes ^ mixed(bucket.astype(np.uint64)))


def with_words(docs: DataFrame, frequent: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """(lang, phrase, words, n) of a table of ``frequent_phrases``, the words joined by a space.

    Only texts of a phrase's least bucket hand its words on, so each phrase travels a few times at most.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = _in_bucket(batch.column("hash").to_numpy().view(np.uint64), batch.column("bucket").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["hash"])

    entries, size = cut_measured(frequent.select("hash", "bucket").mapInArrow(keyed, "hash long"), "places")
    known = Filter(entries, size.rows)

    def read(one: Loaded):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", SLICE_BYTES):
                    found = scanned(part)
                    buckets = part.column("bucket").to_numpy()
                    held, langs = found.data.tobytes(), part.column("lang").to_pylist()
                    for length in range(most_words + 1):
                        first = found.phrases(length)
                        hashes = found.hashes(first, length)
                        place = _in_bucket(hashes, buckets[found.row[first]])
                        at = np.flatnonzero(one.passes(place) & (slice_of(place, one.split) == one.number))
                        at = at[np.unique(hashes[at], return_index=True)[1]]
                        checks = found.checks(first[at], length)
                        hashes, first = hashes[at], first[at].tolist()
                        begin, end, row = found.starts, found.ends, found.row
                        texts = [b" ".join([held[begin[k] : end[k]] for k in range(i, i + length)]) for i in first]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(hashes.view(np.int64)),
                                pa.array(checks.view(np.int32)),
                                pa.array([langs[row[i]] for i in first], pa.string()),
                                pa.array(texts, pa.binary()).cast(pa.string()),
                            ],
                            ["hash", "check", "lang", "phrase"],
                        )

        return scan

    texts = _texts(docs).select("text", "lang", "lang_key", "bucket")
    slices_of = [known.load(number) for number in range(1 << known.split)]
    schema = "hash long, check int, lang string, phrase string"
    handed = _together([texts.mapInArrow(read(one), schema) for one in slices_of])
    named = handed.groupBy("hash", "check").agg(F.min("lang").alias("lang"), F.min("phrase").alias("phrase"))
    named = named.withColumnsRenamed({"hash": "_hash", "check": "_check"})
    both = (F.col("hash") == F.col("_hash")) & (F.col("check") == F.col("_check"))
    return frequent.join(named, both).select("lang", "phrase", length_of().alias("words"), "n")


def exact_score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) of whole numbers below 10**14, in decimals of up to 38 digits."""
    a, left, right = (f"cast({c} AS decimal(14,0))" for c in (a, left, right))
    return F.expr(f"({a} * {a} * {SCALE}) div ({left} * {right})")


def collocations(
    docs: DataFrame,
    most_words: int = MOST_WORDS,
    least: int = LEAST_COUNT,
    covered_percent: int = COVERED_PERCENT,
    top: int = TOP,
    share: float = SAMPLE_SHARE,
    lowered: float = LOWERED,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by score, then by count, then by
    the bytes of the words.

    Texts, A-Z in lower case, are cut into pieces at ``. , ; : ! ?`` and line ends, pieces into words at spaces
    and tabs. A phrase of 2 to ``most_words`` words with a >= ``least`` occurrences is cut after each word into parts with l
    and r occurrences; its score is the least floor(1000000 * a * a / (l * r)), the first such cut counts. A
    phrase within a longer one that has ``covered_percent`` of its occurrences or more is left out, whether that one
    is left out or not. ``n`` counts the words of the language. All counts are exact over whole texts, and
    products are decimals of 38 digits.

    A null text is empty, and neither has words; a null lang is ``und``. Ids may be null or repeat; repeated rows count
    each time. Other columns, whatever their names, are not looked at. An empty table gives no rows.
    """
    frequent = frequent_phrases(docs, most_words, least, share, lowered)
    known, size = cut_measured(with_words(docs, frequent, most_words), "phrases")
    candidates = known.filter("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"))
    split = F.split("phrase", " ")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.slice(split, F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice(split, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"),
    )
    for side, count in (("left", "l"), ("right", "r")):
        counts = known.filter("words >= 1").select(
            F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("n").alias(count)
        )
        # A part that begins or ends very many phrases is a partition that Spark splits.
        cuts = cuts.join(counts, (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_part"))).drop("_lang", "_part")
    best = cuts.withColumn("score", exact_score("a", "l", "r")).groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("_cut")
    )
    # The largest count of a longer phrase around each shorter one: of one with a word more, as a phrase occurs no
    # more often than what is inside it.
    longer = candidates.filter("words > 2")
    ends = [
        longer.select(
            F.col("lang").alias("_lang"),
            F.array_join(F.slice(split, F.lit(at), F.col("words") - 1), " ").alias("_phrase"),
            F.col("a").alias("_longer"),
        )
        for at in (1, 2)
    ]
    around = _together(ends).groupBy("_lang", "_phrase").agg(F.max("_longer").alias("_longer"))
    same = (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase"))
    covered = F.coalesce(100 * F.col("_longer") >= covered_percent * F.col("a"), F.lit(False))
    left = best.join(around, same, "left").filter(~covered)
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    flat_cut = left.select("lang", "phrase", "a", "_cut.score", "_cut.l", "_cut.r")
    ranked = flat_cut.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)
    totals = known.filter("words = 0").select("lang", "n")
    whole = lookup_join(ranked, totals, ["lang"], size)
    return whole.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
