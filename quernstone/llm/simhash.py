"""Near-duplicates by SimHash: fingerprints that differ in few bits, found by ball hashing.

Every distinct fingerprint emits the variants within half the radius. Pairs at distance d meet in a
variant half way: with d even both flip d/2 bits; with d odd the one with an even number of set bits
flips one more. Of three differing bits two lie in the same half of the word, so pairs of flips are
only needed within the halves. A variant can be emitted by as many fingerprints as there are
flips, so no group is larger than that, whatever the documents are. Variants travel packed, several
thousand in a row, and every collision is checked by the number of differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.bytescan import LOWER, Words, flat, slices, spaced, words
from quernstone.llm.components import connected_components
from quernstone.support.cut import cut, cut_measured
from quernstone.support.names import unused

SHINGLE = 3
RADIUS = 3
SEED = 42

# Fingerprints with copies or links that are looked up by a broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000

# Fingerprints expanded at once in a task, and variants in a bucket on average.
CHUNK = 2048
BUCKET_VARIANTS = 1 << 20
MIN_BUCKETS = 64


def _shingle_ranges(found: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the shingles of all texts, and how many each text has."""
    counts = found.counts
    per_text = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), per_text)
    place = np.arange(len(row)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    first = found.first[:-1][row] + place
    last = np.minimum(first + size, found.first[1:][row]) - 1
    return found.starts[first], found.ends[last], per_text


def text_fingerprints(column: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """Fingerprint of each text: a bit is 1 if it is set in over half of the shingles' hashes."""
    data, bounds = flat(column)
    found = spaced(words(LOWER[data], bounds))
    starts, ends, per_text = _shingle_ranges(found, size)
    held = found.data.tobytes()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(held[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)),
        np.uint64,
        len(starts),
    )
    out = np.zeros(len(per_text), np.uint64)
    edges = np.concatenate([[0], np.cumsum(per_text)])
    some = np.flatnonzero(per_text)
    for bit in range(64) if len(some) else ():
        ones = ((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)
        set_in = np.add.reduceat(ones, edges[:-1][some])
        over = 2 * set_in > per_text[some]
        out[some] |= over.astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE
) -> DataFrame:
    """(doc_id, text_key, fp long). Letters A-Z count as a-z; fewer words than ``size`` are one
    shingle; a null or wordless text has fingerprint zero. Repeated rows give repeated rows.
    ``text_key`` is a hash of the text that tells rows with the same id apart."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp = pa.array(text_fingerprints(part.column("text"), size).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), fp], ["doc_id", "text_key", "fp"]
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, text_key long, fp long")


@lru_cache(maxsize=8)
def _flips(radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks that a fingerprint with an even, and one with an odd number of set bits emits."""
    if not 0 <= radius <= 3:
        raise ValueError("radius is 0 to 3")
    none = [0]
    one = [1 << i for i in range(64)]
    two = [1 << i | 1 << j for h in (0, 32) for i, j in combinations(range(h, h + 32), 2)]
    even = (one if radius >= 1 else []) + (two if radius == 3 else [])
    odd = (none if radius >= 1 else []) + (one if radius >= 2 else [])
    return np.array(even, np.uint64), np.array(odd, np.uint64)


def _variants(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All variants, and the fingerprint that each comes from."""
    out = []
    parity = np.bitwise_count(fps) & 1
    for which, masks in enumerate(_flips(radius)):
        own = fps[parity == which]
        out.append(((own[:, None] ^ masks[None, :]).ravel(), np.repeat(own, len(masks))))
    return tuple(np.concatenate([a[i] for a in out]) for i in (0, 1))


def _links(variant: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints that share a variant, each to one of them, checked."""
    order = np.argsort(variant, kind="stable")
    variant, fp = variant[order], fp[order]
    new = np.ones(len(variant), bool)
    new[1:] = variant[1:] != variant[:-1]
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    shared = size[group] > 1
    variant, fp, group = variant[shared], fp[shared], group[shared]
    # Those nearest to the variant are within the radius of all others that meet there.
    away = np.bitwise_count(variant ^ fp)
    order = np.lexsort((fp, away, group))
    group, fp = group[order], fp[order]
    lead = np.ones(len(group), bool)
    lead[1:] = group[1:] != group[:-1]
    centre = fp[np.flatnonzero(lead)][np.cumsum(lead) - 1] if len(fp) else fp
    near = np.bitwise_count(centre ^ fp) <= radius
    near &= centre != fp
    return centre[near], fp[near]


def link_fingerprints(distinct: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that connect all fingerprints within ``radius`` differing bits.

    ``distinct`` has one row per fingerprint (fp long), ``count`` of them. Pairs with a common
    neighbour half way are linked through it, so no group is expanded into all pairs.
    """
    share = sum(map(len, _flips(radius))) / 2
    wanted = max(MIN_BUCKETS, count * share / BUCKET_VARIANTS)
    bits = int(np.ceil(np.log2(wanted)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(every), CHUNK):
                variant, fp = _variants(every[at : at + CHUNK], radius)
                bucket = (variant * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
                order = np.argsort(bucket.astype(np.uint16 if bits <= 16 else np.uint32), kind="stable")
                variant, fp, bucket = variant[order], fp[order], bucket[order]
                flip = _flip_number(variant ^ fp)
                first = np.flatnonzero(np.diff(bucket, prepend=~bucket[:1]))
                last = np.append(first[1:], len(bucket))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[first].astype(np.int64)),
                        pa.array([variant[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary()),
                        pa.array([flip[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary()),
                    ],
                    ["bucket", "variants", "flips"],
                )

    def meet(table: pa.Table) -> pa.Table:
        variant = np.frombuffer(b"".join(table.column("variants").to_pylist()), np.uint64)
        flip = np.frombuffer(b"".join(table.column("flips").to_pylist()), np.uint16)
        u, v = _links(variant, variant ^ _flip_mask(flip), radius)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    packed = distinct.select("fp").mapInArrow(spread, "bucket long, variants binary, flips binary")
    return packed.groupBy("bucket").applyInArrow(meet, "u long, v long")


def _flip_number(mask: np.ndarray) -> np.ndarray:
    """Up to two flipped bits as 7 + 7 bits; 64 stands for none."""
    low = mask & (~mask + np.uint64(1))
    rest = mask ^ low
    first = np.bitwise_count(low - np.uint64(1))
    second = np.bitwise_count(rest - np.uint64(1))
    return first.astype(np.uint16) | second.astype(np.uint16) << np.uint16(7)


def _flip_mask(number: np.ndarray) -> np.ndarray:
    table = np.array([1 << i for i in range(64)] + [0], np.uint64)
    return table[number & np.uint16(127)] | table[number >> np.uint16(7)]


def _first_of_group(
    docs: DataFrame, id_column: str, text_column: str, size: int, radius: int
) -> DataFrame:
    """(doc_id, text_key, fp, first): ``first`` is the row (null ids last) that leads its component."""
    held = cut(fingerprints(docs, id_column, text_column, size), "fingerprints")
    own = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "text_key")
    classes, measured = cut_measured(
        held.groupBy("fp").agg(F.min(own).alias("least"), F.count(F.lit(1)).alias("n")), "fp-classes"
    )
    roots = connected_components(link_fingerprints(classes, measured.rows, radius))
    placed = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "least", "n", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked")
    )
    # A fingerprint of one document without a link needs no entry: it leads itself.
    met = placed.filter("linked or n > 1")
    least = met.groupBy("root").agg(F.min("least").alias("first"))
    firsts, entries = cut_measured(met.select("fp", "root").join(least, "root").select("fp", "first"), "components")
    if entries.rows <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    return held.join(firsts, "fp", "left").withColumn("first", F.coalesce("first", own))


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = SHINGLE,
    radius: int = RADIUS,
) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per document, with the least id reachable by links.

    Documents link when their fingerprints differ in at most ``radius`` bits. Rows with a null id take
    part in links; a component of null ids alone has a null component. An empty table gives no rows.
    """
    grouped = _first_of_group(docs, id_column, text_column, size, radius)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return grouped.select("doc_id", digits.alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_one_per_group(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) without near copies.

    Of each component the row with the least id stays (null ids last), then the least hash of the
    text. Rows that repeat both id and text count as one, and one of them stays.
    """
    grouped = _first_of_group(docs, "doc_id", "text", size, radius)
    led = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")))
    id_name, key_name, led_name, again_name = unused(docs.columns, "_id", "_key", "_led", "_again")
    gone = cut(
        grouped.groupBy(F.col("doc_id").alias(id_name), F.col("text_key").alias(key_name)).agg(
            F.max(led).alias(led_name), (F.count(F.lit(1)) > 1).alias(again_name)
        ).filter(F.col(led_name) | F.col(again_name)),
        "copies",
    )
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    same = F.col("doc_id").eqNullSafe(F.col(id_name)) & (key == F.col(key_name))
    kept = docs.join(gone, same, "left_anti")
    again = gone.filter(~F.col(led_name))
    if again.isEmpty():
        return kept
    several = docs.join(again, same, "left_semi").withColumn(key_name, key)
    return kept.unionByName(several.dropDuplicates(["doc_id", key_name]).drop(key_name))
