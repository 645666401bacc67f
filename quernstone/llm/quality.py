"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax.

Vectors and the output layer are learned together by stochastic gradient descent in numpy on a
bounded sample of labelled documents. As the output is linear in the average, each bucket's share of
the logit is one number once the training is done, and a document is scored by averaging those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.bytescan import flat, mixed, slices, spaced, word_hashes, words

BUCKET_BITS = 16
CHARACTER_GRAMS = (3, 5)
DIMENSIONS = 16
EPOCHS = 12
RATE = 0.5
# Labelled documents of each class that are learned from, at most.
SAMPLE_PER_CLASS = 2000
THRESHOLD = 0.3
FOLDS = 5

# Bytes of text whose features are held at once, some hundred times as many bytes.
FEATURE_SLICE = 1 << 19

_SHIFT = np.uint64(64 - BUCKET_BITS)


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts, and how many each text has.

    A text has one for itself, one for each word and pair of neighbouring words (all pairs of a word
    with itself share one), and one for each run of 3 and of 5 bytes of its words, joined by spaces.
    """
    data, bounds = flat(column)
    found = spaced(words(data, bounds))
    n, counts = len(found.first) - 1, found.counts
    row = found.rows()
    own = word_hashes(found)
    parts = [(np.arange(n), np.full(n, mixed(np.zeros(1, np.uint64))[0])), (row, own)]
    same = np.flatnonzero(row[1:] == row[:-1])
    pair = mixed(own[same] * np.uint64(3) + own[same + 1])
    pair[own[same] == own[same + 1]] = mixed(np.ones(1, np.uint64))[0]
    parts.append((row[same], pair))
    padded = np.concatenate([found.data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(found.data),), "<u8", padded, strides=(1,))
    byte_row = np.repeat(row, found.ends - found.starts + 1)
    some = counts > 0
    last = np.zeros(n, np.int64)
    last[some] = found.ends[found.first[1:][some] - 1]
    for size in CHARACTER_GRAMS:
        at = np.flatnonzero(np.arange(len(byte_row)) + size <= last[byte_row] + 1)
        gram = eight[at] & np.uint64((1 << 8 * size) - 1)
        parts.append((byte_row[at], mixed(gram + np.uint64(size << 56))))
    rows = np.concatenate([p[0] for p in parts])
    buckets = (np.concatenate([p[1] for p in parts]) >> _SHIFT).astype(np.uint16)
    order = np.argsort(rows, kind="stable")
    return buckets[order], np.bincount(rows, minlength=n)


@dataclass(frozen=True)
class Model:
    """Share of each bucket in the logit of class 1, and the constant."""

    shares: np.ndarray
    constant: float

    def scores(self, column: pa.Array) -> np.ndarray:
        buckets, counts = features(column)
        if not len(counts):
            return np.zeros(0)
        sums = np.add.reduceat(self.shares[buckets].astype(np.float64), np.cumsum(counts) - counts)
        return 1 / (1 + np.exp(-np.clip(sums / counts + self.constant, -500, 500)))


def train(texts: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Model:
    """Softmax over averaged vectors, by plain gradient steps on one document at a time.

    Each text is (buckets, counts, label); classes should be about equally frequent.
    """
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    output, offset = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    steps, step = EPOCHS * len(texts), 0
    weights = [(c / c.sum()).astype(np.float32) for _, c, _ in texts]
    for _ in range(EPOCHS):
        for i in random.permutation(len(texts)):
            buckets, _, label = texts[i]
            rate = RATE * (1 - step / steps)
            average = weights[i] @ vectors[buckets]
            logits = output @ average + offset
            likely = np.exp(logits - logits.max())
            error = likely / likely.sum()
            error[label] -= 1
            back = output.T @ error
            output -= rate * np.outer(error, average)
            offset -= rate * error
            # An average of n vectors passes 1/n of its gradient to each; n steps make that whole.
            vectors[buckets] -= rate * np.outer(np.minimum(weights[i] * len(buckets), 8.0), back)
            step += 1
    return Model(vectors @ (output[1] - output[0]), float(offset[1] - offset[0]))


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, sample: int = SAMPLE_PER_CLASS) -> Model:
    """Learn from ``labels`` (doc_id, quality 0 or 1) of documents outside fold 0.

    At most ``sample`` documents of each class are taken, by a hash of their id; the odds of the whole
    are put back afterwards. Null labels do not count, of several for a document their mean does.
    With one class only, or none, every score is the smoothed share of class 1.
    """
    known = labels.filter(F.col("quality").isNotNull() & ~in_fold(F.col("doc_id"), folds, 0))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    ones, total = known.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    zeros = total - ones
    odds = float(np.log((ones + 1) / (zeros + 1)))
    shares = np.zeros(1 << BUCKET_BITS, np.float32)
    if not ones or not zeros:
        return Model(shares, odds)
    # By a threshold on the hash, a little below the bound, so that nothing has to be ordered.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = [1.0 if n <= sample else 0.95 * sample / n for n in (zeros, ones)]
    below = [known.filter((F.col("label") == k) & (place < int(share[k] * (1 << 30)))) for k in (0, 1)]
    chosen = below[0].limit(sample).unionByName(below[1].limit(sample)).withColumnRenamed("doc_id", "_id")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select("doc_id", text).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("label", "text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", FEATURE_SLICE):
                buckets, counts = features(part.column("text"))
                ends = np.cumsum(counts)
                seen = [np.unique(buckets[b - c : b], return_counts=True) for b, c in zip(ends, counts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("label"),
                        pa.array([b.tobytes() for b, _ in seen], pa.binary()),
                        pa.array([c.astype(np.uint32).tobytes() for _, c in seen], pa.binary()),
                    ],
                    ["label", "buckets", "counts"],
                )

    def learn(table: pa.Table) -> pa.Table:
        texts = sorted(zip(*(table.column(c).to_pylist() for c in ("label", "buckets", "counts")), strict=True))
        model = train([(np.frombuffer(b, np.uint16), np.frombuffer(c, np.uint32), k) for k, b, c in texts])
        odds = np.log(max(1, sum(k for k, _, _ in texts)) / max(1, sum(1 - k for k, _, _ in texts)))
        return pa.table({"shares": [model.shares.tobytes()], "constant": [model.constant - float(odds)]})

    bounded = rows.mapInArrow(gather, "label int, buckets binary, counts binary").limit(2 * sample)
    bounded = bounded.withColumn("sample", F.col("label") * 0)  # one bounded group
    learned = bounded.groupBy("sample").applyInArrow(learn, "shares binary, constant double").first()
    if learned is None:
        return Model(shares, odds)
    return Model(np.frombuffer(learned["shares"], np.float32), learned["constant"] + odds)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): likelihood of label 1 by the text alone; null and empty texts have one too.

    Whole texts are read, however long. Equal texts have equal scores; repeated rows and null ids give rows of their own,
    an empty table none. Other columns, whatever their names, are not looked at.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", FEATURE_SLICE):
                scores = pa.array(model.scores(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), scores], ["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more. All columns are kept, whatever their names.

    A null text scores as an empty one and stays null. Rows that repeat a text stay or go together; a score that equals
    the threshold stays; an empty table gives none.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text = names[docs.columns.index("text")]
    schema = StructType([*plain.schema.fields, StructField("score", DoubleType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, FEATURE_SLICE):
                scores = pa.array(model.scores(part.column(text)))
                yield pa.RecordBatch.from_arrays([*part.columns, scores], [*names, "score"])

    scored = plain.mapInArrow(scan, schema)
    return scored.filter(F.col("score") >= threshold).drop("score").toDF(*docs.columns)
