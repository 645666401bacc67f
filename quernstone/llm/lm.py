"""Language-model scoring: a log-bilinear model trained with noise-contrastive estimation.

Tokens are lower-cased words, and an end after each document. All training documents are counted and
all of them train the model in rounds: every task runs gradient steps from the last average over its
documents of the round, and parameters are averaged by tokens. The model has two levels. The first predicts the most
frequent words and classes of all others from the two tokens before; the number of classes grows with
the square root of the distinct words, up to a bound. The second predicts the word within its class from the token
before: every counted word has a vector of its own, learned from all its places, one class at a time.
Both are normalised by batched matrix products, over all pairs of context tokens and over all words
of a class for every token before. As context a word outside the most frequent ones is its class.

Counts and vectors of frequent words travel to the tasks; those of all others stay a table and meet the
documents in a join, after each document has reduced its words to one row per word and token before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.bytescan import LOWER, flat, mixed, slices, word_hashes, words
from quernstone.support.cut import cut, cut_measured

# Words that are classes of their own, and frequent words whose counts and vectors every task holds.
MODEL_WORDS = 1000
MOST_CLASSES = 4096
HELD_WORDS = 1 << 17

DIMENSIONS = 16
NOISE = 32
BATCH = 2048
RATE = 0.1

# Passes over the places of a class, places at which a word has half of what its vector learned, tokens
# that a task holds before it hands them on, and words of a class normalised at once.
CLASS_PASSES = 2
HALF_LEARNED = 10
HELD_TOKENS = 1 << 20
CLASS_ROWS = 512
# Places of a class that one task learns from, or so, and parts of a class put together in one task.
CLASS_TOKENS = 1 << 22
MERGED = 16

# Tokens that a training task has at least, if there are as many, and those of the first round. Each
# time the corpus is four times as large, a round is added.
TASK_TOKENS = 1 << 20
ROUND_TOKENS = 1 << 18

# Parameters averaged in one task, and first sums of each.
SLICE = 4096
FIRST_SUMS = 32

END = mixed(np.array([0x656E64], np.uint64))[0]


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each followed by the end, and where each text begins."""
    data, bounds = flat(column)
    found = words(LOWER[data], bounds)
    begins = found.first + np.arange(len(found.first))
    out = np.full(int(begins[-1]), END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[begins[1:] - 1] = False
    out[inside] = word_hashes(found)
    return out, begins


def count_tokens(docs: DataFrame) -> DataFrame:
    """(hash, n): how often each token occurs in ``docs``, with the words of a batch added up first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [tokens(part.column("text"))[0] for part in slices(batch, "text")]
            if held:
                hashes, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n)], ["hash", "n"])

    partial = docs.select("text").mapInArrow(count, "hash long, n long")
    return partial.groupBy("hash").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """Frequent tokens by hash, with counts and their number in the model.

    Units of the model are the ``known`` most frequent tokens and, after them, the classes of all other
    hashes; ``shares`` has one of each unit. A class has room for one token that was never seen.
    """

    hashes: np.ndarray
    counts: np.ndarray
    number: np.ndarray
    shares: np.ndarray
    total: int
    distinct: int
    known: int
    # Places of the words of each class.
    class_tokens: np.ndarray

    @property
    def classes(self) -> int:
        return len(self.shares) - self.known

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each token among those held, and whether it is one of them."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each token (0 where it is not held), and its unit in the model."""
        unit = self.known + class_numbers(hashes, self.classes)
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), unit
        at, held = self.places(hashes)
        return np.where(held, self.counts[at], 0), np.where(held & (self.number[at] < self.known), self.number[at], unit)


def class_count(words: int) -> int:
    """Classes of so many words: half the square root, so that classes and their sizes both grow.

    From MOST_CLASSES on only their sizes grow: norms of pairs of units are sent to all tasks, and have a bound so.
    """
    return min(MOST_CLASSES, max(1, int(np.ceil(np.sqrt(words) / 2))))


def class_numbers(hashes: np.ndarray, classes: int) -> np.ndarray:
    return ((hashes >> np.uint64(33)) % np.uint64(classes)).astype(np.int64)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The words of the model and those held, from a table of counts.

    As many of the most frequent words are held as whole classes of counts fit into HELD_WORDS; the
    classes are eighths of a power of two, so their sizes are few and no task ranks all words.
    """
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    level = F.floor(F.log2("n") * 8)
    held, least = 0, None
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # some hundreds
        held += row["count"]
        if held > HELD_WORDS:
            break
        least = row["level"]
    top = counts.filter(level >= least) if least is not None else counts.limit(0)
    top = top.toPandas().sort_values(["n", "hash"], ascending=[False, True])  # HELD_WORDS at most
    hashes, n = top["hash"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    known = min(MODEL_WORDS, len(n))
    number = np.minimum(np.arange(len(n)), known)
    classes = class_count(distinct - known)
    rest, places = np.ones(classes, np.int64), np.zeros(classes, np.int64)
    of_class = counts.groupBy((F.shiftrightunsigned("hash", 33) % classes).alias("class"))
    for row in of_class.agg(F.sum(F.col("n") + 1).alias("n"), F.sum("n").alias("places")).collect():  # one row per class
        rest[row["class"]] += row["n"]
        places[row["class"]] += row["places"]
    np.subtract.at(rest, class_numbers(hashes[:known], classes), n[:known] + 1)
    np.subtract.at(places, class_numbers(hashes[:known], classes), n[:known])
    shares = np.append(n[:known] + 1, rest) / (total + distinct + classes)
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], n[order], number[order], shares, int(total), int(distinct), known, places)


def contexts(number: np.ndarray, begins: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The token before each token and the one before that; ``start`` where there is none."""
    last, second = np.full(len(number), start), np.full(len(number), start)
    last[1:], second[2:] = number[:-1], number[:-2]
    first = begins[:-1]
    last[first] = second[first] = start
    again = first[first + 1 < begins[1:]] + 1
    second[again] = start
    return last, second


@dataclass
class Parameters:
    """Vectors of context tokens and of predicted ones, weights of the two places, and offsets."""

    context: np.ndarray
    place: np.ndarray
    target: np.ndarray
    offset: np.ndarray
    seen: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def start(cls, shares: np.ndarray, seed: int = 11) -> Parameters:
        random, n = np.random.default_rng(seed), len(shares)
        context = random.normal(0, 0.1, (n + 1, DIMENSIONS)).astype(np.float32)
        target = random.normal(0, 0.1, (n, DIMENSIONS)).astype(np.float32)
        place = np.ones((2, DIMENSIONS), np.float32)
        return cls(context, place, target, np.log(shares).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.place, self.target, self.offset]

    def flat(self) -> np.ndarray:
        """All parameters, and the squares of gradients that each has seen."""
        seen = self.seen or [np.full(p.shape, 1e-10, np.float32) for p in self.parts()]
        return np.concatenate([p.ravel() for p in [*self.parts(), *seen]])

    def filled(self, values: np.ndarray) -> Parameters:
        out, at = [], 0
        for part in [*self.parts(), *self.parts()]:
            out.append(values[at : at + part.size].reshape(part.shape).astype(np.float32))
            at += part.size
        return Parameters(*out[:4], out[4:])

    def step(self, last: np.ndarray, second: np.ndarray, word: np.ndarray, noise: np.ndarray, prior: np.ndarray) -> None:
        """One gradient step: each word against the same drawn noise; ``prior`` is log(draws * share)."""
        a, b = self.context[last], self.context[second]
        hidden = self.place[0] * a + self.place[1] * b
        own, drawn = self.target[word], self.target[noise]
        likely = np.einsum("ij,ij->i", hidden, own) + self.offset[word] - prior[word]
        other = hidden @ drawn.T + (self.offset[noise] - prior[noise])
        miss = -1 / (1 + np.exp(np.clip(likely, -30, 30)))
        false = 1 / (1 + np.exp(-np.clip(other, -30, 30)))
        back = miss[:, None] * own + false @ drawn
        scale = 1 / len(word)
        gradients = [
            _gathered([last, second], [back * self.place[0], back * self.place[1]], self.context.shape) * scale,
            np.stack([(back * a).sum(0), (back * b).sum(0)]) * scale,
            _gathered([word, noise], [miss[:, None] * hidden, false.T @ hidden], self.target.shape) * scale,
            (np.bincount(word, miss, len(self.offset)) + np.bincount(noise, false.sum(0), len(self.offset))) * scale,
        ]
        if not self.seen:
            self.seen = [np.full(p.shape, 1e-10, np.float32) for p in self.parts()]
        for part, gradient, seen in zip(self.parts(), gradients, self.seen, strict=True):
            seen += gradient.astype(np.float32) ** 2
            part -= RATE * gradient.astype(np.float32) / np.sqrt(seen)


def _gathered(rows: list[np.ndarray], values: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Sums of the values by row."""
    place = np.concatenate(rows)[:, None] * shape[1] + np.arange(shape[1])
    return np.bincount(place.ravel(), np.concatenate(values).ravel(), shape[0] * shape[1]).reshape(shape)


def train(docs: DataFrame, words_held, start: Parameters) -> Parameters:
    """Parameters after rounds over all documents, each in one of them by a hash of its text.

    Small partitions are put together first, so that a task has enough steps to learn from.
    """
    total = words_held.value.total
    packed = docs.select("text").coalesce(max(1, -(-total // TASK_TOKENS)))
    rounds = 1 + (total // ROUND_TOKENS).bit_length() // 2
    for number in range(rounds):
        own = packed.filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == number)
        start = train_round(own, words_held, start, number)
    return start


def train_round(docs: DataFrame, words_held, start: Parameters, number: int) -> Parameters:
    """Parameters after every task has passed its documents once, averaged by tokens."""
    size = len(start.flat())

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own, seen = words_held.value, start.filled(start.flat()), 0
        part = TaskContext.get().partitionId()
        random, drawn = np.random.default_rng([number, part]), np.cumsum(known.shares)
        prior = np.log(NOISE * known.shares).astype(np.float32)
        for batch in batches:
            for piece in slices(batch, "text"):
                hashes, begins = tokens(piece.column("text"))
                word = known.find(hashes)[1]
                last, second = contexts(word, begins, len(known.shares))
                for at in range(0, len(word), BATCH):
                    some = slice(at, at + BATCH)
                    noise = np.minimum(np.searchsorted(drawn, random.random(NOISE)), len(known.shares) - 1)
                    own.step(last[some], second[some], word[some], noise, prior)
                seen += len(word)
        if seen:
            values = own.flat().astype(np.float64) * seen
            pieces = [values[at : at + SLICE].tobytes() for at in range(0, size, SLICE)]
            n = len(pieces)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(n)), pa.array([part % FIRST_SUMS] * n), pa.array(pieces, pa.binary()), pa.array([float(seen)] * n)],
                ["slice", "share", "sums", "weight"],
            )

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, weight = 0.0, 0.0
        for batch in batches:
            for more, own in zip(batch.column("sums").to_pylist(), batch.column("weight").to_pylist(), strict=True):
                sums, weight = sums + np.frombuffer(more), weight + own
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()]), pa.array([0]), pa.array([sums.tobytes()], pa.binary()), pa.array([weight])],
            ["slice", "share", "sums", "weight"],
        )

    schema = "slice long, share long, sums binary, weight double"
    learned = docs.select("text").mapInArrow(learn, schema)
    sums = learned.groupBy("slice", "share").applyInArrow(add, schema).groupBy("slice").applyInArrow(add, schema)
    found = sorted(sums.collect())  # one row per slice of a model of fixed size
    if not found:
        return start
    return start.filled(np.concatenate([np.frombuffer(r["sums"]) / r["weight"] for r in found]))


@dataclass(frozen=True)
class Tables:
    """The model's parameters, and the norm of each pair of context tokens."""

    model: Parameters
    norm: np.ndarray

    def log_probabilities(self, last: np.ndarray, second: np.ndarray, word: np.ndarray) -> np.ndarray:
        m, out = self.model, np.empty(len(word))
        first, other = m.place[0] * m.context, m.place[1] * m.context
        for at in range(0, len(word), 1 << 16):
            some = slice(at, at + (1 << 16))
            logits = np.einsum("ij,ij->i", first[last[some]] + other[second[some]], m.target[word[some]])
            out[some] = logits + m.offset[word[some]] - self.norm[last[some], second[some]]
        return out


def tables(docs: DataFrame, model: Parameters) -> Tables:
    """Normalise over all units for every pair of context tokens, one row per token before."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        # A sum of exp(a + b) over units is a product of exp(a) and exp(b), each scaled by its largest.
        second = ((m.place[1] * m.context) @ m.target.T).astype(np.float64)
        other = second.max(axis=1)
        weights = np.exp(second - other[:, None]).T
        for batch in batches:
            ids = batch.column("id").to_numpy()
            first = ((m.place[0] * m.context[ids]) @ m.target.T + m.offset).astype(np.float64)
            top = first.max(axis=1)
            norm = np.log(np.exp(first - top[:, None]) @ weights) + top[:, None] + other
            rows = [x.tobytes() for x in norm.astype(np.float32)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.binary())], ["id", "norm"])

    n = len(model.context)
    rows = spark.range(0, n, 1, max(16, n // 64)).mapInArrow(norms, "id long, norm binary").collect()  # the model's units
    return Tables(model, np.stack([np.frombuffer(r["norm"], np.float32) for r in sorted(rows)]))


def features(model: Parameters) -> np.ndarray:
    """What a word's vector is held against for each token before: its context vector, standardised."""
    values = model.place[0] * model.context
    return ((values - values.mean(axis=0)) / (values.std(axis=0) + 1e-6)).astype(np.float32)


def fit_class(hashes: np.ndarray, last: np.ndarray, before: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of one class, their counts and vectors, and the log norm for each token before."""
    found, n, vectors = learn_class(hashes, last, before, seed)
    return found, n, *finish_class(n, vectors, before)


def learn_class(hashes: np.ndarray, last: np.ndarray, before: np.ndarray, seed: int | list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of one class, their counts, and the vectors that they learn from these places.

    By noise-contrastive estimation against the words' shares.
    """
    order = np.lexsort((last, hashes))
    found, word, n = np.unique(hashes[order], return_inverse=True, return_counts=True)
    last, random = last[order], np.random.default_rng(seed)
    drawn = np.cumsum(n / n.sum())
    vectors, seen = np.zeros((len(found), before.shape[1]), np.float32), np.full((len(found), before.shape[1]), 1e-10, np.float32)
    prior = np.float32(np.log(NOISE))
    for _ in range(CLASS_PASSES):
        turn = random.permutation(len(word))
        for at in range(0, len(turn), BATCH):
            some = turn[at : at + BATCH]
            noise = np.minimum(np.searchsorted(drawn, random.random(NOISE)), len(found) - 1)
            hidden, own = before[last[some]], word[some]
            likely = np.einsum("ij,ij->i", hidden, vectors[own]) - prior
            other = hidden @ vectors[noise].T - prior
            miss = -1 / (1 + np.exp(np.clip(likely, -30, 30)))
            false = 1 / (1 + np.exp(-np.clip(other, -30, 30)))
            gradient = _gathered([own, noise], [miss[:, None] * hidden, false.T @ hidden], vectors.shape) / len(some)
            seen += gradient.astype(np.float32) ** 2
            vectors -= RATE * gradient.astype(np.float32) / np.sqrt(seen)
    return found, n, vectors


def merge_class(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, counts and vectors of a class from those of its parts, vectors averaged by the places they saw."""
    hashes, n, vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
    found, word = np.unique(hashes, return_inverse=True)
    total = np.bincount(word, n, len(found)).astype(np.int64)
    sums = _gathered([word], [vectors * n[:, None]], (len(found), vectors.shape[1]))
    return found, total, (sums / total[:, None]).astype(np.float32)


def finish_class(n: np.ndarray, vectors: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a whole class as they are used, and the log norm for each token before.

    A word w of count n after token t weighs (n + 1) * exp(vector[w] . before[t]), and words never seen weigh 1
    together; a word of few places keeps little of what they say.
    """
    vectors = vectors * (n / (n + HALF_LEARNED)).astype(np.float32)[:, None]
    sums = np.ones(len(before))
    for at in range(0, len(n), CLASS_ROWS):
        some = slice(at, at + CLASS_ROWS)
        weights = vectors[some] @ before.T
        sums += (n[some] + 1).astype(np.float32) @ np.exp(weights, out=weights)
    return vectors, np.log(sums).astype(np.float32)


def train_classes(docs: DataFrame, words_held, before_held) -> DataFrame:
    """(class, hashes, counts, vectors, norm), one row per class with a word in ``docs``.

    The places of a class are dealt by text into parts of CLASS_TOKENS or so, each of which learns by itself; the
    parts of a class are put together MERGED at a time. So no task gets more than that, however large the corpus.
    """
    parts_of = np.maximum(1, -(-words_held.value.class_tokens // CLASS_TOKENS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words_held.value

        def hand_on(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            number, hashes, last = (np.concatenate(x) for x in zip(*held, strict=True))
            # The class, and the part below it.
            order = np.argsort(number, kind="stable")
            number, hashes, last = number[order], hashes[order], last[order].astype(np.int32)
            first = np.flatnonzero(np.diff(number, prepend=-1))
            ends = [*first[1:].tolist(), len(number)]
            runs = list(zip(first.tolist(), ends, strict=True))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(number[first] >> 32),
                    pa.array(number[first] & ((1 << 32) - 1)),
                    pa.array([hashes[a:b].tobytes() for a, b in runs], pa.binary()),
                    pa.array([last[a:b].tobytes() for a, b in runs], pa.binary()),
                ],
                ["class", "part", "hashes", "last"],
            )

        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, begins = tokens(part.column("text"))
                unit = known.find(hashes)[1]
                last = contexts(unit, begins, len(known.shares))[0]
                some = np.flatnonzero(unit >= known.known)
                if len(some):
                    number = unit[some] - known.known
                    text = part.column("text_key").to_numpy()[np.searchsorted(begins, some, "right") - 1]
                    held.append((number << 32 | text % parts_of[number], hashes[some], last[some]))
                    size += len(some)
                if size >= HELD_TOKENS:
                    yield hand_on(held)
                    held, size = [], 0
        if held:
            yield hand_on(held)

    def fit(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last = [], []
        for batch in batches:
            hashes += [np.frombuffer(x, np.uint64) for x in batch.column("hashes").to_pylist()]
            last += [np.frombuffer(x, np.int32) for x in batch.column("last").to_pylist()]
        number, part = key[0].as_py(), key[1].as_py()
        made = learn_class(np.concatenate(hashes), np.concatenate(last), before_held.value, [number, part] if part else number)
        yield packed(number, part, made)

    def packed(number: int, part: int, made: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        values = [pa.array([x.tobytes()], pa.binary()) for x in made]
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([part]), *values], ["class", "part", *names[: len(made)]])

    def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        columns = (batch.column(c).to_pylist() for c in ("class", "hashes", "counts", "vectors"))
        for number, hashes, n, vectors in zip(*columns, strict=True):
            shaped = np.frombuffer(vectors, np.float32).reshape(-1, DIMENSIONS)
            yield number, (np.frombuffer(hashes, np.uint64), np.frombuffer(n, np.int64), shaped)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield packed(key[0].as_py(), key[1].as_py(), merge_class([made for b in batches for _, made in unpacked(b)]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, (hashes, n, vectors) in unpacked(batch):
                yield packed(number, 0, (hashes, n, *finish_class(n, vectors, before_held.value)))

    names = ["hashes", "counts", "vectors", "norm"]
    schema = "class long, part long, hashes binary, counts binary, vectors binary"
    keyed = docs.select("text", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("text_key"))
    dealt = keyed.mapInArrow(deal, "class long, part long, hashes binary, last binary")
    learned = dealt.groupBy("class", "part").applyInArrow(fit, schema)
    most = int(parts_of.max(initial=1))
    while most > 1:
        learned = learned.withColumn("part", F.expr(f"part div {MERGED}")).groupBy("class", "part").applyInArrow(merge, schema)
        most = -(-most // MERGED)
    return learned.mapInArrow(finish, schema + ", norm binary").drop("part")


def word_rows(learned: DataFrame) -> DataFrame:
    """(hash, n, vector) of the words of all classes."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, n, vectors in zip(*(batch.column(c).to_pylist() for c in ("hashes", "counts", "vectors")), strict=True):
                width = 4 * DIMENSIONS
                rows = [vectors[at : at + width] for at in range(0, len(vectors), width)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(hashes, np.int64)), pa.array(np.frombuffer(n, np.int64)), pa.array(rows, pa.binary())],
                    ["hash", "n", "vector"],
                )

    return learned.select("hashes", "counts", "vectors").mapInArrow(unpack, "hash long, n long, vector binary")


@dataclass(frozen=True)
class Second:
    """Features of the tokens before, norms by class and token before, and vectors of the words held."""

    before: np.ndarray
    norm: np.ndarray
    vectors: np.ndarray


def second_level(learned: DataFrame, known: Vocabulary, before: np.ndarray) -> Second:
    norm = np.zeros((known.classes, len(before)), np.float32)
    for row in learned.select("class", "norm").toLocalIterator():  # one row per class
        norm[row["class"]] = np.frombuffer(row["norm"], np.float32)
    vectors = np.zeros((len(known.hashes), DIMENSIONS), np.float32)
    if len(known.hashes):
        least = int(known.counts.min())
        rows = word_rows(learned).filter(F.col("n") >= least).toPandas()  # HELD_WORDS at most
        at, held = known.places(rows["hash"].to_numpy(np.int64).view(np.uint64))
        if held.any():
            vectors[at[held]] = np.frombuffer(b"".join(rows["vector"][held]), np.float32).reshape(-1, DIMENSIONS)
    return Second(before, norm, vectors)


def score(docs: DataFrame, train_column: str = "train") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    ``docs`` has doc_id, text and a boolean column that marks what is learned from. ``base_score`` is
    the smoothed unigram log10 probability of the text, ``score`` the model's. A null or empty text is one
    end. Without a training document each known count is 0 and both scores are those of a uniform model of one word.
    Texts are read whole, however long; repeated rows are learned from and scored each by itself, an empty table gives
    none. Other columns, whatever their names, are not looked at.
    """
    rows = docs.select(
        "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col(train_column).alias("train")
    )
    learned = rows.filter("train")
    counts = cut(count_tokens(learned), "token-counts")
    known = vocabulary(counts)
    held = rows.sparkSession.sparkContext.broadcast(known)
    model = train(learned, held, Parameters.start(known.shares))
    context = rows.sparkSession.sparkContext
    before = features(model)
    before_held = context.broadcast(before)
    classes = cut(train_classes(learned, held, before_held), "word-vectors")
    looked_up = context.broadcast((tables(rows, model), second_level(classes, known, before)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (norms, level) = held.value, looked_up.value
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, begins = tokens(part.column("text"))
                count, word = known.find(hashes)
                last, second = contexts(word, begins, len(known.shares))
                log = np.log10(count + 1.0)
                own = norms.log_probabilities(last, second, word)
                other = np.flatnonzero(word >= known.known)
                own[other] -= level.norm[word[other] - known.known, last[other]]
                near = other[count[other] > 0]
                at = known.places(hashes[near])[0]
                own[near] += log[near] * np.log(10) + np.einsum("ij,ij->i", level.vectors[at], level.before[last[near]])
                own /= np.log(10)
                first = begins[:-1]
                total = lambda values, first=first: pa.array(np.add.reduceat(values, first))
                rare = np.flatnonzero(count == 0)
                row = np.searchsorted(begins, rare, "right") - 1
                order = np.lexsort((last[rare], hashes[rare], row))
                row, after, rare = row[order], last[rare[order]], hashes[rare[order]]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (rare[1:] != rare[:-1]) | (after[1:] != after[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(row)))
                ends = pa.array(np.searchsorted(row[at], np.arange(len(begins))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("train"),
                        pa.array(np.diff(begins)),
                        total((count > 0).astype(np.int64)),
                        total(log),
                        total(own.astype(np.float64)),
                        pa.ListArray.from_arrays(ends, pa.array(rare[at].view(np.int64))),
                        pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int64))),
                        pa.ListArray.from_arrays(ends, pa.array(after[at].astype(np.int32))),
                    ],
                    ["doc_id", "train", "n_tokens", "n_held", "log_held", "model", "rare", "times", "after"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    scanned = rows.mapInArrow(
        scan,
        f"doc_id {kind}, train boolean, n_tokens long, n_held long, log_held double, model double, "
        "rare array<long>, times array<long>, after array<int>",
    )
    # Written, so that the number of a row stays the same for both sides of the join.
    table = cut(scanned.withColumn("row", F.monotonically_increasing_id()), "token-scores")
    rare = table.select("row", F.explode(F.arrays_zip("rare", "times", "after")).alias("r")).select(
        "row", F.col("r.rare").alias("hash"), F.col("r.times").alias("times"), F.col("r.after").alias("after")
    )

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = before_held.value
        for batch in batches:
            times, n, after = (batch.column(c).to_numpy() for c in ("times", "n", "after"))
            vectors = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.float32).reshape(-1, DIMENSIONS)
            log = times * np.log10(n + 1.0)
            gain = times * np.einsum("ij,ij->i", vectors, before[after]) / np.log(10)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("times"), pa.array(log), pa.array(gain)], ["row", "times", "log_n", "gain"]
            )

    met = rare.join(word_rows(classes), "hash").select("row", "times", "after", "n", "vector")
    weighed = met.mapInArrow(weigh, "row long, times long, log_n double, gain double")
    found = weighed.groupBy("row").agg(
        F.sum("log_n").alias("log_rare"), F.sum("gain").alias("gain"), F.sum("times").alias("n_rare")
    )
    joined = table.drop("rare", "times", "after").join(
        found.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"), "left"
    )
    log_rare, n_rare = F.coalesce("log_rare", F.lit(0.0)), F.coalesce("n_rare", F.lit(0))
    everything = known.total + known.distinct + 1
    base = F.col("log_held") + log_rare - F.col("n_tokens") * float(np.log10(everything))
    model_score = F.col("model") + log_rare + F.coalesce("gain", F.lit(0.0))
    return joined.select(
        "doc_id",
        "train",
        "n_tokens",
        (F.col("n_held") + n_rare).alias("n_known"),
        F.lit(known.total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        model_score.alias("score"),
    )
