"""Tokenising, corpus-wide vocabulary, and count vectors over it.

A row is a document. The counts of a document's terms are computed inside its row, so neither the
vocabulary's document frequencies nor the count vectors shuffle ``(document, term)`` pairs: the fit
shuffles map-side-combined terms once, the transform against a broadcast vocabulary shuffles
nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizerModel as SparkCountVectorizerModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quernstone.functions.text import no_tokens, run_lengths, run_starts, split_body, token_body
from quernstone.operators.base import FitStep, FittedStep, PlainStep, check_invalid
from quernstone.support.cut import Size, cut, cut_measured, discard, measure, scratch_path
from quernstone.support.lookup import BROADCAST_BYTES, BROADCAST_ROWS
from quernstone.support.names import unused
from quernstone.support.ranking import SINGLE_TASK_ROWS, rank_rows

# Terms of a slice of the vocabulary that every task holds, at most and at least, and slices it holds at once.
LOCAL_TERMS = 1_000_000
LEAST_TERMS = 200
HELD_SLICES = 2
# Terms that are handed to the vectoriser one by one; more are read by it from a file.
FEW_TERMS = 1000

# Buckets that tokens are counted in before terms are, where few terms are sought.
BUCKETS = 1 << 17


class Tokenizer(PlainStep):
    """``text`` to an array of lower-case tokens, split on ASCII white space.

    ``invalid`` decides on a null text: ``error`` fails the query, ``skip`` drops the row,
    ``keep`` gives null tokens. ``drop_empty`` removes the empty tokens between separators.
    """

    def __init__(
        self,
        input_column: str = "text",
        output_column: str = "tokens",
        drop_empty: bool = False,
        invalid: str = "error",
    ):
        super().__init__()
        self.input_column = input_column
        self.output_column = output_column
        self.drop_empty = drop_empty
        self.invalid = check_invalid(invalid)

    def _transform(self, df: DataFrame) -> DataFrame:
        text = F.col(self.input_column)
        if self.invalid == "skip":
            df = df.filter(text.isNotNull())
        elif self.invalid == "error":
            message = f"column {self.input_column} holds a null; use invalid='skip' or 'keep'"
            refused = F.raise_error(F.lit(message)).cast("string")
            text = F.when(text.isNull(), refused).otherwise(text)
        # The body is used more than once: as a column of its own it is computed once.
        (body,) = unused([*df.columns, self.output_column], "_body")
        staged = df.withColumn(body, token_body(text))
        split = split_body(F.col(self.input_column), F.col(body))
        if self.drop_empty:
            split = F.array_remove(split, "")
        return staged.withColumn(self.output_column, split).drop(body)


def _without_nulls(df: DataFrame, tokens_column: str) -> Column:
    """The tokens that are terms; arrays that can't hold a null are taken as they are."""
    kind = df.schema[tokens_column].dataType
    return F.array_compact(tokens_column) if kind.containsNull else F.col(tokens_column)


def term_statistics(
    df: DataFrame, tokens_column: str = "tokens", min_df: int = 1, by: Sequence[str] = ()
) -> DataFrame:
    """``(by..., term, tf, df)``: total count and number of documents per term, over all documents.

    Each document adds a row per token and one more per distinct term, all counted by one aggregation, whose
    shuffle carries partial sums by term. A null token is no term.
    """
    at, n, held = unused([*by, "term"], "at", "n", "held")
    tokens = df.select(*by, _without_nulls(df, tokens_column).alias(held))
    both = F.posexplode(F.concat(held, F.array_distinct(held))).alias(at, "term")
    rows = tokens.select(*by, F.size(held).alias(n), both)
    counted = rows.groupBy(*by, "term").agg(
        F.count_if(F.col(at) < F.col(n)).alias("tf"), F.count_if(F.col(at) >= F.col(n)).alias("df")
    )
    return counted.filter(F.col("df") >= min_df) if min_df > 1 else counted


def frequent_terms(
    df: DataFrame, vocab_size: int, tokens_column: str = "tokens", min_df: int = 1, buckets: int = BUCKETS
) -> DataFrame:
    """``(term, tf, df)`` of every term that can be among the ``vocab_size`` most frequent, and few others.

    Tokens are first counted by a hash of the term into so many buckets. A bucket's total bounds the count of each of its
    terms, so the terms of the fullest buckets, counted exactly, give a count that the sought ones reach, and only
    buckets with as large a total are counted further. The result is exact for any hash, ties included; a shuffle carries
    a count per bucket, and terms of the buckets looked into. It pays where few of very many terms are sought.
    """
    held, bucket, total = "held", "bucket", "total"
    tokens = df.select(_without_nulls(df, tokens_column).alias(held))

    def place(term: str) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(buckets)).alias(bucket)

    single = tokens.select(F.explode(held).alias("term")).select(place("term"))
    totals = cut(single.groupBy(bucket).agg(F.count(F.lit(1)).alias(total)), "buckets")
    both = F.posexplode(F.concat(held, F.array_distinct(held))).alias("at", "term")
    rows = tokens.select(F.size(held).alias("n"), both).select("n", "at", "term", place("term"))

    def counted(chosen: DataFrame) -> DataFrame:
        # At most one row per bucket.
        inside = rows.join(F.broadcast(chosen.select(bucket)), bucket, "left_semi")
        sums = inside.groupBy("term").agg(
            F.count_if(F.col("at") < F.col("n")).alias("tf"), F.count_if(F.col("at") >= F.col("n")).alias("df")
        )
        return cut(sums.filter(F.col("df") >= min_df), "terms")

    fullest = totals.orderBy(F.desc(total)).limit(2 * vocab_size).agg(F.min(total)).first()[0] or 0
    found = counted(totals.filter(F.col(total) >= fullest))
    top = found.orderBy(F.desc("tf")).limit(vocab_size).agg(F.count(F.lit(1)), F.min("tf")).first()
    reached = top[1] if top[0] == vocab_size else 0
    rest = totals.filter((F.col(total) < fullest) & (F.col(total) >= reached))
    return found if rest.isEmpty() else found.unionByName(counted(rest))


def document_terms(df: DataFrame, id_columns: Sequence[str], tokens_column: str) -> DataFrame:
    """``(id..., term, cnt)``: one row per distinct term of each document, without a shuffle.

    Null tokens are left out.
    """
    ids = list(id_columns)
    present = F.sort_array(_without_nulls(df, tokens_column))
    ordered = df.select(*ids, present.alias("_ordered"))
    started = ordered.select(*ids, "_ordered", run_starts(F.col("_ordered")).alias("_starts"))
    terms = started.select(
        *ids, F.explode(run_lengths(F.col("_ordered"), F.col("_starts"))).alias("_t")
    )
    return terms.select(*ids, "_t.term", "_t.cnt")


def top_terms(
    statistics: DataFrame,
    vocab_size: int,
    size: Size,
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> DataFrame:
    """``(term, tf, df, term_index)`` of the ``vocab_size`` most frequent terms.

    The order is total: ``tf`` descending, then ``term``. ``statistics`` should be a written table,
    as it may be read several times, and ``size`` its measured size. Of many terms, a histogram over
    powers of two (at most 64 rows) shows which can reach the cut, and only those are ranked.
    """
    order = [F.desc("tf"), F.asc("term")]
    if size.rows <= single_task_rows:
        return rank_rows(statistics, order, "term_index", size, vocab_size, single_task_rows)
    magnitude = F.length(F.bin("tf"))
    classes = (
        statistics.groupBy(magnitude.alias("magnitude"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("magnitude"))
        .collect()
    )
    reached, smallest = 0, 1
    for row in classes:
        reached += row["n"]
        smallest = 2 ** (row["magnitude"] - 1)
        if reached >= vocab_size:
            break
    return rank_rows(
        statistics.filter(F.col("tf") >= smallest),
        order,
        "term_index",
        Size(reached, size.bytes),
        vocab_size,
        single_task_rows,
    )


class CountVectorizer(FitStep):
    """Term counts over the ``vocab_size`` most frequent terms found in ``min_df`` documents.

    Several token columns share one vocabulary, as if a row held the tokens of all of them, and each
    gets an output column of its own. ``method`` is ``count``, which counts all terms at once, or ``buckets``, which
    gives the same vocabulary and looks only into those that can be in it (see ``frequent_terms``).
    """

    def __init__(
        self,
        input_column: str | Sequence[str] = "tokens",
        output_column: str | Sequence[str] = "features",
        vocab_size: int = 1 << 18,
        min_df: int = 1,
        method: str = "count",
    ):
        super().__init__()
        if vocab_size < 1 or min_df < 1:
            raise ValueError("vocab_size and min_df must be at least 1")
        if method not in ("count", "buckets"):
            raise ValueError("method must be 'count' or 'buckets'")
        self.method = method
        self.input_columns, self.output_columns = _paired(input_column, output_column)
        self.vocab_size = vocab_size
        self.min_df = min_df

    def _fit(self, df: DataFrame) -> CountVectorizerModel:
        names = self.input_columns
        if len(names) == 1:
            tokens = df.select(F.col(names[0]).alias("_tokens"))
        else:
            tokens = df.select(F.concat(*[F.coalesce(c, no_tokens()) for c in names]).alias("_tokens"))
        if self.method == "buckets":
            terms = frequent_terms(tokens, self.vocab_size, "_tokens", self.min_df)
        else:
            terms = term_statistics(tokens, "_tokens", self.min_df)
        statistics, found = cut_measured(terms, "terms")
        top = top_terms(statistics, self.vocab_size, found)
        vocabulary, size = cut_measured(top, "vocabulary")
        discard(statistics)
        return CountVectorizerModel(vocabulary, names, self.output_columns, size)


def _paired(
    inputs: str | Sequence[str], outputs: str | Sequence[str]
) -> tuple[list[str], list[str]]:
    ins = [inputs] if isinstance(inputs, str) else list(inputs)
    outs = [outputs] if isinstance(outputs, str) else list(outputs)
    if len(ins) != len(outs) or not ins:
        raise ValueError("input and output columns differ in length")
    return ins, outs


class CountVectorizerModel(FittedStep):
    """A vocabulary kept as a table ``(term, tf, df, term_index)``, and its transforms.

    ``transform`` adds ML sparse vectors and keeps all columns; ``transform_long`` gives rows of
    pairs. Both give the same result at every vocabulary size. ``transform`` never shuffles a document: its tasks
    hold the vocabulary in slices of ``local_terms`` terms and a bounded number of bytes. More slices than
    ``HELD_SLICES`` are met one after the other, with the documents written in between.
    """

    def __init__(
        self,
        vocabulary: DataFrame,
        input_column: str | Sequence[str] = "tokens",
        output_column: str | Sequence[str] = "features",
        size: Size | None = None,
        local_terms: int = LOCAL_TERMS,
        head_terms: int | None = None,
    ):
        super().__init__()
        self.vocabulary = vocabulary
        self.input_columns, self.output_columns = _paired(input_column, output_column)
        measured = measure(vocabulary) if size is None else size
        self.size = measured.rows
        self.bytes = measured.bytes
        self.local_terms = local_terms
        self.head_terms = head_terms
        self._paths: dict[tuple[int, int], str] = {}
        self._loaded: dict[tuple[int, int], SparkCountVectorizerModel] = {}

    def _restored(self) -> None:
        self._paths, self._loaded = {}, {}

    @property
    def input_column(self) -> str:
        return self.input_columns[0]

    def vocabulary_size(self, requested: int) -> DataFrame:
        """One row: terms asked for and terms kept."""
        return self.vocabulary.agg(F.count(F.lit(1)).alias("kept")).select(
            F.lit(requested).cast("long").alias("requested"), "kept"
        )

    def transform_long(
        self,
        df: DataFrame,
        id_columns: Sequence[str],
        broadcast_rows: int = BROADCAST_ROWS,
        head_terms: int | None = None,
    ) -> DataFrame:
        """``(id..., term_index, cnt)``, one row per document and vocabulary term in it.

        ``df`` is read once and not shuffled. A vocabulary within the measured broadcast bounds is joined; a larger one is
        met slice by slice, as in ``transform``. ``head_terms`` is accepted and has no effect.
        """
        ids = list(id_columns)
        if self.size <= broadcast_rows and self.bytes <= BROADCAST_BYTES:
            index = self.vocabulary.select(F.col("term").alias("_known"), "term_index")
            terms = document_terms(df, ids, self.input_column)
            return terms.join(F.broadcast(index), F.col("term") == F.col("_known")).select(*ids, "term_index", "cnt")
        (vector,) = unused(df.columns, "_vector")
        stored = F.unwrap_udt(vector)
        pairs = F.explode(F.arrays_zip(stored["indices"].alias("i"), stored["values"].alias("v")))
        counted = self._vectors(df, self.input_column, vector).select(*ids, pairs.alias("_p"))
        return counted.select(*ids, F.col("_p.i").alias("term_index"), F.col("_p.v").cast("long").alias("cnt"))

    def _transform(self, df: DataFrame) -> DataFrame:
        """Add the counts as one ML sparse vector per document and token column.

        Null tokens and a null token array count nothing. Neither ids nor unique rows are needed.
        """
        for source, target in zip(self.input_columns, self.output_columns, strict=True):
            df = self._vectors(df, source, target)
        return df

    def _vectors(self, df: DataFrame, source: str, target: str) -> DataFrame:
        """By Spark ML's vectoriser over slices of this vocabulary, counted in the row and put end to end."""
        columns = df.columns
        slices = self._slices()
        present, *parts = unused([*columns, target], "_present", *[f"_part_{i}" for i in range(len(slices))])
        out = df.withColumn(present, F.coalesce(_without_nulls(df, source), no_tokens()))
        for i, (first, last) in enumerate(slices):
            if i and i % HELD_SLICES == 0:
                out = cut(out, "vectors")
            out = self._vectorizer(first, last).setInputCol(present).setOutputCol(parts[i]).transform(out)
        kept = [F.col(c) for c in columns if c != target]
        if len(slices) == 1:
            return out.select(*kept, F.col(parts[0]).alias(target))
        whole, *_ = unused([*out.columns, target], "_whole")
        joined = VectorAssembler(inputCols=parts, outputCol=whole).transform(out)
        return joined.select(*kept, _sparse(whole, self.size).alias(target))

    def _slices(self) -> list[tuple[int, int]]:
        """First and last index (exclusive) of runs of terms within the bounds, one at least."""
        within = int(self.size * BROADCAST_BYTES / max(self.bytes, 1))
        terms = max(LEAST_TERMS, min(self.local_terms, within))
        return [(a, min(a + terms, self.size)) for a in range(0, self.size, terms)] or [(0, 0)]

    def _vectorizer(self, first: int, last: int) -> SparkCountVectorizerModel:
        """Spark ML's vectoriser over a slice of the terms, which it reads from a stored model."""
        inside = self.vocabulary.filter((F.col("term_index") >= first) & (F.col("term_index") < last))
        if last - first <= FEW_TERMS:
            # Without any term Spark refuses a model: one that no text holds stands in.
            terms = [r["term"] for r in inside.orderBy("term_index").collect()] or ["\0"]
            return SparkCountVectorizerModel.from_vocabulary(terms, inputCol="tokens")
        if (first, last) not in self._paths:
            spark = self.vocabulary.sparkSession
            row = F.array_sort(F.collect_list(F.struct("term_index", "term")))
            terms = inside.agg(row["term"].alias("vocabulary"))
            path = scratch_path(spark, "vectorizer")
            SparkCountVectorizerModel.from_vocabulary(["\0"], inputCol="tokens").write().save(f"{path}/made")
            spark.read.text(f"{path}/made/metadata").coalesce(1).write.text(f"{path}/metadata")
            terms.coalesce(1).write.parquet(f"{path}/data")
            self._paths[first, last] = path
        if (first, last) in self._loaded:
            return self._loaded[first, last].copy()
        model = SparkCountVectorizerModel.load(self._paths[first, last])
        if self.size <= HELD_SLICES * (last - first):
            self._loaded[first, last] = model
        return model.copy()


def _sparse(column: str, size: int) -> Column:
    """A vector column, its dense vectors (those with few zeros) as sparse ones."""
    values = F.unwrap_udt(column)["values"]
    held = F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.get(values, i) != 0)
    fields = F.struct(
        F.lit(0).alias("type"),
        F.lit(size).alias("size"),
        held.alias("indices"),
        F.transform(held, lambda i: F.get(values, i)).alias("values"),
    )
    # Spark's JSON reader builds the vector type from its stored fields inside the JVM.
    made = F.from_json(F.to_json(F.struct(fields.alias("v"))), StructType([StructField("v", VectorUDT())]))["v"]
    return F.when(F.unwrap_udt(column)["type"] == 1, made).otherwise(F.col(column))
