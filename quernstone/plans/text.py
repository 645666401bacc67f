"""Tokens, vocabulary and count vectors of documents."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from quernstone.operators.rates import term_statistics_by_rate
from quernstone.operators.scaling import VectorStandardScaler
from quernstone.operators.text import (
    CountVectorizer,
    CountVectorizerModel,
    Tokenizer,
    document_terms,
    term_statistics,
    top_terms,
)
from quernstone.plans.registry import Plans, table
from quernstone.sources.tables import spread_rows
from quernstone.support.cut import cut_measured, scratch_path

PLANS = Plans()

VOCAB_SIZE = 1000
LARGE_VOCAB_SIZE = 200_000
MIN_DF = 2

_TOKENS = r"""
    bodies AS (
        SELECT doc_id, text, regexp_replace(lower(text), '[ \t\n\x0B\f\r]+$', '') AS body
        FROM documents
    ),
    split AS (
        SELECT doc_id, CASE WHEN body = '' AND text <> '' THEN []::VARCHAR[]
                            ELSE string_split_regex(body, '[ \t\n\x0B\f\r]') END AS tokens
        FROM bodies
    ),
    words AS (SELECT doc_id, unnest(tokens) AS term FROM split)
"""
_TERMS = """
    terms AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM words GROUP BY term)
"""


def _vocabulary(size: int, min_df: int) -> str:
    return f"""
    vocabulary AS (
        SELECT term, tf, df,
               CAST(row_number() OVER (ORDER BY tf DESC, term) - 1 AS INTEGER) AS term_index
        FROM terms WHERE df >= {min_df} ORDER BY tf DESC, term LIMIT {size}
    )
    """


_VOCABULARY = f"WITH {_TOKENS}, {_TERMS}, {_vocabulary(VOCAB_SIZE, MIN_DF)}"
_LONG = f"""
    {_VOCABULARY}
    SELECT doc_id, term_index, count(*) AS cnt
    FROM words JOIN vocabulary USING (term) GROUP BY doc_id, term_index
"""


def _documents(spark, sf_dir, *more):
    """Texts are dealt out before they are tokenised, where a few tasks would read most of them."""
    return spread_rows(table(spark, sf_dir, "documents").select("doc_id", "text", *more), ["doc_id"])


def _tokens(spark, sf_dir, **options):
    return Tokenizer(**options).transform(_documents(spark, sf_dir))


def _model(spark, sf_dir):
    return CountVectorizer(vocab_size=VOCAB_SIZE, min_df=MIN_DF).fit(_tokens(spark, sf_dir))


@PLANS.add(
    f"""
    WITH {_TOKENS}
    SELECT doc_id, len(tokens) AS n_tokens, md5(array_to_string(tokens, '|')) AS tokens_md5
    FROM split
    """
)
def tokenize_documents(spark, sf_dir):
    """Token count and a digest of the whole token list of each document."""
    return _tokens(spark, sf_dir).select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.md5(F.array_join("tokens", "|")).alias("tokens_md5"),
    )


@PLANS.add(
    f"""
    WITH {_TOKENS}
    SELECT doc_id, len(list_filter(tokens, lambda t: t <> '')) AS n_tokens FROM split
    """
)
def tokenize_drop_empty(spark, sf_dir):
    return _tokens(spark, sf_dir, drop_empty=True).select(
        "doc_id", F.size("tokens").cast("long").alias("n_tokens")
    )


@PLANS.add(f"WITH {_TOKENS}, {_TERMS} SELECT term, tf, df FROM terms")
def token_count_statistics(spark, sf_dir):
    return term_statistics(_tokens(spark, sf_dir))


@PLANS.add(f"WITH {_TOKENS}, {_TERMS} SELECT term, tf, df FROM terms WHERE df >= {MIN_DF}")
def minimum_document_frequency(spark, sf_dir):
    return term_statistics(_tokens(spark, sf_dir), min_df=MIN_DF)


@PLANS.add(f"{_VOCABULARY} SELECT term, tf, df, term_index FROM vocabulary")
def vocabulary_topk(spark, sf_dir):
    return _model(spark, sf_dir).vocabulary


@PLANS.add(f"{_VOCABULARY} SELECT term, tf, df, term_index FROM vocabulary")
def vocabulary_by_buckets(spark, sf_dir):
    """The same, of terms in buckets full enough to hold one of them."""
    step = CountVectorizer(vocab_size=VOCAB_SIZE, min_df=MIN_DF, method="buckets")
    return step.fit(_tokens(spark, sf_dir)).vocabulary


@PLANS.add(f"{_VOCABULARY} SELECT term, tf, df, term_index FROM vocabulary")
def vocabulary_topk_ranged(spark, sf_dir):
    """The same by range partitions, as for more terms than one task should order."""
    counted = term_statistics(_tokens(spark, sf_dir), min_df=MIN_DF)
    statistics, found = cut_measured(counted, "terms")
    return top_terms(statistics, VOCAB_SIZE, found, single_task_rows=0)


@PLANS.add(
    f"""
    WITH {_TOKENS}, {_TERMS}, {_vocabulary(LARGE_VOCAB_SIZE, 1)}
    SELECT term, tf, df, term_index FROM vocabulary
    """
)
def vocabulary_large(spark, sf_dir):
    return CountVectorizer(vocab_size=LARGE_VOCAB_SIZE).fit(_tokens(spark, sf_dir)).vocabulary


@PLANS.add(
    f"""
    WITH {_TOKENS}, {_TERMS}, {_vocabulary(LARGE_VOCAB_SIZE, MIN_DF)}
    SELECT CAST({LARGE_VOCAB_SIZE} AS BIGINT) AS requested, count(*) AS kept FROM vocabulary
    """
)
def vocabulary_size(spark, sf_dir):
    """Terms asked for and terms found."""
    step = CountVectorizer(vocab_size=LARGE_VOCAB_SIZE, min_df=MIN_DF)
    return step.fit(_tokens(spark, sf_dir)).vocabulary_size(LARGE_VOCAB_SIZE)


@PLANS.add(_LONG)
def count_vector_long(spark, sf_dir):
    return _model(spark, sf_dir).transform_long(_tokens(spark, sf_dir), ["doc_id"])


@PLANS.add(_LONG)
def count_vector_long_split(spark, sf_dir):
    """The same with the vocabulary too large to broadcast at once."""
    return _model(spark, sf_dir).transform_long(
        _tokens(spark, sf_dir), ["doc_id"], broadcast_rows=100, head_terms=100
    )


@PLANS.add(
    f"""
    WITH {_TOKENS}, {_TERMS}, {_vocabulary(LARGE_VOCAB_SIZE, MIN_DF)}
    SELECT doc_id, term_index, count(*) AS cnt
    FROM words JOIN vocabulary USING (term) GROUP BY doc_id, term_index
    """
)
def count_vector_long_large(spark, sf_dir):
    tokens = _tokens(spark, sf_dir)
    model = CountVectorizer(vocab_size=LARGE_VOCAB_SIZE, min_df=MIN_DF).fit(tokens)
    return model.transform_long(tokens, ["doc_id"])


def _unpacked(vectors):
    stored = F.unwrap_udt("features")
    pairs = F.explode(F.arrays_zip(stored["indices"].alias("i"), stored["values"].alias("v")))
    return vectors.select("doc_id", pairs.alias("p")).select(
        "doc_id", F.col("p.i").alias("term_index"), F.col("p.v").cast("long").alias("cnt")
    )


@PLANS.add(_LONG)
def count_vector_sparse(spark, sf_dir):
    """ML sparse vectors of tokenised text, by a Spark ML pipeline, read back as pairs."""
    rows = _documents(spark, sf_dir)
    steps = Pipeline(stages=[Tokenizer(), CountVectorizer(vocab_size=VOCAB_SIZE, min_df=MIN_DF)])
    return _unpacked(steps.fit(rows).transform(rows))


@PLANS.add(_LONG)
def count_vector_sparse_any_size(spark, sf_dir):
    """ML sparse vectors by slices of the vocabulary, as for one of any size."""
    return _unpacked(_joined(_model(spark, sf_dir)).transform(_tokens(spark, sf_dir)))


def _joined(model):
    """The same vocabulary, too large to be held at once."""
    return CountVectorizerModel(
        model.vocabulary, model.input_columns, model.output_columns, local_terms=100, head_terms=50
    )


def _repeated_ids(rows):
    """Documents of which some lack an id, some share one, and some have no token."""
    number = F.col("doc_id")
    key = F.when(number % 5 != 0, F.floor(number / 3))
    tokens = F.when(number % 17 != 0, F.col("tokens"))
    return rows.select(number.alias("doc_no"), key.alias("doc_key"), tokens.alias("tokens"))


def _vector_digest(vectors, *columns):
    """The columns, and size, terms and sum of the counts of each vector."""
    stored = F.unwrap_udt("features")
    total = F.aggregate(stored["values"], F.lit(0.0), lambda a, b: a + b)
    return vectors.select(
        *columns,
        stored["size"].alias("size"),
        F.size(stored["indices"]).alias("n_terms"),
        total.cast("long").alias("n_tokens"),
    )


_DIGEST = f"""
    {_VOCABULARY}, found AS (
        SELECT doc_id, CAST(count(DISTINCT term_index) AS INTEGER) AS n_terms, count(*) AS n_tokens
        FROM words JOIN vocabulary USING (term) WHERE doc_id % 17 <> 0 GROUP BY doc_id
    )
    SELECT doc_id AS doc_no, CASE WHEN doc_id % 5 <> 0 THEN doc_id // 3 END AS doc_key,
           CAST((SELECT count(*) FROM vocabulary) AS INTEGER) AS size,
           coalesce(n_terms, 0) AS n_terms, coalesce(n_tokens, 0) AS n_tokens
    FROM documents LEFT JOIN found USING (doc_id)
"""


@PLANS.add(_DIGEST)
def count_vector_sparse_ids(spark, sf_dir):
    """Every document gets its vector, whatever its id: null, repeated, or without a known term."""
    rows = _repeated_ids(_tokens(spark, sf_dir))
    return _vector_digest(_model(spark, sf_dir).transform(rows), "doc_no", "doc_key")


@PLANS.add(_DIGEST)
def count_vector_sparse_ids_joined(spark, sf_dir):
    rows = _repeated_ids(_tokens(spark, sf_dir))
    return _vector_digest(_joined(_model(spark, sf_dir)).transform(rows), "doc_no", "doc_key")


_NULLED = f"""
    WITH {_TOKENS},
    marked AS (SELECT doc_id, term FROM words WHERE term NOT LIKE 't%')
"""


def _nulled_tokens(spark, sf_dir):
    """Tokens of which those with a leading t are null."""
    kept = F.transform("tokens", lambda t: F.when(~t.startswith("t"), t))
    return _tokens(spark, sf_dir).select("doc_id", kept.alias("tokens"))


@PLANS.add(
    f"{_NULLED} SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM marked GROUP BY term"
)
def token_statistics_with_nulls(spark, sf_dir):
    """Null tokens are no terms and change no other count."""
    return term_statistics(_nulled_tokens(spark, sf_dir))


@PLANS.add(f"{_NULLED} SELECT doc_id, term, count(*) AS cnt FROM marked GROUP BY doc_id, term")
def document_terms_with_nulls(spark, sf_dir):
    return document_terms(_nulled_tokens(spark, sf_dir), ["doc_id"], "tokens")


@PLANS.add(
    f"""
    WITH {_TOKENS},
    both_columns AS (
        SELECT doc_id, 0 AS part, term FROM words
        UNION ALL SELECT doc_id, 1, source FROM documents WHERE source IS NOT NULL
        UNION ALL SELECT doc_id, 1, lang FROM documents WHERE lang IS NOT NULL
    ),
    terms AS (
        SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM both_columns GROUP BY term
    ),
    {_vocabulary(VOCAB_SIZE, MIN_DF)},
    counted AS (
        SELECT doc_id, count(*) FILTER (part = 0) AS n_words, count(*) FILTER (part = 1) AS n_tags
        FROM both_columns JOIN vocabulary USING (term) GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_tags, 0) AS n_tags
    FROM documents LEFT JOIN counted USING (doc_id)
    """
)
def count_vector_two_columns(spark, sf_dir):
    """Two token columns, one vocabulary, a vector for each."""
    rows = _documents(spark, sf_dir, "source", "lang")
    tokens = Tokenizer().transform(rows).select("doc_id", "tokens", F.array("source", "lang").alias("tags"))
    step = CountVectorizer(["tokens", "tags"], ["features", "tag_features"], VOCAB_SIZE, MIN_DF)
    vectors = step.fit_transform(tokens)

    def total(column):
        values = F.unwrap_udt(column)["values"]
        return F.aggregate(values, F.lit(0.0), lambda a, b: a + b).cast("long")

    return vectors.select("doc_id", total("features").alias("n_words"), total("tag_features").alias("n_tags"))


@PLANS.add(
    f"""
    {_VOCABULARY},
    quoted AS (
        SELECT item_id, unnest(string_split_regex(
                   regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+$', ''),
                   '[ \\t\\n\\x0B\\f\\r]')) AS term
        FROM benchmark
    )
    SELECT item_id, term_index, count(*) AS cnt
    FROM quoted JOIN vocabulary USING (term) GROUP BY item_id, term_index
    """
)
def count_vector_other_table(spark, sf_dir):
    """A vocabulary fitted on documents, applied to another table."""
    fitted = _model(spark, sf_dir)
    model = CountVectorizerModel(fitted.vocabulary)
    items = Tokenizer().transform(table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return model.transform_long(items, ["item_id"])


@PLANS.add(
    f"""
    {_VOCABULARY}, pairs AS (
        SELECT doc_id, term_index, count(*)::DOUBLE AS cnt
        FROM words JOIN vocabulary USING (term) GROUP BY doc_id, term_index
    ),
    spread AS (
        SELECT term_index,
               sqrt((sum(cnt * cnt) - sum(cnt) * sum(cnt) / n) / (n - 1)) AS std
        FROM pairs, (SELECT count(*)::DOUBLE AS n FROM documents) GROUP BY term_index, n
    ),
    scaled AS (
        SELECT doc_id, sum(cnt / std) AS total FROM pairs JOIN spread USING (term_index)
        WHERE std > 0 GROUP BY doc_id
    )
    SELECT doc_id, round(coalesce(total, 0), 4) AS total FROM documents LEFT JOIN scaled USING (doc_id)
    """
)
def scaled_count_vectors(spark, sf_dir):
    """Count vectors scaled by their deviation, without becoming dense."""
    counts = _model(spark, sf_dir).transform(_tokens(spark, sf_dir)).select("doc_id", "features")
    scaled = VectorStandardScaler(with_mean=False).fit_transform(counts)
    values = F.unwrap_udt("scaled_features")["values"]
    total = F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    return scaled.select("doc_id", F.round(total, 4).alias("total"))


@PLANS.add(_LONG)
def stored_model_transform(spark, sf_dir):
    """A pipeline of tokeniser and vectoriser written with its vocabulary, loaded and applied."""
    rows = _documents(spark, sf_dir)
    steps = Pipeline(stages=[Tokenizer(), CountVectorizer(vocab_size=VOCAB_SIZE, min_df=MIN_DF)])
    path = scratch_path(spark, "pipeline")
    steps.fit(rows).write().save(path)
    return _unpacked(PipelineModel.load(path).transform(rows))


@PLANS.add(
    f"""
    WITH {_TOKENS},
    rated AS (
        SELECT rate, term, doc_id FROM words, (SELECT unnest([5, 25, 65, 95]) AS rate)
        WHERE doc_id % 100 + 1 <= rate
    )
    SELECT CAST(rate AS INTEGER) AS rate, term, count(*) AS tf, count(DISTINCT doc_id) AS df
    FROM rated GROUP BY rate, term
    """
)
def term_statistics_of_rates(spark, sf_dir):
    """Term counts of four nested samples from one scan."""
    tokens = _tokens(spark, sf_dir).withColumn("first_rate", F.col("doc_id") % 100 + 1)
    return term_statistics_by_rate(tokens, [65, 5, 25, 95])
