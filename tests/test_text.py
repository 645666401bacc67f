"""Tokens, vocabulary and count vectors against Spark ML and against counting by hand."""

from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml import feature as ml
from pyspark.sql import functions as F

import quernstone as q
from quernstone.plans import all_plans
from quernstone.sources.tables import SPREAD_ROWS
from quernstone.support.cut import Size, measure
from quernstone.support.plan_text import plan_text

WHITE_SPACE = " \t\n\x0b\f\r"
EDGES = ["", " ", "a ", "a  b", " a", "\x0bA\x0bb\x0b", "x y z", "\r\n", "Straße  ÉTÉ\t", "a\n"]


def split_by_hand(text: str) -> list[str]:
    parts, word = [], ""
    for ch in text.lower():
        if ch in WHITE_SPACE:
            parts.append(word)
            word = ""
        else:
            word += ch
    parts.append(word)
    if parts == [""]:
        return parts
    while parts and parts[-1] == "":
        parts.pop()
    return parts


def as_table(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_edge_texts_equal_spark_ml(spark):
    rows = as_table(spark, EDGES)
    peer = ml.Tokenizer(inputCol="text", outputCol="peer").transform(rows)
    both = q.Tokenizer().transform(peer).orderBy("doc_id").collect()
    for row in both:
        assert row["tokens"] == row["peer"] == split_by_hand(row["text"]), repr(row["text"])


def test_documents_equal_spark_ml(load):
    peer = ml.Tokenizer(inputCol="text", outputCol="peer").transform(load("documents"))
    both = q.Tokenizer().transform(peer)
    assert both.filter(~F.col("tokens").eqNullSafe(F.col("peer"))).count() == 0


@settings(
    max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.text(alphabet="ab" + WHITE_SPACE, max_size=12), min_size=1, max_size=20))
def test_any_text(spark, texts):
    found = q.Tokenizer().transform(as_table(spark, texts)).orderBy("doc_id").collect()
    assert [r["tokens"] for r in found] == [split_by_hand(t) for t in texts]


def test_null_text(spark):
    rows = spark.createDataFrame([("a b",), (None,)], "text string")
    with pytest.raises(Exception, match="holds a null"):
        q.Tokenizer().transform(rows).collect()
    assert q.Tokenizer(invalid="skip").transform(rows).count() == 1
    kept = q.Tokenizer(invalid="keep").transform(rows).collect()
    assert [r["tokens"] for r in kept] == [["a", "b"], None]
    statistics = q.term_statistics(q.Tokenizer(invalid="keep").transform(rows))
    assert sorted(r["term"] for r in statistics.collect()) == ["a", "b"]


def test_statistics_by_hand(spark):
    documents = [["b", "a", "b"], ["b"], [], ["c", "", "", "a"]]
    rows = spark.createDataFrame([(t,) for t in documents], "tokens array<string>")
    tf, df = Counter(), Counter()
    for tokens in documents:
        tf.update(tokens)
        df.update(set(tokens))
    found = {r["term"]: (r["tf"], r["df"]) for r in q.term_statistics(rows).collect()}
    assert found == {t: (tf[t], df[t]) for t in tf}
    frequent = {r["term"] for r in q.term_statistics(rows, min_df=2).collect()}
    assert frequent == {"a", "b"}


def test_ties_follow_the_term(spark):
    rows = spark.createDataFrame(
        [(["d", "c", "b", "a"],), (["a", "b", "c", "d"],), (["z"] * 5,)], "tokens array<string>"
    )
    model = q.CountVectorizer(vocab_size=3, min_df=2).fit(rows.repartition(3))
    found = [tuple(r) for r in model.vocabulary.orderBy("term_index").collect()]
    assert found == [("a", 2, 2, 0), ("b", 2, 2, 1), ("c", 2, 2, 2)]
    assert q.CountVectorizer(vocab_size=1).fit(rows).vocabulary.first()["term"] == "z"


@pytest.mark.parametrize("vocab_size", [1, 37, 500, 10**6])
def test_ranges_and_single_task_agree(spark, load, vocab_size):
    tokens = q.Tokenizer().transform(load("documents"))
    statistics = q.term_statistics(tokens).persist()
    size = measure(statistics)
    ranged = q.top_terms(statistics, vocab_size, size, single_task_rows=0)
    heavy = q.top_terms(statistics, vocab_size, Size(size.rows, 1 << 40))
    single = q.top_terms(statistics, vocab_size, size)
    assert sorted(map(tuple, ranged.collect())) == sorted(map(tuple, single.collect()))
    assert sorted(map(tuple, heavy.collect())) == sorted(map(tuple, single.collect()))
    assert single.count() == min(vocab_size, size.rows)
    statistics.unpersist()


def test_vocabulary_contains_spark_mls_terms_above_the_tie(load):
    tokens = q.Tokenizer().transform(load("documents")).persist()
    peer = ml.CountVectorizer(inputCol="tokens", outputCol="f", vocabSize=300, minDF=2).fit(tokens)
    rows = q.CountVectorizer(vocab_size=300, min_df=2).fit(tokens).vocabulary.collect()
    at_cut = min(r["tf"] for r in rows)
    above = {r["term"] for r in rows if r["tf"] > at_cut}
    assert above <= set(peer.vocabulary)
    assert len(rows) == len(peer.vocabulary)
    tokens.unpersist()


def pairs_by_hand(rows, vocabulary):
    found = set()
    for row in rows:
        for term, cnt in Counter(row["tokens"]).items():
            if term in vocabulary:
                found.add((row["doc_id"], vocabulary[term], cnt))
    return found


def test_all_transforms_by_hand(spark, load):
    odd = [(-1, ""), (-2, "  "), (-3, "unseenterm")]
    rows = load("documents").select("doc_id", "text")
    rows = rows.union(spark.createDataFrame(odd, "doc_id long, text string"))
    tokens = q.Tokenizer().transform(rows).persist()
    fitted_on = tokens.filter("doc_id >= 0")
    model = q.CountVectorizer(vocab_size=400, min_df=2).fit(fitted_on)
    vocabulary = {r["term"]: r["term_index"] for r in model.vocabulary.collect()}
    by_hand = pairs_by_hand(tokens.collect(), vocabulary)

    def long(**bounds):
        return [tuple(r) for r in model.transform_long(tokens, ["doc_id"], **bounds).collect()]

    for bounds in ({}, {"broadcast_rows": 50}, {"broadcast_rows": 50, "head_terms": 0}):
        found = long(**bounds)
        assert len(found) == len(set(found))
        assert set(found) == by_hand

    joined = q.CountVectorizerModel(model.vocabulary, local_terms=50, head_terms=20)
    unknown = q.CountVectorizerModel(model.vocabulary, local_terms=0, head_terms=0)
    for vectors in (m.transform(tokens) for m in (model, joined, unknown)):
        assert vectors.columns == [*tokens.columns, "features"]
        seen = set()
        collected = vectors.select("doc_id", "features").collect()
        assert len(collected) == tokens.count()
        for row in collected:
            vector = row["features"]
            assert vector.size == len(vocabulary)
            seen |= {
                (row["doc_id"], int(i), int(v))
                for i, v in zip(vector.indices, vector.values, strict=True)
            }
        assert seen == by_hand
    tokens.unpersist()


NULL_TOKENS = [
    (1, ["a", None, "a", "b"]),
    (1, ["a", None, "a", "b"]),
    (None, ["b", None]),
    (2, [None]),
    (3, []),
    (4, None),
]


def test_null_tokens_null_ids_and_repeated_ids(spark):
    rows = spark.createDataFrame(NULL_TOKENS, "doc_id long, tokens array<string>")
    terms = q.document_terms(rows, ["doc_id"], "tokens").collect()
    assert sorted((r.doc_id or 0, r.term, r.cnt) for r in terms) == [
        (0, "b", 1), (1, "a", 2), (1, "a", 2), (1, "b", 1), (1, "b", 1),
    ]
    statistics = {r.term: (r.tf, r.df) for r in q.term_statistics(rows).collect()}
    assert statistics == {"a": (4, 2), "b": (3, 3)}
    model = q.CountVectorizer().fit(rows)
    joined = q.CountVectorizerModel(model.vocabulary, local_terms=1, head_terms=1)
    for step in (model, joined):
        vectors = step.transform(rows).collect()
        found = sorted((r.doc_id or 0, r.features.toArray().tolist()) for r in vectors)
        assert found == [(0, [0, 1]), (1, [2, 1]), (1, [2, 1]), (2, [0, 0]), (3, [0, 0]), (4, [0, 0])]


def test_large_path_reads_its_input_once(spark, sf_dir):
    tokens = q.Tokenizer().transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    model = q.CountVectorizer(vocab_size=300).fit(tokens)
    joined = q.CountVectorizerModel(model.vocabulary, local_terms=10, head_terms=10)
    scans = plan_text(joined.transform(tokens)).count("documents.parquet")
    assert scans == 1
    assert plan_text(joined.transform_long(tokens, ["doc_id"], 10, 10)).count("documents.parquet") == 1


def test_several_token_columns(spark):
    rows = spark.createDataFrame([(["a", "b"], ["a"]), (None, ["c", "c"])], "x array<string>, y array<string>")
    model = q.CountVectorizer(["x", "y"], ["fx", "fy"]).fit(rows)
    assert [r.term for r in model.vocabulary.orderBy("term_index").collect()] == ["a", "c", "b"]
    got = [(r.fx.toArray().tolist(), r.fy.toArray().tolist()) for r in model.transform(rows).collect()]
    assert sorted(got) == [([0, 0, 0], [0, 2, 0]), ([1, 0, 1], [1, 0, 0])]
    with pytest.raises(ValueError):
        q.CountVectorizer(["x", "y"], "one")


def test_one_term_filling_a_third_of_the_corpus(spark):
    """A hot term and many copies of one document give whole counts."""
    hot = F.array_repeat(F.lit("hot"), 20)
    rare = F.array(F.concat(F.lit("t"), (F.col("id") % 50).cast("string")))
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, hot).otherwise(rare).alias("tokens"),
    )
    model = q.CountVectorizer(vocab_size=10).fit(rows)
    top = model.vocabulary.orderBy("term_index").first()
    assert (top["term"], top["tf"], top["df"]) == ("hot", 20_000, 1000)
    hot = model.transform_long(rows, ["doc_id"], broadcast_rows=5, head_terms=3)
    assert hot.filter("term_index = 0").agg(F.sum("cnt")).first()[0] == 20_000


def test_parameters():
    with pytest.raises(ValueError):
        q.CountVectorizer(vocab_size=0)
    with pytest.raises(ValueError):
        q.Tokenizer(invalid="drop")


def test_texts_of_one_row_group_are_counted_by_many_tasks(spark, tmp_path):
    """Count vectors of documents that one task would read, against counting by hand."""
    text = F.concat_ws(" ", F.lit("All"), F.concat(F.lit("w"), F.col("id") % 700), F.concat(F.lit("w"), F.col("id") % 30))
    rows = spark.range(SPREAD_ROWS).select(F.col("id").alias("doc_id"), text.alias("text"))
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = all_plans()["count_vector_long_split"].query(spark, str(tmp_path))
    assert found.groupBy(F.spark_partition_id()).count().count() >= 8
    tokens = [["all", f"w{i % 700}", f"w{i % 30}"] for i in range(SPREAD_ROWS)]
    total = Counter(t for ts in tokens for t in ts)
    index = {t: i for i, t in enumerate(sorted(total, key=lambda t: (-total[t], t)))}
    by_hand = sorted((d, index[t], n) for d, ts in enumerate(tokens) for t, n in Counter(ts).items())
    assert sorted(tuple(r) for r in found.collect()) == by_hand
