from __future__ import annotations

import base64

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from test_pii import base
from test_simhash import fingerprint, roots
from pyspark.sql import functions as F

import corpus_pipeline
from quernstone.llm import mixing, pii, quality
from quernstone.support.cut import cut


def test_stages_and_result(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == columns
        kept.append(docs.count())
    assert kept[0] > kept[1] >= kept[2] == kept[3]
    mixed = docs.collect()
    with open(public_tokenizers.path(corpus_pipeline.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((d.doc_id, library.encode_ordinary(d.text or "")) for d in mixed)
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want


def test_mixed_copies(spark, edges):
    rows = mixing.repeat_by_mix(edges)
    assert rows.columns == edges.columns


def test_edges(spark, sf_dir, edges):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, edges, sf_dir).count() <= 2 * edges.count()
        assert stage(spark, edges.limit(0), sf_dir).count() == 0


def masked(text):
    """Spans one by one, from the left, overlapping ones as one of the kind of the first and longest."""
    spans = sorted(((a, -b, b, k) for k, a, b in base(text or "")))
    out, at = "", 0
    for start, _, end, kind in spans:
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return None if text is None else out + text[at:]


def test_each_stage_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def rows(df):
        return sorted(map(tuple, df.collect()))

    # Quality: what the model, asked one text at a time, gives the threshold or more.
    before = docs.collect()
    model = quality.fit(docs, labels)
    kept = [d for d in before if model.scores(pa.array([d.text], pa.string()))[0] >= quality.THRESHOLD]
    first = cut(stages["quality classifier"](spark, docs, sf_dir), "stage")
    assert rows(first) == sorted(map(tuple, kept))
    # Near copies: the least id of each component of fingerprints within three bits.
    prints = {d.doc_id: fingerprint(d.text) for d in kept}
    root, least = roots(list(prints.values())), {}
    for i, p in prints.items():
        least[root[p]] = min(i, least.get(root[p], i))
    kept = [d for d in kept if least[root[prints[d.doc_id]]] == d.doc_id]
    second = cut(stages["SimHash near-dedup"](spark, first, sf_dir), "stage")
    assert rows(second) == sorted(map(tuple, kept))
    # Personal data: every base span is masked; where the further kinds find nothing the text is that of plain Python.
    third = cut(stages["PII"](spark, second, sf_dir), "stage")
    more = {r.doc_id for r in pii.find(second).filter("exists(spans, x -> x.kind in ('iban', 'ssn'))").collect()}
    got = {r.doc_id: r for r in third.collect()}
    assert len(got) == len(kept)
    for d in kept:
        assert tuple(got[d.doc_id])[2:] == tuple(d)[2:]
        assert got[d.doc_id].text == masked(d.text) or d.doc_id in more
    # The mix: as often as each row's copies say, whole rows unchanged.
    fourth = cut(stages["mixing sources to target weights"](spark, third, sf_dir), "stage")
    copies = {r.doc_id: r.copies for r in mixing.mix(third).collect()}
    assert rows(fourth) == sorted(tuple(r) for i, r in got.items() for _ in range(copies[i]))
    assert sum(copies.values()) > 0


def test_columns_named_like_intermediate_ones(spark, sf_dir, edges):
    names = ["_id", "_key", "_led", "_again", "_source", "_copies", "_rows", "_time", "_each", "_spans", "_reach", "score", "c0", "label"]
    docs = edges.select("*", *[F.lit(f"kept {n}").alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        assert found.columns == docs.columns
        assert {tuple(r) for r in found.select(*names).distinct().collect()} <= {tuple(f"kept {n}" for n in names)}
    assert corpus_pipeline.encode(spark, docs, sf_dir).count() == docs.count()
