"""A corpus from raw documents in stages, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) with docs in the columns of ``documents`` and works on all rows
it gets. All but the last return those columns, and any others that the rows have, whatever their names.
Texts are read whole, however long, and an empty table gives an empty one. What each stage does with null and empty
texts, ties and repeated rows stands with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import bpe, mixing, pii, quality, simhash
from quernstone.llm.ship import workers_see_package
from quernstone.plans.registry import table
from quernstone.support.cut import discard, scratch_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from ``labels``, rejects go.

    A null text is judged as an empty one; rows that repeat a text stay or go together; a score at the threshold stays.
    """
    workers_see_package(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays.

    That with the least id, null ids last, then with the least hash of the text; of rows that repeat both, one. Null, empty
    and wordless texts are copies of each other.
    """
    workers_see_package(spark)
    return simhash.keep_one_per_group(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; no document goes.

    Null and empty texts stay as they are; equal texts are masked alike.
    """
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share of the mix takes it: not at all, once or twice.

    Null, empty and wordless texts are taken not at all; a null source is one of its own. Equal lengths go by a seeded hash;
    rows that repeat id, text and source divide their copies.
    """
    return mixing.repeat_by_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) and the ids, one row per document of the mix.

    Null and empty texts have no ids; repeated rows give repeated rows. Other columns go.
    """
    workers_see_package(spark)
    encoded = bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return bpe.digests(encoded, keep_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("PII", mask_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

# Trained scores, fingerprints and tokenizer ids are beyond SQL; the tests hold each stage against a
# brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, written = table(spark, sf_dir, "documents"), None
    for number, (_, stage) in enumerate(STAGES, 1):
        out = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            path = scratch_path(spark, "stage")
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
            if written is not None:
                discard(written)
            written = docs
    return out
