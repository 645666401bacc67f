from __future__ import annotations

import pytest

from quernstone.llm.ship import workers_see_package

EDGES = [
    (1, "one two three four five six", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "", 0),
    (4, "  \t\n ", "en", "a", 1),
    (None, "one two three four five six", "en", "b", 1),
    (5, "ONE two  three\nfour five six", "en", "a", 1),
    (5, "ONE two  three\nfour five six", "en", "a", 1),
    (6, "é漢 🎉 x@y.zz +1 555 123 4567", "de", None, 1),
    (7, "word " * 30_000, "en", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def package_on_workers(spark):
    workers_see_package(spark)


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and long texts, and repeated rows."""
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="session")
def clashing(edges):
    """The same with columns named like results and intermediate ones."""
    from pyspark.sql import functions as F

    names = ["fp", "size", "copies", "spans", "score", "text_key", "rank", "n", "row", "train", "label"]
    return edges.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
