from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quernstone.llm import bpe
from quernstone.llm.queries import PLANS

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH, public_tokenizers.PATTERN)


def test_documents_against_the_library(spark, sf_dir, library):
    want = set()
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode_ordinary(d.text or "")
        packed = np.array(ids, "<u4").tobytes()
        plain = (d.text or "").encode()
        want.add((d.doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(plain).hexdigest()))
    assert {tuple(r) for r in PLANS["op4_byte_bpe"].query(spark, sf_dir).collect()} == want


def test_any_text_against_the_library(encoder, library):
    draw = random.Random(5)
    signs = lambda: draw.choice([draw.randrange(32, 127), draw.randrange(0xA0, 0x2000), draw.randrange(0x4E00, 0x9000), 10, 32, 32])
    texts = ["".join(chr(signs()) for _ in range(draw.randrange(120))) for _ in range(300)]
    texts += ["", " ", "  a", "a  b ", "\n\n x\t", "it's we'LL", "ab" * 400, "x" * 3000, "é" * 100, "q" * 64 + "z", "\x1c\x85 a", "a <|endoftext|> b"]
    texts += ["".join(draw.choice("abcdefghij") for _ in range(n)) for n in (1, 2, 3, 31, 32, 33, 63, 64, 65, 1500)]
    got = encoder.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode_ordinary(t) for t in texts]
    assert [encoder.ranks.decode(np.frombuffer(g, "<u4")) for g in got] == [t.encode() for t in texts]


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    small = bpe.Encoder(PATH, public_tokenizers.PATTERN)
    for _ in range(2):
        for text in ("some words, and other words", "and other  words again"):
            assert np.frombuffer(small.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_edges(edges, clashing):
    rows = bpe.digests(bpe.encode(clashing, PATH, public_tokenizers.PATTERN)).collect()
    assert len(rows) == edges.count()
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {0}
    assert bpe.encode(edges.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
