from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quernstone.llm import tokenfile
from quernstone.llm.queries import PLANS

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(library, rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_documents_against_the_library(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(tokenfile, "SHARD_IDS", 5000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    want = expected(Tokenizer.from_file(PATH), [(d.doc_id, d.text) for d in docs])
    assert sorted(tuple(r) for r in PLANS["op6_token_shards"].query(spark, sf_dir).collect()) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=1300), st.integers(1, 600))
def test_matrix_answers_like_a_list(values, width):
    values = [v % width for v in values]
    data = tokenfile.WaveletMatrix.build(np.array(values, np.int64)).to_bytes()
    matrix = tokenfile.WaveletMatrix.from_bytes(data)
    assert matrix.values().tolist() == values
    for at in range(0, len(values), 97):
        v = values[at]
        assert matrix.access(at) == v
        assert matrix.count(v, at) == values[:at].count(v)
        assert matrix.locate(v, values[:at].count(v)) == at
    assert matrix.count(10**6) == 0
    with pytest.raises(IndexError):
        matrix.locate(1, values.count(1))


def test_shards_refuse_other_bytes():
    data = tokenfile.write_shard([np.array([1, 2, 70_000], np.uint32), np.array([2], np.uint32)])
    lengths, matrix = tokenfile.read_shard(data)
    assert lengths.tolist() == [3, 1] and matrix.values().tolist() == [1, 2, 70_000, 2]
    with pytest.raises(ValueError):
        tokenfile.read_shard(b"XXXX" + data[4:])


def test_edges(edges, clashing):
    shards, _ = tokenfile.token_file(clashing, PATH, 2)
    rows = sorted(tokenfile.read_tokens("bigint", shards).collect(), key=lambda r: r.start)
    assert len(rows) == edges.count() and rows[0].doc_id is None
    assert [r.doc_id for r in rows[1:]] == sorted(r.doc_id for r in rows[1:])
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    none, _ = tokenfile.token_file(edges.limit(0), PATH, 2)
    assert tokenfile.read_tokens("bigint", none).count() == 0


def test_words_encode_like_whole_texts():
    library, own = Tokenizer.from_file(PATH), tokenfile.WordTokens(PATH, 2)
    texts = ["It's  a\ttest", "İSTANBUL ΣΑΣ ς", "a\x85b\xa0c\x1cd", "x<|endoftext|>y", "<|ENDOFTEXT|> A", "Word. word, WORD.. it's, a.b, é. 9. ., . x!.", "é ﬁ K", "", " \n", "漢字🎉1234"]
    got = own([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_plain_words_need_no_whole_tokenizer(monkeypatch):
    library, own = Tokenizer.from_file(PATH), tokenfile.WordTokens(PATH, 2)
    words = ["ögepf,", "Über", "ÆÞŸ", "straße!", "Привет", "ѐҁҊӿ", "ſıĸŉž", "a.b@c-d.org", "it's", "x''s", "x,'s", "'s's", "'LLama", "97", "(é)", "ö.,", "+49", "|", "<a|b>", "'"]
    others = ["İİ", "×", "a÷b", "҂", "е҃", "µm", "ª", "ΣΑΣ", "x<|endoftext|>y", "<|ENDOFTEXT|>", "é.", "漢字", "a\x7fb", "ö̈"]
    asked = []
    whole = own._library
    monkeypatch.setattr(own, "_library", lambda word: asked.append(word) or whole(word))
    for word in [*words, *others]:
        got = own([word.encode(), f" {word} {word}.".encode()])
        once, twice = library.encode(word, add_special_tokens=False).ids, library.encode(f" {word} {word}.", add_special_tokens=False).ids
        assert [g.tolist() for g in got] == [[*once, 2], [*twice, 2]], word
        assert not asked or word in others, word


def test_every_sign_of_plain_bytes_like_the_library():
    library, own = Tokenizer.from_file(PATH), tokenfile.WordTokens(PATH, 2)
    signs = [chr(c) for c in [*range(0x21, 0x7F), *range(0xC0, 0x180), *range(0x400, 0x500)]]
    texts = [f"{a} {a}{b} x{a}y{b} {b}'s{a}" for a, b in zip(signs, signs[7:] + signs[:7], strict=True)]
    got = own([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
