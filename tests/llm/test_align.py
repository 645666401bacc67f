from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm import align
from quernstone.llm.queries import PLANS

PATHS = tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))
ZERO = (0, 0, 0, 0, 0, 0, "")


@pytest.fixture(scope="module")
def libraries():
    """The two libraries themselves, and the bytes of their tokens."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    own = align.ByteTokens(PATHS[0]).bytes
    for i in range(0, 50_256, 97):  # whole characters, as the library decodes them
        text = ByteLevel().decode([a.id_to_token(i)])
        assert "�" in text or text.encode() == own[i]

    def piece(i):
        name = b.id_to_piece(i)
        return bytes.fromhex(name[3:5]) if b.is_byte(i) else name.replace("▁", " ").encode()

    return (lambda t: a.encode(" " + t, add_special_tokens=False).ids, own.__getitem__), (b.encode, piece)


def tokens(text, library):
    encode, token_bytes = library
    ids, end, out = encode(text), 0, []
    for i in ids:
        out.append((i, end, end + len(token_bytes(i))))
        end = out[-1][2]
    return out, b"".join(map(token_bytes, ids))


def brute(texts, libraries):
    found = []
    for text in texts:
        if not text:
            found.append(None)
            continue
        (a, bytes_a), (b, bytes_b) = (tokens(text, x) for x in libraries)
        if not bytes_a == bytes_b == b" " + text.encode():
            found.append(None)
            continue
        ends = sorted({y for *_, y in a} & {y for *_, y in b})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, x, y in side if start <= x and y <= end) for side in (a, b)))
            start = end
        near, links = 0, []
        for i, x, y in a:
            while b[near][2] <= x:
                near += 1
            k = near
            while k < len(b) and b[k][1] < y:
                links.append((i, b[k][0]))
                k += 1
        found.append((len(a), len(b), groups, links))
    counts = Counter(link for f in found if f for link in f[3])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for f in found:
        if f is None:
            out.append(ZERO)
            continue
        n_a, n_b, groups, links = f
        best = sum(counts[link] == most[link[1]] for link in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((n_a, n_b, len(groups), len(links), best, sum(counts[link] for link in links), digest))
    return out


def test_documents_against_brute_force(spark, sf_dir, libraries):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = sorted(tuple(r) for r in PLANS["op12_tokenizer_alignment"].query(spark, sf_dir).collect())
    want = brute([d.text for d in docs], libraries)
    assert got == sorted((d.doc_id, *w) for d, w in zip(docs, want, strict=True))
    assert sum(r[5] for r in got) < sum(r[4] for r in got)


ODD = [
    None,
    "",
    " ",
    "a",
    " a  b\tc \n d ",
    "it's <|endoftext|> <s> </s> <unk> <0x41>",
    "a▁b",
    "▁",
    "é漢字🎉 ﬁ ｶ́  x　y \u0085 z᠎ ᠎᠎",
    "\x00\x01 \x7f",
    "word " * 4000,
    "x" * 3000,
    "don't don't 12345 6,7.8",
    "don't don't 12345 6,7.8",
]


@pytest.mark.parametrize("held", [align.HELD_PAIRS, 40])
def test_odd_texts_repeated_rows_and_clashing_names(spark, libraries, held):
    rows = [(i if i else None, t) for i, t in enumerate(ODD)] + [(4, ODD[4]), (4, ODD[4]), (None, ODD[5])]
    want = brute([t for _, t in rows], libraries)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame = frame.selectExpr("*", "1 AS text_key", "2 AS n_a", "3 AS code", "4 AS rows", "5 AS copy", "6 AS n")
    got = align.alignments(frame.repartition(3), *PATHS, held_pairs=held).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=key)
    assert align.alignments(frame.limit(0), *PATHS, held_pairs=held).count() == 0


def test_memory_of_chunks_is_bounded(spark, libraries, monkeypatch):
    monkeypatch.setattr(align, "REMEMBERED", 10)
    monkeypatch.setattr(align, "GATHERED", 50)
    texts = [" ".join(f"w{i * k} and{k}" for k in range(30)) + "y" * i for i in range(60)]
    work = align.Aligner(*PATHS)
    for text in texts:
        chunks = set(work.chunks(text))
        work.learn(chunks)
        work.forget_long(chunks)
        assert len(work.held) <= 10 + 60 and max(map(len, work.held)) <= align.LONGEST
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r)[1:] for r in align.alignments(frame, *PATHS).collect()) == sorted(brute(texts, libraries))


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab é漢🎉\t\n.'s1▁ "), max_size=40))
def test_chunks_align_like_whole_texts(libraries, text):
    work = aligner()
    chunks = work.chunks(text)
    work.learn(set(chunks))
    entries = [work.held[c] for c in chunks]
    want = brute([text], libraries)[0]
    if not text or None in entries:
        assert want == ZERO
    else:
        assert hashlib.sha256("".join(e[1] for e in entries)[:-1].encode()).hexdigest() == want[-1]
        assert sum(len(e[2]) // 8 for e in entries) == want[3]


def aligner():
    return align.aligner(*PATHS)
