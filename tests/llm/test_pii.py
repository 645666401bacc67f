from __future__ import annotations

import hashlib
import random
import re

import pytest

from quernstone.llm import pii
from quernstone.llm.queries import PLANS

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base(text: str) -> list[tuple]:
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = [("email", m) for m in EMAIL.finditer(text)]
    found += [("ip", m) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [("card", m) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [("phone", m) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return [(k, m.start(), m.end()) for k, m in found]


def check(rows, texts):
    for r in rows:
        spans = base(texts[r.doc_id] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), texts[r.doc_id][:200]
        counts = tuple(sum(k == kind for k, _, _ in spans) for kind in ("email", "ip", "card", "phone"))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == counts
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = PLANS["op3_personal_data"].query(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    check(rows, {d.doc_id: d.text for d in docs})


def test_any_text_against_brute_force(spark):
    draw = random.Random(3)
    parts = [*"aZ910.@-+ ()%_é🎉\n", "4111 1111 1111 1111", "1.2.3.4", "x@y.zz", "+1 555 123 4567"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(60))) for _ in range(1500)]
    texts += ["a@b.c.d_x@y.z", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "0001.255.256.1 000255.1.1.1", None, ""]
    # Long runs must neither overflow a stack nor take quadratic time.
    texts += ["a" * 50_000, "1" * 50_000, "a@b" + ".c" * 10_000, "1." * 20_000, "+" + "1 " * 20_000, "+1" + "(" * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(pii.counted(pii.find(docs)).collect(), texts)


@pytest.mark.parametrize(
    "text, spans",
    [
        ("GB82 WEST 1234 5698 7654 32", "iban:0:27"),
        ("GB82 WEST 1234 5698 7654 33", ""),
        ("BE68 5390 0754 7034 EUR", "iban:0:19"),
        ("ES91 2100 0418 4502 0005 1332 PLEASE PAY", "iban:0:29"),
        ("to DE89370400440532013000, DE89 3704 0044 0532 0130 00 A", "iban:3:25,iban:27:54"),
        ("DE89370400440532013000X", ""),
        ("social security 123-45-6789", "ssn:16:27"),
        ("SSN 123-45-6789, 187-65-4321", "ssn:4:15,ssn:17:28"),
        ("SSN 123-45-6789, 000-65-4321, 187-65-4321", "ssn:4:15,ssn:30:41"),
        ("123-45-6789 is my social security number", "ssn:0:11"),
        ("123-45-6789" + " " * 48 + "ssn", ""),
        ("ssn" + " " * 48 + "123-45-6789", ""),
        ("part number 123-45-6789", ""),
        ("ssn 666-45-6789", ""),
        ("mail a@b.cc", "email:5:11"),
    ],
)
def test_validators_and_context(spark, text, spans):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.counted(pii.find(docs)).first().spans == spans


def test_context_raises_the_score(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cc"), (2, "see a@b.cc")], "doc_id long, text string")
    scores = {r.doc_id: r.spans[0].score for r in pii.find(docs).collect()}
    assert scores[1] > scores[2] >= pii.THRESHOLD


def test_redaction_merges_overlaps_and_keeps_columns(spark, edges, clashing):
    texts = ["x a@b.cc y", "1.2.3.4@b.cc", "é🎉 +1 555 123 4567!", "nothing", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in pii.redact(docs).orderBy("doc_id").collect()]
    assert got == ["x [EMAIL] y", "[EMAIL]", "é🎉 [PHONE]!", "nothing", None, ""]
    masked = pii.redact(clashing)
    assert masked.columns == clashing.columns and masked.count() == edges.count()
    assert pii.counted(pii.find(clashing)).count() == edges.count()
    assert pii.counted(pii.find(edges.limit(0))).count() == 0
    named = docs.selectExpr("*", "'kept' AS _spans", "7 AS _reach")
    assert [tuple(r)[1:] for r in pii.redact(named).orderBy("doc_id").collect()] == [(t, "kept", 7) for t in got]


def test_plan_has_no_python(spark, sf_dir):
    plan = PLANS["op3_personal_data"].query(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
