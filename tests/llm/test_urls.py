from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, differences

from quernstone.llm import urls
from quernstone.llm.queries import PLANS


def as_regex(glob):
    out = ""
    for part in urls._parts(glob):
        out += {"**": ".*", "*": "[^/]*", "?": "[^/]"}[part] if isinstance(part, str) else re.escape(part.decode())
    return re.compile(out, re.DOTALL)


def brute(url, rules=urls.SITE_RULES, globs=urls.GLOBS, default=urls.DEFAULT):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in host)
    fits = [r for r in rules if ("." + host).endswith("." + r[1]) and path.startswith(r[2])]
    if fits:
        verdict, h, p = max(fits, key=lambda r: (len(r[1] + r[2]), len(r[1])))
        return host, path, h + p, verdict
    for verdict, glob in globs:
        if as_regex(glob).fullmatch(host + path):
            return host, path, None, verdict
    return host, path, None, default


def test_pages_against_sql_and_brute_force(spark, sf_dir):
    plan = PLANS["op13_url_verdicts"]
    got = plan.query(spark, sf_dir)
    assert differences(got, connect(sf_dir), plan.sql) == []
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()
    assert sorted(map(tuple, got.collect())) == sorted((p.page_id, *brute(p.url)) for p in pages)
    assert {r.verdict for r in got.filter("rule IS NOT NULL").collect()} == {"allow", "block"}


ODD = [
    None,
    "",
    "no scheme",
    "http://",
    "HTTP://WWW.EXAMPLE.COM/en/x",
    "https://example.com",
    "https://com/",
    "https://a.b.example.com/en/",
    "https://xcom/",
    "https://notexample.com/en/",
    "https://.com/x",
    "https://example.org?q=http://x.com/en/",
    "https://example.net/es/#/fr/",
    "https://example.net/fr",
    "https://example.org/a\nb.jpg",
    "https://ÉCOLE.example.org/é.zip",
    "//x://example.com/en/",
    "https://blog.casino-9.org",
    "https://x.org/" + "a/" * 300_000 + "login",
    "https://x.org/" + "é" * 100_000 + ".jpg",
]


def test_odd_urls_repeated_rows_and_clashing_names(spark):
    rows = [(i, u, i, "x") for i, u in enumerate(ODD)] + [(None, ODD[4], 0, "y"), (3, ODD[3], 1, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host long, verdict string")
    pages = pages.selectExpr("*", "0 AS whole", "0 AS rule", "'p' AS path")
    got = {(r[0], tuple(r)[1:]) for r in urls.judge(pages).collect()}
    assert got == {(i, brute(u)) for i, u, *_ in rows}
    assert urls.judge(pages.repartition(2)).count() == len(rows)
    assert urls.judge(pages.limit(0)).count() == 0


def test_other_rules_ties_and_no_rules(spark):
    rules = [("allow", "org", "/ab/"), ("block", "b.org", "/a"), ("allow", "b.org", "/a"), ("block", "", "/q")]
    pages = [(1, "x://a.b.org/ab/"), (2, "x://b.org/a"), (3, "x://org/ab/"), (4, "x:///q"), (5, "x://c.dev/q"), (6, "x://*.org/?")]
    frame = spark.createDataFrame(pages, "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(frame, rules, [("block", "\\*.org/")]).collect()}
    # A rule of no host fits only hosts that are empty or end with a stop.
    assert got == {1: ("b.org/a", "block"), 2: ("b.org/a", "block"), 3: ("org/ab/", "allow"), 4: ("/q", "block"), 5: (None, "allow"), 6: (None, "block")}
    assert {r.verdict for r in urls.judge(frame, [], [], "block").collect()} == {"block"}


def test_many_rules_span_words(spark):
    rules = [("block" if i % 2 else "allow", f"site-{i}.example.org", f"/{i % 7}/") for i in range(400)]
    pages = [(i, f"http://www.site-{i}.example.org/{i % 5}/x") for i in range(500)]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rules)
    assert {tuple(r) for r in got.collect()} == {(i, *brute(u, rules)) for i, u in pages}
    with pytest.raises(ValueError):
        urls.Automaton(["x" * (64 * urls.MOST_WORDS + 1)])


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.text(st.sampled_from("ab/é**?\\"), max_size=12), min_size=1, max_size=9),
    st.lists(st.text(st.sampled_from("ab/é*\\"), max_size=9), min_size=1, max_size=40),
)
def test_automaton_against_regular_expressions(globs, texts):
    found = urls.Automaton(globs).first(pa.array(texts, pa.string()))
    want = [next((k for k, g in enumerate(globs) if as_regex(g).fullmatch(t)), len(globs)) for t in texts]
    assert np.array(want).tolist() == found.tolist()
