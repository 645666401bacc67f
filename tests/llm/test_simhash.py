from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm import simhash
from quernstone.llm.components import connected_components
from quernstone.llm.queries import PLANS


def fingerprint(text: str | None) -> int:
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values: list[int], radius: int = 3) -> dict[int, int]:
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    held = np.array(sorted(parent), np.uint64)
    for v in held:
        for w in held[np.bitwise_count(held ^ v) <= radius]:
            a, b = find(int(v)), find(int(w))
            parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in parent}


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    prints = {d.doc_id: fingerprint(d.text) for d in docs}
    root = roots(list(prints.values()))
    least = {}
    for i, p in prints.items():
        least[root[p]] = min(i, least.get(root[p], i))
    got = {tuple(r) for r in PLANS["op2_simhash_near_duplicates"].query(spark, sf_dir).collect()}
    assert got == {(i, format(p, "016x"), least[root[p]]) for i, p in prints.items()}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \t\n\x1c\x85", max_size=40), max_size=8))
def test_fingerprints_of_any_text(texts):
    got = simhash.text_fingerprints(pa.array([*texts, None], pa.string()))
    assert got.tolist() == [fingerprint(t) for t in [*texts, None]]


def test_planted_distances_are_linked(spark):
    random = np.random.default_rng(3)
    values = []
    for base in random.integers(0, 1 << 63, 40).tolist():
        values.append(base)
        for distance in (1, 2, 3, 4):
            bits = random.choice(64, distance, replace=False)
            values.append(base ^ sum(1 << int(b) for b in bits))
    signed = [(int(np.uint64(v).view(np.int64)),) for v in sorted(set(values))]
    links = simhash.link_fingerprints(spark.createDataFrame(signed, "fp long"), len(signed))
    pairs = [(int(np.int64(a).view(np.uint64)), int(np.int64(b).view(np.uint64))) for a, b in links.collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    want = roots(values)
    found = {r.node: r.root for r in connected_components(links).collect()}
    groups = {}
    for v in want:
        key = found.get(int(np.uint64(v).view(np.int64)), ("alone", v))
        groups.setdefault(key, set()).add(want[v])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (200, 150), (150, 200)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)} | {150: 150, 200: 150}
    want |= {100 + i: 100 for i in range(50)}
    assert found == want


def test_edges(edges, clashing):
    rows = simhash.near_duplicates(clashing).collect()
    assert len(rows) == edges.count()
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {2, 3, 4} and {r.component_id for r in zero} == {2}
    assert {r.component_id for r in rows if r.doc_id in (1, 5) or r.doc_id is None} == {1}
    kept = simhash.keep_one_per_group(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 6, 7]
    assert simhash.near_duplicates(edges.limit(0)).count() == 0
    assert simhash.keep_one_per_group(edges.limit(0)).count() == 0


def test_one_of_repeated_rows_stays(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "quite other words here now"), (2, "A b c d")]
    kept = simhash.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect())) == [(1, "a b c d"), (1, "quite other words here now")]
