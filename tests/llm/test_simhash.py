import re

import numpy as np
import xxhash

from tidelog.llm import simhash
from tidelog.llm.components import connected_components
from tidelog.llm.simhash import fingerprint, near_duplicates, near_links, spanning_links


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints(texts, monkeypatch):
    monkeypatch.setattr(simhash, "STEP", 17)
    for t in [*texts[:30], "", None, "a", "A b", "A B c", "a b c d", "ÀÉ  x\x0by z É"]:
        assert fingerprint(t) == plain_fingerprint(t)


def test_against_brute_force(docs, texts):
    want = plain_components([plain_fingerprint(t) for t in texts])
    for rows in (8192, 4, 2):  # short lists, longer keys, blocks
        got = {r.doc_id: r.component_id for r in near_duplicates(docs, list_rows=rows).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert len(set(want)) < len(want) - 10


def test_dense_clusters_over_all_tiers(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 3, dtype=np.int64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(60):
            x = int(b)
            for bit in rng.choice(63, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    want = plain_components(fps)
    prints = spark.createDataFrame(list(zip(fps, range(len(fps)), strict=True)), "fp long, node long")
    for rows in (8192, 20, 6):
        roots = {r.node: r.root for r in connected_components(near_links(prints, rows)).collect()}
        assert [roots.get(i, i) for i in range(len(fps))] == want


def test_spanning_links_never_cross_lists():
    key = np.array([1, 1, 1, 2, 2])
    fp = np.array([0, 7, 1 << 40, 0, 7])
    assert spanning_links(key, fp).tolist() == [0, 0, 0, 3, 3]


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 9), (None, 1), (20, 10), (2, 5), (10, 20)] + [(100, i) for i in range(101, 160)], "a long, b long")
    found = {r.node: r.root for r in connected_components(edges).collect()}
    assert found == {5: 2, 4: 2, 3: 2, 20: 10} | dict.fromkeys(range(101, 160), 100)
    assert connected_components(edges.where("false")).count() == 0
    chain = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert {r.root for r in connected_components(chain).collect()} == {0}


def test_cases(edge_docs, no_docs):
    rows = near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count() and near_duplicates(no_docs).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].fp == by[2][0].fp == by[3][0].fp == 0 and by[3][0].component_id == 1
    assert {r.component_id for r in by[6]} == {5} and by[5][0].component_id == 5
    assert {r.component_id for r in by[None]} == {1, 5}


def test_rows_without_id_link(spark, monkeypatch):
    """A fingerprint that only rows with null doc_id hold joins its component and connects others."""
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs)
    rows = [(7, 0), (None, 0b111), (5, 0b111111), (9, 0xFF << 40), (None, 0xFF << 40 | 1), (None, -1), (12, 0xFFFF << 20), (12, 0xFFF << 50)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    assert {(r.doc_id, r.fp): r.component_id for r in got} == dict(zip(rows, [5, 5, 5, 9, 9, None, 12, 12], strict=True))
