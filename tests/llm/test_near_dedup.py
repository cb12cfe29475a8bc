import random
from collections import Counter, defaultdict

import pytest

from citeloom.llm import graph
from citeloom.llm import near_dedup as N
from tests.llm.conftest import frame


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for e in sets[i] for j in holders[e])
        for j, c in common.items():
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for e in sets[i]:
            holders[e].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def family(seed, n, edits):
    """Copies of one text with some words changed, between which most links run through the original."""
    r = random.Random(seed)
    base = [f"b{r.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s", 0))
    return rows


@pytest.mark.parametrize("n,percent", [(4, 80), (5, 80)])
def test_components_equal_brute_force(docs, n, percent):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = N.near_duplicates(docs, n, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, n, percent)
    assert len(got) == len(rows)


@pytest.mark.parametrize("block,k", [(N.BLOCK, N.K), (16, 16)])
def test_family_of_near_copies(spark, monkeypatch, block, k):
    monkeypatch.setattr(N, "BLOCK", block)
    rows = family(3, 150, 9) + [(1000 + i, *r[1:]) for i, r in enumerate(family(4, 60, 2))]
    got = N.near_duplicates(frame(spark, rows), 4, 80, max(k, 64)).collect()
    want = brute([(r[0], r[1]) for r in rows], 4, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) > 2


def test_query_and_pipeline_stage(docs):
    rows = {r.doc_id: r for r in N.query(docs).collect()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows.values())
    kept = N.kept_documents(docs, 4, 80)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.kept}


def test_edges(spark, empty):
    assert N.query(empty).count() == 0
    rows = [(None, "a b c d", None, None, None), (4, "a b c d", None, None, None), (4, "a b c d", None, None, None), (2, "A B  C\nD", None, None, None), (3, None, None, None, None), (5, "", None, None, None), (6, "x", None, None, None), (7, "X", None, None, None)]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in N.query(frame(spark, rows)).collect())
    assert got == [(-1, 1, None, True), (2, 1, 2, True), (3, 0, 3, True), (4, 1, 2, False), (4, 1, 2, False), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False)]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 100), (200, 150)], "a long, b long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(51)} | {150: 150, 200: 150}
