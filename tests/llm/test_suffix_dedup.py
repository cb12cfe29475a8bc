import random

import numpy as np
import pytest

from citeloom.llm import suffix_dedup as S
from tests.llm.conftest import frame


def brute(rows, least):
    """(doc_id -> spans) by listing every window of every document in order."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().lower().split()
        hit = [False] * len(w)
        for a in range(len(w) - least + 1):
            x = tuple(w[a : a + least])
            if x in seen:
                hit[a : a + least] = [True] * least
            seen.add(x)
        spans, a = [], None
        for k, h in enumerate([*hit, False]):
            if h and a is None:
                a = k
            elif not h and a is not None:
                spans.append((a, k))
                a = None
        out[i] = (len(w), spans)
    return out


@pytest.mark.parametrize("least,limit,fan", [(50, S.BLOCK_BYTES, None), (50, 4000, 3), (8, 4000, None), (25, 9000, 2)])
def test_spans_equal_brute_force(docs, monkeypatch, least, limit, fan):
    monkeypatch.setattr(S, "BLOCK_BYTES", limit)
    monkeypatch.setattr(S, "PART_KEYS", 500)
    monkeypatch.setattr(S, "NODE_RECORDS", 40)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, least)
    got = S.repeats(docs, least, fan=fan).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        spans = [(s.start, s.end) for s in r.spans]
        assert (r.n_words, spans) == want[r.doc_id]
        assert r.n_cut == sum(b - a for a, b in spans)
        left = [w for k, w in enumerate((texts[r.doc_id] or "").encode().split()) if not any(a <= k < b for a, b in spans)]
        assert (r.text or "").encode().split() == left
    assert any(r.n_cut for r in got) and any(0 < r.n_cut < r.n_words for r in got)


@pytest.mark.parametrize("seed", range(4))
def test_windows_of_suffixes_equal_all_pairs(seed):
    r = random.Random(seed)
    least, gram = 9, 4
    texts = [[r.choice("abc") for _ in range(40)] for _ in range(12)]
    for k in range(1, 12):
        a, b = r.randrange(25), r.randrange(25)
        texts[k][b : b + 14] = texts[r.randrange(k)][a : a + 14]
    items = [(t, p) for t in range(12) for p in range(40 - gram)]
    num = {c: i for i, c in enumerate("abc")}
    right, left = np.full((len(items), least), -1, np.int32), np.full((len(items), least - gram), -1, np.int32)
    has = np.zeros((len(items), least - gram + 1), bool)
    for i, (t, p) in enumerate(items):
        w = [num[c] for c in texts[t]]
        x, y = w[p : p + least], w[max(0, p - least + gram) : p][::-1]
        right[i, : len(x)], left[i, : len(y)] = x, y
        for o in range(least - gram + 1):
            has[i, o] = p - o >= 0 and p - o + least <= 40 and r.random() < 0.8
    rank = np.array(r.sample(range(len(items)), len(items)))
    got = S.repeated(right, left, has, rank, least)
    for i, (t, p) in enumerate(items):
        for o in np.flatnonzero(has[i]):
            same = [j for j, (u, q) in enumerate(items) if has[j, o] and texts[u][q - o : q - o + least] == texts[t][p - o : p - o + least]]
            assert got[i, o] == (min(rank[j] for j in same) < rank[i])


def test_equal_hashes_of_other_words_are_not_cut(spark, monkeypatch):
    monkeypatch.setattr(S, "grams", lambda h, n: np.full(len(h), 7, np.uint64))
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60)), "en", "s", 0) for i in range(6)]
    rows.append((6, rows[2][1], "en", "s", 0))
    monkeypatch.setattr(S, "BLOCK_BYTES", 900)
    got = {r.doc_id: r.n_cut for r in S.repeats(frame(spark, rows).coalesce(1)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 60}


def test_a_shared_passage_stays_once(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"start{i} {passage} end{i}", "en", "s", 0) for i in range(40)]
    got = {r.doc_id: r.text for r in S.cut_documents(frame(spark, rows).repartition(4)).collect()}
    assert sum(passage in t for t in got.values()) == 1 and passage in got[0]
    assert got[7] == "start7 end7"


def test_edges(spark, empty):
    assert S.query(empty).count() == 0
    long = " ".join(f"q{i}" for i in range(55))
    rows = [(None, long, None, None, None), (1, long, None, None, None), (1, long, None, None, None), (2, None, None, None, None), (3, "", None, None, None)]
    got = S.repeats(frame(spark, rows)).collect()
    cut = sorted((r.doc_id is None, r.doc_id or 0, r.n_cut) for r in got)
    assert cut == [(False, 1, 0), (False, 1, 55), (False, 2, 0), (False, 3, 0), (True, 0, 55)]
    kept = S.cut_documents(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 3]
