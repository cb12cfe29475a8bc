import math
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from citeloom.llm import katz
from citeloom.llm.common import distinct, mix64
from citeloom.llm.exchange import Gathered, packed, put, put_planes, put_sorted
from tests.llm.conftest import corpus, frame


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + ["</s>"]


def brute(rows, order=3):
    train = [tokens(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    count = [Counter() for _ in range(order + 1)]
    for x in train:
        for m in range(1, order + 1):
            padded = ["<s>"] * (m - 1) + x
            count[m].update(tuple(padded[i : i + m]) for i in range(len(x)))
    uni = Counter({w: c for (w,), c in count[1].items()})
    n, v = sum(uni.values()), len(uni)
    of = lambda c: [sum(k == r for k in c.values()) for r in range(1, katz.K + 2)]
    disc = [None] + [katz.discounts(of(count[m])) for m in range(1, order + 1)]
    d = lambda m, c: (disc[m][c] if c < len(disc[m]) else 1.0) * c
    left = 1 - sum(d(1, c) for c in uni.values()) / n if n else 1.0
    after = defaultdict(dict)
    for m in range(2, order + 1):
        for g, c in count[m].items():
            after[g[:-1]][g[-1]] = c

    @lru_cache(None)
    def weight(h):
        seen, m = after[h], len(h) + 1
        total, kept = sum(seen.values()), sum(d(m, c) for c in seen.values())
        f = total / (total + 1) if total - kept <= 1e-9 * total else 1.0
        return f / total, (1 - f * kept / total) / (1 - sum(cond(h[1:], x) for x in seen))

    @lru_cache(None)
    def cond(h, w):
        if not h:
            return d(1, uni[w]) / n if uni[w] else left
        if h not in after:
            return cond(h[1:], w)
        f, a = weight(h)
        return f * d(len(h) + 1, after[h][w]) if w in after[h] else a * cond(h[1:], w)

    out = {}
    for i, t in rows:
        x = tokens(t)
        padded = ["<s>"] * (order - 1) + x
        score = sum(math.log10(cond(tuple(padded[k : k + order - 1]), w)) for k, w in enumerate(x))
        out[i] = (len(x), sum(uni[w] > 0 for w in x), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in x), score)
    return out, cond, uni, after


@pytest.mark.parametrize("order,limit,fan", [(3, katz.BLOCK_TOKENS, None), (3, 900, None), (3, 2500, 2), (2, 2500, 3), (1, 2500, None), (4, 2500, None)])
def test_scores_equal_brute_force(spark, docs, monkeypatch, order, limit, fan):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", limit)
    monkeypatch.setattr(katz, "PART_KEYS", 5000)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want, *_ = brute(rows, order)
    got = katz.score(docs, order, fan).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, train, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


def test_probabilities_sum_to_one():
    _, cond, uni, after = brute([(i, t) for i, t, *_ in corpus()])
    for h in [*list(after)[:20], *list(after)[-20:], ("never", "seen")]:
        assert math.isclose(sum(cond(h, w) for w in [*uni, "<unknown>"]), 1, rel_tol=1e-9)


def test_model_beats_the_base_on_held_out_text(docs):
    held = [r for r in katz.query(docs).collect() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges(spark, empty):
    assert katz.query(empty).count() == 0
    rows = [(None, "a b", "", "", 0), (5, "a b", "", "", 0), (5, "a b", "", "", 0), (6, "a" * 5000 + " b", "", "", 0)]
    got = katz.query(frame(spark, rows).withColumn("kind", docs_column())).collect()
    assert len(got) == 4 and all(r.score <= 0 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    held = next(i for i in range(100) if katz.held_out(i))
    (only,) = katz.query(frame(spark, [(held, "x y", "", "", 0)])).collect()
    assert only.held_out and only.train_tokens == 0 and only.score == 0


def hash_cases():
    r = np.random.default_rng(3)
    wide = mix64(r.integers(0, 700, 2000).astype(np.uint64))
    top = np.uint64(2**64 - 1)
    close = np.concatenate([wide, r.integers(0, 40, 500).astype(np.uint64) + np.uint64(2**63), np.array([0, top, 0, top], np.uint64)])
    few = np.concatenate([mix64(np.arange(9000, dtype=np.uint64)), np.array([7, 5, 7, 6, 5], np.uint64) + np.uint64(2**63)])
    return {"none": wide[:0], "one": wide[:1], "equal": np.full(9, top), "two": np.array([top, 0], np.uint64), "wide": wide, "close": r.permutation(close), "few": few, "narrow": wide >> np.uint64(50)}


@pytest.mark.parametrize("case", list(hash_cases()))
def test_distinct_equals_numpy(case):
    x = hash_cases()[case]
    values, first, place, count = np.unique(x, return_index=True, return_inverse=True, return_counts=True)
    got, at, order, starts = distinct(x)
    assert got.dtype == np.uint64 and (got == values).all() and (at == place).all()
    assert (order[starts] == first).all() and (np.diff(starts, append=len(x)) == count).all()
    assert (order == np.argsort(x, kind="stable")).all()


def test_blocks_and_parts_sort_no_positions(monkeypatch):
    """What made op4 exceed its CPU seconds: positions were sorted, in every round anew."""
    r = np.random.default_rng(4)
    words, n = np.unique(mix64(np.arange(1, 3001, dtype=np.uint64))), 40_000
    rank = r.integers(0, len(words), n)
    told = [put(np.array([1], np.int64)), put(np.ones(1, bool)), put(np.array([n], np.int64)), put_sorted(words), put_planes(np.arange(len(words))), put_planes(rank)]
    asked = [{"asker": i, "kind": katz.COUNT + 1, "keys": put_sorted(words[x::2]), "said": [packed(np.full(len(words[x::2]), x))]} for i, x in enumerate((0, 1, 1))]
    sizes = []
    for name in ("unique", "argsort"):
        plain = getattr(np, name)
        monkeypatch.setattr(np, name, lambda x, *a, plain=plain, **k: sizes.append(len(x)) or plain(x, *a, **k))
    b = katz.Block({"asker": 0, "told": told})
    assert [len(b.grow().hashes) for _ in range(2)] == [len(set(zip([-1, *rank], rank))), len(set(zip([-1, -1, *rank], [-1, *rank], rank)))]
    g = Gathered(asked)
    owners = [katz.get(a[3][-1][2:], np.uint8).sum() for a in g.answers(0, [], np.ones(len(g.keys), bool))]
    assert owners == [0, len(words) // 2, 0]
    assert max(sizes, default=0) < 100


def docs_column():
    from pyspark.sql import functions as F

    return F.lit("clash")
