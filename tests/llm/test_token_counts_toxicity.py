import math
import random
import zlib

import numpy as np

from citeloom.llm import token_counts as C
from citeloom.llm import toxicity as X
from tests.llm.conftest import frame


def best(model, word):
    """(score, tokens) of the best segmentation by plain recursion over all cuts."""
    memo = {0: (0.0, 0)}
    for i in range(1, len(word) + 1):
        n = len(word[i - 1].encode())
        options = [(memo[i - 1][0] + C.UNKNOWN * n, memo[i - 1][1] + n)]
        options += [(memo[j][0] + model.score[word[j:i]], memo[j][1] + 1) for j in range(i) if word[j:i] in model.score]
        top = max(s for s, _ in options)
        memo[i] = (top, min(n for s, n in options if s == top))
    return memo[len(word)]


def test_counts_equal_brute_force(docs):
    model = C.Unigram(C.default_vocabulary())
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    seen = {}
    for r in C.query(docs).collect():
        w = (rows[r.doc_id] or "").encode().split()
        for x in w:
            if x not in seen:
                seen[x] = best(model, C.START + x.decode())[1]
        assert (r.n_words, r.n_tokens) == (len(w), sum(seen[x] for x in w))


def test_prefixes_are_scored_once(monkeypatch):
    model, steps = C.Unigram(C.default_vocabulary()), []
    monkeypatch.setattr(C.Unigram, "step", (lambda f: lambda self, *a: (steps.append(1), f(self, *a)))(C.Unigram.step))
    model.learn({b"interest", b"interested", b"interesting", b"interests"})
    assert len(steps) == 1 + len("interest") + len("ed") + len("ing") + len("s")
    model.learn({b"interest"})
    assert len(steps) == 1 + len("interest") + len("ed") + len("ing") + len("s")


def test_count_edges(spark, empty):
    assert C.query(empty).count() == 0
    rows = [(1, None, "a", "b", 0), (1, None, "a", "b", 0), (2, "", "a", "b", 0), (3, "字" * 3000, "a", "b", 0)]
    got = C.count_tokens(frame(spark, rows).withColumnRenamed("lang", "n_words"))
    assert sorted(r.n_words for r in got.collect()) == [0, 0, 0, 1]


def labelled(seed=0, n=900):
    r = random.Random(seed)
    calm, rude = [f"c{i}" for i in range(200)], ["scum", "vile", "rotten"]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(calm) for _ in range(r.choice([5, 40, 200]))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(rude))
        docs.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_toxicity_is_found(spark):
    docs, labels = labelled()
    got = X.query(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert right / len(held) > 0.97


def test_labels_of_held_out_rows_have_no_part(spark):
    docs, labels = labelled(n=300)
    flipped = [(i, q, 1 - t if X_held(i) else t) for i, q, t in labels]
    one, two = (X.query(frame(spark, docs), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect() for x in (labels, flipped))
    assert {r.doc_id: r.score for r in one} == {r.doc_id: r.score for r in two}


def X_held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_weights_are_sparse_and_equal_plain_ftrl():
    r = np.random.default_rng(1)
    rows = [(r.integers(0, 50, 8).astype(np.int32), int(i % 3 == 0)) for i in range(60)]
    at, w, bias = X.fit(rows, alpha=0.5, l1=0.5, epochs=2)
    z, n, b, bn = {}, {}, 0.0, 0.0
    for _ in range(2):
        for x, y in rows:
            f = sorted(set(x.tolist()))
            ws = {i: 0.0 if abs(z.get(i, 0)) <= 0.5 else -(z[i] - math.copysign(0.5, z[i])) / ((1 + math.sqrt(n[i])) / 0.5 + 0.1) for i in f}
            g = 1 / (1 + math.exp(-(sum(ws.values()) + b))) - y
            for i in f:
                s = (math.sqrt(n.get(i, 0) + g * g) - math.sqrt(n.get(i, 0))) / 0.5
                z[i] = z.get(i, 0) + g - s * ws[i]
                n[i] = n.get(i, 0) + g * g
            bn += g * g
            b -= 0.5 * g / (1 + math.sqrt(bn))
    want = {i: -(z[i] - math.copysign(0.5, z[i])) / ((1 + math.sqrt(n[i])) / 0.5 + 0.1) for i in z if abs(z[i]) > 0.5}
    assert dict(zip(at.tolist(), w.tolist())) == {i: np.float32(v) for i, v in sorted(want.items())} or np.allclose(w, [want[i] for i in at], atol=1e-5)
    assert math.isclose(bias, b, rel_tol=1e-9) and len(at) < 50


def test_toxicity_edges(spark, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert X.query(empty, none).count() == 0
    rows = [(1, None, None, None, None), (2, "", None, None, None), (2, "", None, None, None), (None, "a b", None, None, None)]
    got = X.query(frame(spark, rows), none).collect()
    assert len(got) == 4 and all(r.score == 0.5 for r in got)
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(X.query(frame(spark, rows), odd).collect()) == 4
