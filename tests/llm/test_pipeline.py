import random

import corpus_pipeline
from citeloom.llm import mixing, near_dedup, packing, quality, suffix_dedup
from tests.llm.conftest import frame
from tests.llm.test_near_dedup import brute as groups
from tests.llm.test_suffix_dedup import brute as passages


def write(spark, path, seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    shared = " ".join(word() for _ in range(60))
    rows = []
    for i in range(60):
        text = ". ".join(" ".join(word() for _ in range(12)) for _ in range(8)) + "."
        if i % 6 == 1:
            text = rows[-1][1].replace("a", "a", 1) + " extra"
        if i % 9 == 2:
            text += " " + shared
        if i % 10 == 3:
            text = "A | B | C | D | E | F | G | H | I | J | K"
        rows.append((i, text, "en", f"src{i % 4}", len(text)))
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    return rows


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    rows = write(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = {}
    for i, t, *_ in rows:
        *_, kept, _, clean = quality.assess(t.encode(), quality.Rules())
        if kept:
            texts[i] = clean.decode()
    one = groups(list(texts.items()), 5, 80)
    texts = {i: t for i, t in texts.items() if one[i][1] == i}
    cut = passages(list(texts.items()), 50)
    want = {}
    for i, t in texts.items():
        w = t.split()
        want[i] = [x for k, x in enumerate(w) if not any(a <= k < b for a, b in cut[i][1])]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
    assert {r.doc_id: r.text.split() for r in now.collect()} == want
    assert 0 < len(want) < len(rows) and any(cut[i][1] for i in cut)
    mixed = mixing.mix(now)
    assert mixed.columns == docs.columns
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(final) == packing.pieces(mixed).count()
    assert {r.doc_id for r in final} <= set(want)


def test_stages_are_the_agreed_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "mixed_sources", "packed_sequences"]
    assert near_dedup and suffix_dedup
