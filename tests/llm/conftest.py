"""Fixture corpora of the corpus operators."""

import random

import pytest

from citeloom.llm.common import release

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def corpus(seed: int = 1, n: int = 120) -> list[tuple]:
    """Random prose with exact and near copies, shared passages, a hot source, nulls and odd texts."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "and", "Ärger", "naïve"] * 20
    passage = " ".join(r.choice(words) for _ in range(70))
    rows = []
    for i in range(n):
        text = " ".join(r.choice(words) for _ in range(r.choice([3, 12, 60, 150, 400])))
        if rows and i % 5 == 1:
            text = r.choice(rows)[1] or text
            w = text.split()
            if i % 10 == 1 and len(w) > 20:
                w[r.randrange(len(w))] = "changed"
                text = " ".join(w)
        if i % 7 == 2:
            text = f"{text} {passage} {i}"
        rows.append((i, text, r.choice(["en", "de", None]), "src0" if i % 3 == 0 else f"src{r.randrange(6)}", len(text)))
    rows += [(n, None, "en", "src1", 0), (n + 1, "", None, None, 0), (n + 2, " \t\n", "en", "src2", 3), (n + 3, "one", "en", "src2", 3), (n + 4, "\x1c\xa0odd text", "fr", None, 9), (n + 5, "a b c d e f g h i j " * 40, "en", "src0", 800)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    yield frame(spark, corpus()).repartition(3).cache()
    release(spark)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
