"""Operator 3: line-first quality rules.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines are removed,
and a document that loses too much of its text is rejected. Documents are judged one by one, so the
work needs no shuffle and no state beyond a document.

Defined results: a null or empty text has no words and fails the base rules; blank lines are kept and
weigh nothing; repeated rows are judged alike; extra columns pass through `clean`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import tidy, utf8

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"

# Phrases of page furniture and of licences, lower case.
NAVIGATION = ("click here", "read more", "next page", "previous page", "sign in", "log in", "skip to content", "back to top", "share this", "site map", "home page")
BOILERPLATE = ("all rights reserved", "terms of use", "privacy policy", "cookie policy", "use of cookies", "copyright", "permission is hereby granted", "licensed under", "without warranty", "lorem ipsum", "javascript")

_NAVIGATION = re.compile("|".join(map(re.escape, NAVIGATION)).encode())
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)).encode())
_SHOUTED = re.compile(rb"[A-Z]")
_LOWER = re.compile(rb"[a-z]")


@dataclass(frozen=True)
class Rules:
    """Thresholds, all in percent or words; the defaults are those of production."""

    symbols_per_100_words: int = 30
    bars_per_100_words: int = 20
    exclaimed_percent: int = 30
    shouted_percent: int = 60
    stutter_percent: int = 30
    least_words: int = 5
    short_line_words: int = 12
    most_lost_percent: int = 50
    base_least_words: int = 10
    base_repeat_percent: int = 20


def line_verdict(line: bytes, n: int, rules: Rules) -> str | None:
    """The rule that a line of n > 0 words fails, or None."""
    if 100 * line.count(b"|") > rules.bars_per_100_words * n:
        return "navigation"
    if 100 * (n_symbols(line) - line.count(b"|")) > rules.symbols_per_100_words * n:
        return "punctuation"
    if n >= rules.least_words:
        w = line.split()
        if 100 * sum(map(eq, w, w[1:])) > rules.stutter_percent * n:
            return "boilerplate"
        if 100 * line.count(b"!!") > rules.exclaimed_percent * n:
            return "punctuation"
        upper = len(_SHOUTED.findall(line))
        if upper and 100 * upper > rules.shouted_percent * (upper + len(_LOWER.findall(line))):
            return "punctuation"
    lower = line.lower()
    if n <= rules.short_line_words and _NAVIGATION.search(lower):
        return "navigation"
    if _BOILERPLATE.search(lower):
        return "boilerplate"
    return None


def n_symbols(text: bytes) -> int:
    return len(text) - len(text.translate(None, SYMBOLS))


def repeat_words(w: list[bytes]) -> int:
    """Words that stand in a 5-word window found twice or more, the first find included."""
    if len(w) < 6:
        return 0
    windows = list(zip(w, w[1:], w[2:], w[3:], w[4:]))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple, int] = {}
    twice = bytearray(len(w))
    for i, x in enumerate(windows):
        j = first.setdefault(x, i)
        if j != i:
            twice[i : i + 5] = b"\1" * 5
            twice[j : j + 5] = b"\1" * 5
    return sum(twice)


def assess(text: bytes | None, rules: Rules) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lines_removed, clean text)."""
    text = text or b""
    w = text.split()
    n = len(w)
    packed = text.translate(None, WHITE)
    chars = len(packed.decode("utf-8", "replace"))
    repeats = repeat_words(w)
    seen: set[bytes] = set()
    dup = lost = removed = 0
    left = []
    for line in text.split(b"\n"):
        k = len(line.split())
        if k:
            again = line in seen
            dup += again
            seen.add(line)
            if again or line_verdict(line, k, rules):
                removed += 1
                lost += k
                continue
        left.append(line)
    base = n < rules.base_least_words or 100 * repeats > rules.base_repeat_percent * n
    kept = not base and 100 * lost <= rules.most_lost_percent * n
    return n, chars, n_symbols(text), dup, repeats, base, kept, removed, b"\n".join(left)


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lines_removed long, clean_text string"


def clean(docs: DataFrame, rules: Rules = Rules(), text: str = "text", with_text: bool = True) -> DataFrame:
    """docs with the columns of FIELDS appended (the clean text only on request).

    Columns of docs that have one of these names are replaced.
    """
    names = [x.split()[0] for x in FIELDS.split(", ")]
    added = names if with_text else names[:-1]
    keep = [c for c in docs.columns if c not in added]
    kinds = dict(x.split() for x in FIELDS.split(", "))
    schema = T.StructType([docs.schema[c] for c in keep])
    for c in added:
        schema = schema.add(c, kinds[c])

    def run(batches):
        for batch in batches:
            rows = [assess(x, rules) for x in utf8(batch.column(text))]
            cols = list(zip(*rows)) if rows else [()] * 9
            arrays = [batch.column(c) for c in keep]
            arrays += [pa.array(cols[i], pa.int64()) for i in range(5)] + [pa.array(cols[i], pa.bool_()) for i in (5, 6)] + [pa.array(cols[7], pa.int64())]
            if with_text:
                arrays.append(pa.array([x.decode("utf-8", "replace") for x in cols[8]], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *added])

    return docs.mapInArrow(tidy(run), schema)


def query(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The digest of every document: counts, base rules and verdict."""
    out = clean(docs.select("doc_id", "text"), rules, with_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lines_removed")


def kept_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, in the columns of docs, without their failing lines."""
    out = clean(docs, rules).filter("kept").withColumn("text", F.col("clean_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
