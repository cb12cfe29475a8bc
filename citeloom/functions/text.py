"""Column functions on text: offsets, cleaning, tags, page markers, sentences, snippets.

Columns are expressions over built-in functions wherever those need one pass. Where a running position
is carried from match to match (offsets, page bounds, merged sentences), built-in folds copy their
array at each step; those few are Arrow UDFs, linear in the text. Nothing here needs an exchange.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,text:string>"

# Spaces that legal text uses besides U+0020, each replaced by one character so that
# offsets stay valid.
ODD_SPACES = "    "


def blank_to_null(c: Column) -> Column:
    return F.when(F.length(F.trim(c)) > 0, c)


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def plain_spaces(c: Column) -> Column:
    """Odd spaces as plain ones, length-preserving."""
    return F.translate(c, ODD_SPACES, " " * len(ODD_SPACES))


def per_text(give, kind: str):
    """An Arrow UDF that gives a value of type `kind` for each text; null for null."""

    arrow = _arrow(kind)

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else give(t) for t in column.to_pylist()], arrow)

    return F.arrow_udf(run, kind)


def _arrow(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))


def spans(text: Column, pattern: str) -> Column:
    """All matches of a pattern as array<struct<start,end,text>>, in code points from 0."""

    def give(t: str) -> list[dict]:
        return [{"start": m.start(), "end": m.end(), "text": m[0]} for m in re.finditer(pattern, t, re.ASCII)]

    return per_text(give, f"array<{SPAN}>")(text)


# ---- cleaning

CLEANERS = {
    "html": lambda c: F.regexp_replace(c, r"<[^>]*>", " "),
    "inline_whitespace": lambda c: F.regexp_replace(c, r"[ \t]+", " "),
    "all_whitespace": lambda c: F.regexp_replace(c, r"\s+", " "),
    "underscores": lambda c: F.regexp_replace(c, r"__+", ""),
}


def clean_text(c: Column, steps: list[str]) -> Column:
    """The named cleaners, one after the other."""
    for step in steps:
        if step not in CLEANERS:
            raise ValueError(f"unknown cleaner {step!r}; known: {sorted(CLEANERS)}")
        c = CLEANERS[step](c)
    return c


def strip_tags(c: Column) -> Column:
    """Every tag becomes a space, white space collapses; entities stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))


# ---- numbers


def to_int(c: Column) -> Column:
    """Integer of a trimmed string, or null: only digits with an optional sign count."""
    t = F.trim(c)
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("int"))


def pincites(c: Column) -> Column:
    """Page list of a pincite: first page of each range, prefix `at` dropped, no array entry for anything else."""
    parts = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), "[–—]", "-"), ",")
    firsts = F.transform(parts, lambda x: F.split(F.regexp_replace(F.trim(x), r"^[at ]+", ""), "-")[0])
    return F.filter(F.transform(firsts, to_int), lambda x: x.isNotNull())


# ---- pages

MARKER = r"(?m)^## PAGE [0-9]{1,9}$"
STAR, LABEL, PAGE_LABEL, FEED = r"\*([0-9]+)", r'(?<![-\w])label="([0-9]+)"', r'page-label="([0-9]+)"', "\f\\s*([0-9]+)"


_MARK = re.compile(MARKER, re.ASCII)


def page_list(text: str) -> list[tuple[int, int, int]]:
    """(page, start, end) of text with `## PAGE n` lines; text before the first has no page."""
    found = list(_MARK.finditer(text))
    ends = [m.start() for m in found[1:]] + [len(text)]
    return [(int(m[0][8:]), m.end(), e) for m, e in zip(found, ends)]


def page_bounds(text: Column) -> Column:
    """array<struct<page,start,end>> of text with `## PAGE n` lines."""
    return per_text(lambda t: [dict(zip(("page", "start", "end"), x)) for x in page_list(t)], "array<struct<page:int,start:int,end:int>>")(text)


def page_markers(text: Column) -> Column:
    """Page numbers of all marker conventions: star pages, labels, page labels, form feeds."""
    each = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (STAR, LABEL, PAGE_LABEL, FEED)]
    return F.transform(F.concat(*each), lambda x: x.try_cast("int"))


def page_span(text: Column, page: Column) -> Column:
    """struct<start,end> of a reporter page, or null: conventions in order of priority, to the next marker.

    The next marker stands ten characters or more after the start; slices begin and end at tags.
    """
    n = F.coalesce(page.cast("string"), F.lit("none"))
    starts = [F.nullif(F.regexp_instr(text, F.concat(F.lit(a), n, F.lit(b))), F.lit(0)) for a, b in ((r"\*", r"(?![0-9])"), (r'<[^<>]*(?<![-\w])label="', r'"[^>]*>'), (r'<[^<>]*page-label="', r'"[^>]*>'), ("\f\\s*", r"(?![0-9])"))]
    start = F.coalesce(*starts)
    rest = F.substring(text, start + 10, F.length(text))
    after = F.nullif(F.regexp_instr(rest, F.lit(r'\*[0-9]+|<[^<>]*label="[0-9]+"[^>]*>|' + "\f\\s*[0-9]+")), F.lit(0))
    return F.when(page.isNotNull() & start.isNotNull(), F.struct((start - 1).alias("start"), F.coalesce(start + 10 + after - 2, F.length(text)).alias("end")))


def page_or_whole(text: Column, page: Column, most: int = 30_000) -> Column:
    """struct<found, plain>: the page without tags, else the text cut at `most`, null without text."""
    span = page_span(text, page)
    cut = F.when(span.isNotNull(), F.substring(text, span["start"] + 1, span["end"] - span["start"])).otherwise(F.substring(text, 1, most))
    return F.when(blank_to_null(text).isNotNull(), F.struct(span.isNotNull().alias("found"), strip_tags(cut).alias("plain")))


def pagination_mode(text: Column, page: Column) -> Column:
    """reporter if the page lies within the markers, slip_only if outside, none without markers."""
    m = page_markers(text)
    inside = page.between(F.array_min(m), F.array_max(m))
    return F.when(F.size(m) == 0, "none").when(inside, "reporter").otherwise("slip_only")


# ---- sentences and snippets

SENTENCE = "(?<=[.?!])\\s+(?=[A-Z\"'“‘(0-9])"
LEAST_SENTENCE = 20


BREAK = re.compile(SENTENCE, re.ASCII)


def sentences(text: Column, least: int = LEAST_SENTENCE) -> Column:
    """Sentences of plain text; chunks shorter than `least` go to the following one, the last to the one before."""

    def give(t: str) -> list[str]:
        out, held = [], ""
        for x in BREAK.split(t):
            x = x.strip(" ")
            if x:
                held = f"{held} {x}" if held else x
                if len(held) >= least:
                    out.append(held)
                    held = ""
        if held:
            out = [*out[:-1], f"{out[-1]} {held}"] if out else [held]
        return out

    return per_text(give, "array<string>")(text)


def snippet(text: Column, start: Column, end: Column, words: int = 30) -> Column:
    """The span with up to `words` words on either side; the span itself is never cut."""
    before = F.filter(F.split(F.substring(text, 1, start), r"\s+"), lambda x: x != "")
    after = F.filter(F.split(F.substring(text, end + 1, F.length(text)), r"\s+"), lambda x: x != "")
    n = F.size(before)
    lead = F.slice(before, F.greatest(n - words + 1, F.lit(1)), F.lit(words))
    return F.concat_ws(" ", F.array_join(lead, " "), F.substring(text, start + 1, end - start), F.array_join(F.slice(after, 1, words), " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-|-$", "")
