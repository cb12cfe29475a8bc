"""Citation extraction: text to mentions, and the expressions on a mention's text.

A document is read once, in an Arrow batch: thirty families are matched, overlaps are resolved from the
left, and what later steps need of the text around a mention (page, sentence, gap, snippet) goes with
it, so no row carries its whole document and extraction needs no exchange. Overlaps make the choice of
a mention depend on the one before, which built-in functions can only express as a quadratic fold.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions import grammar as G
from citeloom.functions import text as X

MENTION = {"idx": "integer", "family": "string", "type": "string", "full_citation": "string", "span_start": "integer", "span_end": "integer"}
#: What can go with a mention: the page it begins on, the text from the start of the sentence before it,
#: the 60 characters behind it, the text since the mention before, a snippet, the first word of the
#: innermost parenthesis that holds it, and the parenthesis that follows it.
CONTEXT = {"page": "integer", "lead": "string", "tail": "string", "gap": "string", "snippet": "string", "verb": "string", "follows": "string"}
ROWS = 20_000
TAIL = 60
SNIPPET_WORDS = 30

_PLAIN = str.maketrans(X.ODD_SPACES, " " * len(X.ODD_SPACES))
_WORD = re.compile(r"\S+", re.ASCII)
_PAREN = re.compile(r"[()]")
_VERB = re.compile(r"[A-Za-z]+")


@lru_cache
def _compiled(families: tuple[G.Family, ...]) -> list[tuple[re.Pattern, re.Pattern]]:
    return [(re.compile(f.needs, re.ASCII), re.compile(f.pattern, re.ASCII)) for f in families]


def find(text: str, families: tuple[G.Family, ...] = G.FAMILIES) -> list[tuple[int, int, G.Family]]:
    """(start, end, family) in document order without overlaps: the earliest wins, then the longest, then the family listed first."""
    found = []
    for n, (needs, pattern) in enumerate(_compiled(families)):
        if needs.search(text):
            found += [(m.start(), -m.end(), n) for m in pattern.finditer(text)]
    out, at = [], 0
    for start, back, n in sorted(found):
        if start >= at:
            at = -back
            out.append((start, at, families[n]))
    return out


def _around(text: str, found: list[tuple[int, int, G.Family]], context: tuple[str, ...]) -> dict[str, list]:
    """The context columns of a text's mentions; each is one pass over the text."""
    out: dict[str, list] = {}
    if "page" in context:
        pages = X.page_list(text)
        starts = [p[1] for p in pages]
        at = [bisect_right(starts, s) - 1 for s, _, _ in found]
        out["page"] = [pages[i][0] if i >= 0 else None for i in at]
    if "lead" in context:
        ends = [m.end() for m in X.BREAK.finditer(text)]
        at = [bisect_left(ends, s) for s, _, _ in found]
        out["lead"] = [text[ends[i - 2] if i > 1 else 0 : s] for i, (s, _, _) in zip(at, found)]
    if "tail" in context:
        out["tail"] = [text[e : e + TAIL] for _, e, _ in found]
    if "gap" in context:
        before = [0] + [e for _, e, _ in found]
        out["gap"] = [text[a:s] for a, (s, _, _) in zip(before, found)]
    if "snippet" in context:
        places = [m.span() for m in _WORD.finditer(text)]
        begins, ends = [a for a, _ in places], [b for _, b in places]
        out["snippet"] = [_snippet(text, places, begins, ends, s, e) for s, e, _ in found]
    if "verb" in context or "follows" in context:
        out["verb"], out["follows"] = _parentheses(text, found)
    return out


def _parentheses(text: str, found: list[tuple[int, int, G.Family]]) -> tuple[list, list]:
    """For each mention the first word of the innermost parenthesis around it, and the parenthesis right behind it.

    Parentheses that begin within a mention are part of it.
    """
    opened: list[int] = []
    within: list[int | None] = [None] * len(found)
    close: dict[int, int] = {}
    k = 0
    for m in _PAREN.finditer(text):
        while k < len(found) and found[k][0] < m.start():
            within[k] = opened[-1] if opened else None
            k += 1
        if k and m.start() < found[k - 1][1]:
            continue
        if m[0] == "(":
            opened.append(m.start())
        elif opened:
            close[opened.pop()] = m.end()
    verbs, follows = [], []
    for a, (_, e, _) in zip(within, found):
        word = _VERB.match(text, a + 1) if a is not None and a in close else None
        verbs.append(word[0].lower() if word else None)
        at = e + (text[e : e + 1] == " ")
        follows.append(text[at : close[at]] if at in close else None)
    return verbs, follows


def _snippet(text: str, places: list[tuple[int, int]], begins: list[int], ends: list[int], start: int, end: int) -> str:
    """The span with up to SNIPPET_WORDS words on either side; words that the span cuts count with what is left of them."""
    first, last = bisect_left(begins, start), bisect_right(ends, end)
    lead = [text[a : min(b, start)] for a, b in places[max(0, first - SNIPPET_WORDS) : first]]
    tail = [text[max(a, end) : b] for a, b in places[last : last + SNIPPET_WORDS]]
    return " ".join([*lead, text[start:end], *tail])


def mentions(docs: DataFrame, text: str = "text", families: tuple[G.Family, ...] = G.FAMILIES, context: tuple[str, ...] = ()) -> DataFrame:
    """docs without its text, a row for each mention: the columns of MENTION and those of CONTEXT that are asked for."""
    added = MENTION | {c: CONTEXT[c] for c in CONTEXT if c in context}
    keep = [c for c in docs.columns if c != text and c not in added]
    schema = T.StructType([docs.schema[c] for c in keep])
    for name, kind in added.items():
        schema = schema.add(name, kind)
    kinds = [pa.int32() if k == "integer" else pa.string() for k in added.values()]

    def run(batches):
        for batch in batches:
            origin, cols = [], [[] for _ in added]

            def taken() -> pa.RecordBatch:
                rows = pa.array(origin, pa.int64())  # not of the text, which would be copied for each mention
                return pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in keep], *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[*keep, *added])

            for i, t in enumerate(batch.column(text).to_pylist()):
                if not t:
                    continue
                t = t.translate(_PLAIN)
                found = find(t, families)
                own = [range(len(found)), [f.id for _, _, f in found], [f.kind for _, _, f in found], [t[s:e] for s, e, _ in found], [s for s, _, _ in found], [e for _, e, _ in found]]
                around = _around(t, found, context)
                for c, values in zip(cols, [*own, *[around[c] for c in added if c in around]]):
                    c += values
                origin += [i] * len(found)
                if len(origin) >= ROWS:
                    yield taken()
                    origin, cols = [], [[] for _ in added]
            yield taken()

    return docs.select(*keep, text).mapInArrow(run, schema)


# ---- components

VOL_REP_PAGE = rf"([0-9]+)\s+({G.REP})\s+(?:at\s+)?([0-9]+)"
FIELDS = ("source_name", "volume", "reporter", "start_page", "pincite", "court", "year", "title", "code", "section", "subsection", "rule_set", "rule_number", "author", "work_title", "journal", "url")
_INTS = ("volume", "start_page", "year", "title")


def part(c: Column, pattern: str, group: int = 1) -> Column:
    return X.empty_to_null(F.regexp_extract(c, pattern, group))


def compose_source_name(plaintiff: Column, defendant: Column) -> Column:
    p, d = X.blank_to_null(plaintiff), X.blank_to_null(defendant)
    return F.when(p.isNotNull() & d.isNotNull(), F.concat(p, F.lit(" v. "), d)).otherwise(F.coalesce(p, d))


def title_or_chapter(title: Column, chapter: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit(0)), chapter)


#: Of the frequent families: all components in one match of the whole citation. Names of the groups, and their pattern.
ONE_PASS = {
    "P01": (("plaintiff", "defendant", "volume", "reporter", "start_page", "pincite", "court", "year"), rf"(.*?) v\. (.*?),\s+([0-9]+)\s+({G.REP})\s+([0-9]+)(?:, ({G.PIN}))?(?:\s+\((?:([^()]*)\s)?([0-9]{{4}})\))?"),
    "P09": (("title", "code", "section", "subsection", "year"), rf"([0-9]+)\s+(U\.S\.C\.)\s+(?:§§?\s*)?({G.SECTION})({G.SUBSECTIONS}*)(?:\s+\(([0-9]{{4}})\))?"),
    "P14": (("title", "code", "section", "subsection", "year"), rf"([0-9]+)\s+(C\.F\.R\.)\s+(?:§§?\s*|pt\. )?({G.SECTION})({G.SUBSECTIONS}*)(?:\s+\(([0-9]{{4}})\))?"),
    "P24": (("source_name", "volume", "reporter", "pincite"), rf"(.*?), ([0-9]+)\s+({G.REP})\s+at\s+({G.PIN})"),
    "P25": (("volume", "reporter", "pincite"), rf"([0-9]+)\s+({G.REP})\s+at\s+({G.PIN})"),
    "P26": (("source_name", "pincite"), rf"(?:(.*?), )?supra(?: note [0-9]+)?(?:,? at ({G.PIN}))?"),
    "P23": (("pincite",), rf"[Ii]d\.(?:,? at ({G.PIN}))?"),
    "P19": (("author", "work_title", "volume", "journal", "start_page", "pincite", "year"), rf"([^,]+), (.+?), ([0-9]+) ([A-Z][\w.&' ]*?(?:L\. Rev\.|L\.J\.|J\.L\.|Rev\.)) ([0-9]+)(?:, ({G.PIN}))? \(([0-9]{{4}})\)"),
}
_YEAR = (r"([0-9]{4})\)\s*$",)
_LAW = {
    "title": (r"^([0-9]+)\s",),
    "code": (r"(U\.S\.C\.|C\.F\.R\.|Fed\. Reg\.)", r"^([A-Z][^§]*?(?:Code|Law|Laws|Stat\.|Const\.)(?: Ann\.)?)"),
    "section": (rf"§§?\s*({G.SECTION})", rf"(?:U\.S\.C\.|C\.F\.R\.)\s+(?:pt\. )?({G.SECTION})", r"Fed\. Reg\. ([0-9,]+)"),
    "subsection": (rf"({G.SUBSECTIONS}+)(?:\s|$)",),
    "year": (r"\(([0-9]{4})\)\s*$",),
}
_SHORT_PIN = (rf"\bat ({G.PIN})\s*$",)
#: Of the others, by type: for each component the patterns to try, the first group of the first that is found.
BY_TYPE = {
    "case": {"plaintiff": (r"^(.*?) v\. ",), "defendant": (r" v\. (.*?),\s+[0-9]",), "volume": (VOL_REP_PAGE,), "reporter": (rf"[0-9]+\s+({G.REP})\s+(?:at\s+)?[0-9]+",), "start_page": (rf"[0-9]+\s+{G.REP}\s+(?:at\s+)?([0-9]+)",), "pincite": (rf"{G.REP}\s+[0-9]+, ({G.PIN})",), "court": (r"\(([^()]*)[0-9]{4}\)\s*$",), "year": _YEAR},
    "statute": _LAW,
    "regulation": _LAW,
    "rule": {"rule_set": (r"^(.*?)\s*[0-9]",), "rule_number": (r"([0-9]+(?:\.[0-9]+)?(?:[-–][0-9]+)?)",)},
    "secondary": {
        "author": (r"^[0-9]+ ([^,]+),", r"^([A-Z][^,]*), "),
        "work_title": (r"^(Restatement \([A-Za-z]+\) of [A-Z][\w ]*?) §", r"^[0-9]+ [^,]+, ([^§]+?) §", r"^[^,]+, (.+?), [0-9]+ [A-Z]"),
        "url": (r"((?:https?://|www\.)\S+)",),
        "year": _YEAR,
        "section": (rf"§ ({G.SECTION})",),
    },
    "short_case": {"source_name": (r"^(.*?), [0-9]+\s",), "volume": (VOL_REP_PAGE,), "reporter": (rf"[0-9]+\s+({G.REP})\s+(?:at\s+)?[0-9]+",), "pincite": _SHORT_PIN},
    "supra": {"source_name": (r"^(.*?), supra",), "pincite": _SHORT_PIN},
    "id": {"pincite": _SHORT_PIN},
}
_WHOLE = {f: (names, re.compile(p, re.ASCII)) for f, (names, p) in ONE_PASS.items()}
_TRIED = {t: {n: [re.compile(p, re.ASCII) for p in ps] for n, ps in fields.items()} for t, fields in BY_TYPE.items()}
_INTEGER = re.compile(r"[+-]?[0-9]+")
_SPACES = re.compile(r"\s+", re.ASCII)
_AT = re.compile(r"^[at ]+")
_DASH = str.maketrans("–—", "--")


def _int(text: str | None) -> int | None:
    t = (text or "").strip(" ")
    return int(t) if _INTEGER.fullmatch(t) and abs(int(t)) < 1 << 31 else None


def _pages(text: str | None) -> list[int]:
    """The rule of `text.pincites`."""
    firsts = [_int(_AT.sub("", x.strip(" ")).split("-")[0]) for x in (text or "").translate(_DASH).split(",")]
    return [n for n in firsts if n is not None]


@lru_cache(1 << 16)
def parts_of(citation: str, family: str, kind: str) -> tuple:
    """The components of a citation, in the order of FIELDS."""
    names, pattern = _WHOLE.get(family, ((), None))
    whole = pattern.fullmatch(citation) if pattern else None
    if whole:
        got = dict(zip(names, whole.groups()))
    elif family in ("P30", "P23"):
        got = {}
    else:
        hits = {n: next((m for m in (p.search(citation) for p in ps) if m), None) for n, ps in _TRIED.get(kind, {}).items()}
        got = {n: m[1] for n, m in hits.items() if m}
    got = {n: v.strip(" ") if n in ("code", "court", "rule_set") else v for n, v in got.items() if v and v.strip(" ")}
    sides = [got[n] for n in ("plaintiff", "defendant") if n in got]
    if sides:
        got["source_name"] = " v. ".join(sides)
    if "reporter" in got:
        got["reporter"] = _SPACES.sub(" ", got["reporter"])
    return tuple(_pages(got.get(n)) if n == "pincite" else _int(got.get(n)) if n in _INTS else got.get(n) or None for n in FIELDS)


def components(found: DataFrame) -> DataFrame:
    """Mentions with the columns of FIELDS, each null where its type has no such thing, pincite never null."""
    keep = [c for c in found.columns if c not in FIELDS]
    schema = T.StructType([found.schema[c] for c in keep])
    kinds = []
    for n in FIELDS:
        schema = schema.add(n, T.ArrayType(T.IntegerType()) if n == "pincite" else T.IntegerType() if n in _INTS else T.StringType())
        kinds.append(pa.list_(pa.int32()) if n == "pincite" else pa.int32() if n in _INTS else pa.string())

    def run(batches):
        for batch in batches:
            rows = list(map(parts_of, *(batch.column(c).to_pylist() for c in ("full_citation", "family", "type"))))
            cols = list(zip(*rows)) or [()] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[*keep, *FIELDS])

    return found.select(*keep).mapInArrow(run, schema)


def reclassified(found: DataFrame) -> DataFrame:
    """Law citations get the type of their code."""
    law = F.col("type").isin("statute", "regulation")
    return found.withColumn("type", F.when(law & F.col("code").isin("C.F.R.", "Fed. Reg."), "regulation").when(law & F.col("code").contains("Const."), "constitutional").otherwise(F.col("type")))


def dispatched(found: DataFrame) -> DataFrame:
    """Types outside the closed list (of families that a caller adds) become `other`, with the type as `class`."""
    known = F.col("type").isin(*sorted(G.TYPES))
    return found.withColumn("class", F.when(~known, F.col("type"))).withColumn("type", F.when(known, F.col("type")).otherwise("other"))


# ---- one row for each thing cited


def split_subsections(found: DataFrame) -> DataFrame:
    """`§§ 315(a), (d), and (e)` as one row for each subsection; other rows as they are, part 0."""
    c = F.col("full_citation")
    group = F.when(F.col("family") == "P28", F.regexp_extract_all(F.regexp_extract(c, rf"§§\s*{G.SECTION}(.*)$", 1), F.lit(rf"({G.SUBSECTIONS}+)"), F.lit(1)))
    rows = found.select("*", F.posexplode_outer(group).alias("_i", "_sub"))
    return rows.withColumn("part", F.coalesce("_i", F.lit(0))).withColumn("subsection", F.coalesce("_sub", F.col("subsection"))).drop("_i", "_sub")


def split_rules(found: DataFrame) -> DataFrame:
    """`Rules 413-415` as one row for each rule."""
    ends = F.split(F.regexp_replace("rule_number", "–", "-"), "-")
    low, high = X.to_int(ends[0]), X.to_int(F.get(ends, 1))
    numbers = F.when((F.col("type") == "rule") & high.isNotNull() & (high >= low), F.transform(F.sequence(low, high), lambda x: x.cast("string")))
    return found.withColumn("rule_number", F.explode(F.coalesce(numbers, F.array("rule_number"))))


def popular_names() -> Column:
    return F.create_map(*[F.lit(x) for kv in G.POPULAR_NAMES.items() for x in kv])


def informal_constitution(c: Column) -> Column:
    """`First Amendment` -> `U.S. Const. amend. I`; `Article III` -> `U.S. Const. art. III`."""
    numerals = F.create_map(*[F.lit(x) for kv in zip(G.ORDINALS, G.ROMAN) for x in kv])
    return F.coalesce(F.concat(F.lit("U.S. Const. amend. "), numerals[part(c, r"^(.+) Amendment$")]), F.concat(F.lit("U.S. Const. art. "), part(c, r"^Article ([IVX]+)$")))


# ---- enrichment


def with_gap_pass(grammar: DataFrame, gaps: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The grammar's mentions, and those of the gap pass that overlap none of them."""
    g = grammar.select(F.col(doc).alias("_d"), F.col("span_start").alias("_s"), F.col("span_end").alias("_e"))
    new = gaps.join(g, (F.col(doc) == F.col("_d")) & (F.col("span_start") < F.col("_e")) & (F.col("span_end") > F.col("_s")), "left_anti")
    return grammar.unionByName(new, allowMissingColumns=True)


def signal(lead: Column) -> Column:
    """Name of the signal that ends the text before a citation, or `none`."""
    before = F.lower(F.right(lead, F.lit(30)))
    out = F.lit("none")
    for words, name in reversed(G.SIGNALS.items()):
        out = F.when(before.rlike(r"(?:^|[^a-z])" + words.replace(".", r"\.").replace(" ", r"\s+") + r"\s*$"), name).otherwise(out)
    return out


def history(tail: Column) -> Column:
    """Subsequent history at the beginning of the text behind a citation."""
    return part(tail, rf"^,? ({G.HISTORY})")


def repaired_subsection(tail: Column, subsection: Column) -> Column:
    """A statute's subsection, or the one that the text behind it begins with."""
    return F.coalesce(subsection, part(tail, rf"^\s?({G.SUBSECTIONS}+)"))


def parenthetical_kind(c: Column) -> Column:
    """What a parenthetical does: its verb decides on an own entry, a flag or an attribute."""
    verb = F.lower(F.regexp_extract(c, r"^\(?\s*([A-Za-z]+)", 1))
    return F.when(verb == "quoting", "entry").when(verb.isin("citing", "discussing", "applying", "overruling"), "flag").when(verb == "holding", "attribute").otherwise("none")


def proposition(lead: Column) -> Column:
    """The words of a citation's sentence that come before it, without signal; those of the sentence before if there are none."""
    pieces = F.split(lead, X.SENTENCE, -1)
    own = F.trim(F.regexp_replace(F.element_at(pieces, -1), r"(?i)(?:see generally|see, e\.g\.,|see also|but see|but cf\.|see|cf\.|accord|contra)\s*$", ""))
    return F.trim(F.coalesce(X.blank_to_null(own), F.try_element_at(pieces, F.lit(-2))))


ENTRY, ATTRIBUTE, DESCRIBES = "quoting", "holding", ("citing", "discussing", "applying", "overruling")


def parentheticals(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Mentions (with verb and follows) with parent_idx, own_entry, flagged and holding.

    What a `quoting` parenthesis holds is cited by the document itself; what one of DESCRIBES holds is
    not, and is flagged. parent_idx is the last citation before that stands in no such parenthesis.
    """
    inside = F.col("verb").isin(ENTRY, *DESCRIBES)
    before = Window.partitionBy(doc).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.last(F.when(~F.coalesce(inside, F.lit(False)), F.col("idx")), ignorenulls=True).over(before)
    holding = part(F.col("follows"), r"(?is)^\(holding (?:that )?(.*)\)$")
    return found.withColumns({"parent_idx": F.when(inside, parent), "own_entry": ~F.coalesce(F.col("verb").isin(*DESCRIBES), F.lit(False)), "flagged": F.coalesce(F.col("verb").isin(*DESCRIBES), F.lit(False)), "holding": holding})


def bare_sections(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Components with what a bare `§ 230` stands for: title, code and subsection of the nearest specific citation of its section.

    Specific is a statute with its code and subsection; the last one before counts, else the first one
    after. A bare section that has no subsection of its own and finds none is `ambiguous`.
    """
    bare = F.col("family") == "P29"
    specific = F.when((F.col("type") == "statute") & ~bare & F.col("code").isNotNull() & F.col("subsection").isNotNull(), F.struct("title", "code", "subsection"))
    order = Window.partitionBy(doc, "section").orderBy("idx")
    before = F.last(specific, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(specific, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    near = found.withColumn("_near", F.when(bare, F.coalesce(before, after)))
    filled = {c: F.coalesce(F.col(c), F.col(f"_near.{c}")) for c in ("title", "code", "subsection")}
    return near.withColumns(filled).withColumn("ambiguous", bare & F.col("subsection").isNull()).drop("_near")


#: Later treatment that takes away from an authority.
NEGATIVE = r"rev['’]d|vacated|overruled|abrogated by"


def with_flags(found: DataFrame) -> DataFrame:
    """Mentions with `flags`, names of all that is uncertain, by the columns that are there.

    Of resolution: flags. Of bare_sections: ambiguous. Of parentheticals: flagged. Of context: lead
    (a citation without a proposition) and tail (negative history).
    """
    has = set(found.columns)
    c = F.col
    checks = [
        ("informal_reference", c("family").isin("P07", "P11", "P27")),
        ("ambiguous_proposition", X.blank_to_null(proposition(c("lead"))).isNull() if "lead" in has else None),
        ("ambiguous_section_reference", c("ambiguous") if "ambiguous" in has else None),
        ("uncertain_category", c("type").isin("unknown", "other")),
        ("citing_parenthetical", c("flagged") if "flagged" in has else None),
        ("subsequent_negative_history", F.coalesce(history(c("tail")).rlike(f"^(?:{NEGATIVE})$"), F.lit(False)) if "tail" in has else None),
    ]
    own = flags(*[(n, x) for n, x in checks if x is not None])
    return found.withColumn("flags", F.array_sort(F.array_distinct(F.concat(c("flags"), own))) if "flags" in has else F.array_sort(own))


def short_label(source_name: Column, citation: Column) -> Column:
    """First party of a case, without what follows a comma; anything else as cited."""
    return F.coalesce(X.blank_to_null(F.regexp_extract(source_name, r"^(.*?)(?:,| v\. |$)", 1)), citation)


LEVELS = (("U.S.", "scotus"), ("S. Ct.", "scotus"), ("L. Ed.", "scotus"), ("F. Supp.", "district"), ("F.4th", "circuit"), ("F.3d", "circuit"), ("F.2d", "circuit"), ("F. App", "circuit"))


def authority_level(type_: Column, reporter: Column) -> Column:
    out = F.when(type_.isin("case", "short_case"), "other").when(type_ == "secondary", "secondary").when(type_ == "regulation", "agency").otherwise("other")
    for begin, level in reversed(LEVELS):
        out = F.when(reporter.startswith(begin), level).otherwise(out)
    return out


def case_key(volume: Column, reporter: Column, page: Column) -> Column:
    return F.concat_ws(" ", volume.cast("string"), reporter, page.cast("string"))


def flags(*conditions: tuple[str, Column]) -> Column:
    """Names of the conditions that hold, never null."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions]))
