"""Statute and regulation text: addresses, anchors, section extraction and the status of a request.

Fetching is a join with an input table of pages; nothing here goes to a network.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text as X

LEAST_BODY = 80
BASE = "https://www.law.cornell.edu"


def resolve_url(type_: Column, title: Column, section: Column) -> Column:
    """Address of a section, or null for other types and blank parts."""
    t, s = F.trim(title.cast("string")), F.trim(section.cast("string"))
    known = (F.length(t) > 0) & (F.length(s) > 0)
    return F.when(known & (type_ == "statute"), F.concat(F.lit(f"{BASE}/uscode/text/"), t, F.lit("/"), s)).when(known & (type_ == "regulation"), F.concat(F.lit(f"{BASE}/cfr/text/"), t, F.lit("/"), s))


def anchor(subsection: Column) -> Column:
    """`(c)(2)` -> `c_2`; text without parentheses as it is; null if nothing is left."""
    inner = F.filter(F.transform(F.regexp_extract_all(subsection, F.lit(r"\(([^)]+)\)"), F.lit(1)), F.trim), lambda x: x != "")
    bare = X.blank_to_null(F.trim(subsection))
    return F.when(F.size(inner) > 0, F.array_join(inner, "_")).when(~subsection.contains("("), bare)


# What a container's class holds, and how the two kinds of pages mark an anchor.
CONTAINERS = ("subsection", "paragraph", "psection")
ANCHOR_SPAN = "enumxml"


class _Sections(HTMLParser):
    """Text of the divs whose class tokens hold `section`, and of one anchor's container.

    Anchors are `<a name>` and `<span class="enumxml" id>`. The container is the innermost open div or p
    whose class has one of CONTAINERS in it when the anchor comes; without one the rest of the section
    is taken. Any closing div or p ends the innermost open one.
    """

    def __init__(self, anchor: str | None):
        super().__init__(convert_charrefs=True)
        self.anchor = anchor
        self.open: list[bool] = []  # of the elements open in the section, whether each is a container
        self.end: int | None = None  # the part goes on while more elements than this are open
        self.section: list[str] = []
        self.sub: list[str] = []
        self.hit = False

    def handle_starttag(self, tag, attrs):
        got = {}
        for k, v in attrs:
            got.setdefault(k, v or "")
        css = got.get("class", "")
        if not self.open:
            if tag == "div" and "section" in css.split():
                self.open.append(any(x in css for x in CONTAINERS))
        elif tag in ("div", "p"):
            self.open.append(any(x in css for x in CONTAINERS))
        elif self.anchor and not self.hit and self.anchor == (got.get("name") if tag == "a" else got.get("id") if tag == "span" and ANCHOR_SPAN in css.split() else None):
            self.hit = True
            self.end = next((i for i in reversed(range(len(self.open))) if self.open[i]), 0)

    def handle_endtag(self, tag):
        if tag in ("div", "p") and self.open:
            self.open.pop()
            if self.end is not None and len(self.open) <= self.end:
                self.end = None

    def handle_data(self, data):
        if self.open:
            self.section.append(data)
            if self.end is not None:
                self.sub.append(data)


def extract_section(html: str | None, wanted: str | None) -> tuple[str, str | None, bool]:
    """(section text, subsection text, anchor found), white space collapsed, entities decoded."""
    parser = _Sections(wanted)
    parser.feed(html or "")
    parser.close()
    join = lambda x: " ".join("".join(x).split())
    return join(parser.section), join(parser.sub) if parser.hit else None, parser.hit


EXTRACTED = "body string, part string, anchor_hit boolean"


def extracted(df: DataFrame, html: str = "html", wanted: str = "anchor") -> DataFrame:
    """df with body, part and anchor_hit of its pages, in Arrow batches."""
    names = [x.split()[0] for x in EXTRACTED.split(", ")]
    keep = [c for c in df.columns if c not in names]

    def run(batches):
        for batch in batches:
            cols = list(zip(*map(extract_section, batch.column(html).to_pylist(), batch.column(wanted).to_pylist()))) or [()] * 3
            kinds = [pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[*keep, *names])

    schema = df.select(*keep).schema
    for x in EXTRACTED.split(", "):
        schema = schema.add(*x.split())
    return df.select(*keep).mapInArrow(run, schema)


def status(url: Column, http: Column, body: Column, asked: Column, hit: Column) -> Column:
    """First that holds: incomplete or failed -> network_error, absent or empty -> not_found, anchor missing, ok."""
    return (
        F.when(url.isNull() | http.isNull(), "network_error").when(http == 404, "not_found").when(http >= 400, "network_error")
        .when(F.length(F.coalesce(body, F.lit(""))) < LEAST_BODY, "not_found").when(asked.isNotNull() & ~hit, "anchor_not_found").otherwise("ok")
    )


def fetch(requests: DataFrame, pages: DataFrame, retrieved_at: str | None = None) -> DataFrame:
    """requests (id, type, title, section, subsection) against pages (url, http_status, html): one result for each request."""
    asked = requests.withColumn("url", resolve_url(F.col("type"), F.col("title"), F.col("section"))).withColumn("anchor", anchor(F.col("subsection")))
    joined = asked.join(pages.withColumnRenamed("url", "_url"), F.col("url") == F.col("_url"), "left").drop("_url")
    got = extracted(joined)
    state = status(F.col("url"), F.col("http_status"), F.col("body"), F.col("anchor"), F.col("anchor_hit"))
    error = (
        F.when(F.col("url").isNull(), "unsupported_or_incomplete_entry").when(F.col("http_status").isNull(), "no_response").when(F.col("http_status") == 404, "http_404")
        .when(F.col("http_status") >= 400, F.concat(F.lit("http_"), F.col("http_status").cast("string"))).when(F.col("status") == "not_found", "empty_section_body")
    )
    named = got.withColumn("status", state).withColumn("error", error)
    found = F.col("status").isin("ok", "anchor_not_found")
    flags = F.array_compact(F.array(F.when(F.col("status") == "not_found", "source_not_found"), F.when(F.col("status") == "anchor_not_found", "anchor_not_found")))
    return named.select(
        "id", "status", "url", "anchor", F.coalesce(F.col("anchor").isNotNull() & F.col("anchor_hit") & found, F.lit(False)).alias("anchor_matched"), F.when(found, F.col("body")).alias("section_text"), F.when(F.col("status") == "ok", F.col("part")).alias("subsection_text"),
        F.lit(retrieved_at).cast("timestamp").alias("retrieved_at"), "error", flags.alias("flags"),
    )
