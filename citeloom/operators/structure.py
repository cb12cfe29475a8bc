"""Document structure: body sections, pages, footnotes, and where a mention stands."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions import text as X

# Headings of the body and of the parts around it.
BODY = ("INTRODUCTION", "ARGUMENT", "STATEMENT OF THE CASE", "STATEMENT OF FACTS", "CONCLUSION")
AROUND = ("TABLE OF CONTENTS", "TABLE OF AUTHORITIES", "CERTIFICATE OF SERVICE", "CERTIFICATE OF COMPLIANCE", "CORPORATE DISCLOSURE STATEMENT", "APPENDIX", "SIGNATURE")
HEADING = r"^\s*(?:[IVX]+\.\s+)?(" + "|".join(BODY + AROUND) + r")\s*$"
ROMAN_PAGE = r"^\s*[ivxlc]+\s*$"


def lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, line_no from 0, line, and start, its offset."""
    parts = F.split(text, "\n", -1)
    rows = docs.select(doc, F.posexplode(parts).alias("line_no", "line"))
    order = Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(order), F.lit(0)).cast("int"))


def with_sections(line_rows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Lines with the heading they stand under and that section's number."""
    order = Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = X.empty_to_null(F.regexp_extract("line", HEADING, 1))
    named = line_rows.withColumn("_h", head)
    return named.withColumn("heading", F.last("_h", ignorenulls=True).over(order)).withColumn("section_no", F.count("_h").over(order)).withColumn("is_heading", F.col("_h").isNotNull()).drop("_h")


def body(sectioned: DataFrame) -> DataFrame:
    """Lines of the body, without front and back matter and lone roman page numbers."""
    return sectioned.filter(F.col("heading").isin(*BODY) & ~F.col("line").rlike(ROMAN_PAGE))


def body_text(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc and the text of its body lines."""
    kept = body(with_sections(lines(docs, doc, text), doc)).filter(~F.col("is_heading"))
    return kept.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("x")).select(doc, F.array_join(F.transform("x", lambda y: y["line"]), "\n").alias(text))


def section_ranges(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, section_no, heading, page_start, page_end by `## PAGE n` lines."""
    order = Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    page = F.regexp_extract("line", r"^## PAGE ([0-9]+)$", 1).try_cast("int")
    rows = with_sections(lines(docs, doc, text), doc).withColumn("page", F.last(page, ignorenulls=True).over(order))
    return rows.filter("heading IS NOT NULL").groupBy(doc, "section_no", "heading").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"))


def section_of(mentions: DataFrame, ranges: DataFrame, doc: str = "doc_id") -> DataFrame:
    """mentions with the heading of their page; of several the one that starts last.

    A document's ranges follow one another, so the last that starts at or before a page is the only
    one that can hold it: one window over both, ordered by page, instead of a join on ranges.
    """
    own = [c for c in mentions.columns if c != "heading"]
    r = ranges.select(doc, F.col("page_start").alias("_at"), F.col("section_no").alias("_n"), F.struct("heading", "page_end").alias("_r")).filter("_at IS NOT NULL")
    rows = mentions.select(*own).withColumn("_at", F.col("page")).withColumn("_n", F.lit(None).cast("long")).withColumn("_own", F.lit(True))
    both = rows.unionByName(r, allowMissingColumns=True)
    before = Window.partitionBy(doc).orderBy(F.col("_at").asc_nulls_first(), F.col("_n").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("_last", F.last("_r", ignorenulls=True).over(before)).filter("_own")
    return hit.select(*own, F.when(F.col("page") <= F.col("_last.page_end"), F.col("_last.heading")).alias("heading"))


def pages(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, page, start, end, text of each page, in one pass over each text."""
    schema = T.StructType([docs.schema[doc]]).add("page", "integer").add("start", "integer").add("end", "integer").add("text", "string")

    def run(batches):
        for batch in batches:
            for i, t in enumerate(batch.column(text).to_pylist()):
                found = X.page_list(t or "")
                if found:
                    page, start, end = zip(*found)
                    own = batch.column(doc).take(pa.array([i] * len(found), pa.int64()))
                    yield pa.RecordBatch.from_arrays([own, *[pa.array(c, pa.int32()) for c in (page, start, end)], pa.array([t[a:b] for a, b in zip(start, end)], pa.string())], names=[doc, "page", "start", "end", "text"])

    return docs.select(doc, text).mapInArrow(run, schema)


def straddling(mentions: DataFrame, page_rows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, idx and `pages`, all that a mention's span touches; mentions that touch none have no row.

    Pages of a document do not overlap, so those a span touches lie side by side: two binary searches
    for each mention instead of a join on ranges.
    """

    def touched(m: pa.Table, p: pa.Table) -> pa.Table:
        start, end, page = (p.column(c).to_numpy() for c in ("start", "end", "page"))
        order = np.argsort(start, kind="stable")
        start, end, page = start[order], end[order], page[order]
        first = np.searchsorted(end, m.column("span_start").to_numpy(), "right")
        last = np.searchsorted(start, m.column("span_end").to_numpy(), "left")
        hit = np.flatnonzero(last > first)
        lists = [sorted(set(page[first[i] : last[i]].tolist())) for i in hit]
        return pa.table({doc: m.column(doc).take(pa.array(hit)), "idx": m.column("idx").take(pa.array(hit)), "pages": pa.array(lists, pa.list_(pa.int32()))})

    schema = T.StructType([mentions.schema[doc], mentions.schema["idx"]]).add("pages", T.ArrayType(T.IntegerType()))
    left = mentions.select(doc, "idx", "span_start", "span_end").groupBy(doc)
    return left.cogroup(page_rows.select(doc, "page", "start", "end").groupBy(doc)).applyInArrow(touched, schema)


def with_footnotes(body_rows: DataFrame, notes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Body texts and footnote texts (doc, footnote_id, text) of kept documents, one row each."""
    kept = notes.join(body_rows.select(doc).distinct(), doc, "left_semi")
    return body_rows.withColumn("footnote_id", F.lit(None).cast("string")).unionByName(kept.select(doc, "text", "footnote_id"))


def inline_footnotes(paragraph: Column, refs: Column, notes: Column) -> Column:
    """A paragraph with its notes at its end, `[FNid: text]`, empty where the note is missing."""
    rendered = F.transform(refs, lambda r: F.concat(F.lit("[FN"), r, F.lit(": "), F.coalesce(notes[r], F.lit("")), F.lit("]")))
    return F.concat_ws(" ", paragraph, F.array_join(rendered, " "))
