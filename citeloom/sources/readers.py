"""Sources: text, DOCX, page-marked Markdown, request arrays, opinions, catalogs."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom import schemas
from citeloom.functions import text as X

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path, text: a row for each file, its odd spaces made plain."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), X.plain_spaces(F.col("value")).alias("text"))


def read_markdown_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, page, start, end, text of `## PAGE n` files."""
    from citeloom.operators.structure import pages

    return pages(read_text(spark, path), "path")


def pre_extracted_pages(df: DataFrame) -> DataFrame:
    """PDF text comes as (doc_id, page, text): printed page numbers, roman ones dropped."""
    page = F.trim(F.col("page").cast("string"))
    return df.withColumn("page", X.to_int(page)).filter("page IS NOT NULL")


# ---- DOCX


def _runs(element: ET.Element) -> str:
    """Text of all text runs; deleted text has another tag, inserted text does not."""
    return "".join(t.text or "" for t in element.iter(f"{_W}t"))


def docx_paragraphs(data: bytes) -> list[tuple[int, str, list[str], dict[str, str]]]:
    """(number, text, footnote ids, notes) of each paragraph; empty ones without a footnote go."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml"))
        notes = {}
        if "word/footnotes.xml" in z.namelist():
            for note in ET.fromstring(z.read("word/footnotes.xml")).iter(f"{_W}footnote"):
                notes[note.get(f"{_W}id")] = _runs(note).strip()
    out = []
    for p in body.iter(f"{_W}p"):
        refs = [r.get(f"{_W}id") for r in p.iter(f"{_W}footnoteReference")]
        text = _runs(p)
        if text.strip() or refs:
            out.append((len(out), text, refs, {r: notes[r] for r in refs if r in notes}))
    return out


DOCX = "path string, para_no int, text string, refs array<string>, notes map<string,string>"


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """path, para_no, text, refs, notes: the rows of all paragraphs; unreadable files fail the read."""

    def run(batches):
        for batch in batches:
            rows = [(p, *x) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()) for x in docx_paragraphs(c)]
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([list(v.items()) for v in c] if i == 4 else c, k) for i, (c, k) in enumerate(zip(cols, kinds))], names=["path", "para_no", "text", "refs", "notes"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, DOCX)


def docx_text(paragraphs: DataFrame) -> DataFrame:
    """path, text: paragraphs joined by blank lines, notes at the end of theirs."""
    from citeloom.operators.structure import inline_footnotes

    rows = paragraphs.withColumn("t", F.when(F.size("refs") > 0, F.concat(F.col("text"), inline_footnotes(F.lit(None).cast("string"), F.col("refs"), F.col("notes")))).otherwise(F.col("text")))
    return rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("para_no", "t"))).alias("x")).select("path", F.array_join(F.transform("x", lambda y: y["t"]), "\n\n").alias("text"))


# ---- JSON


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests of JSON arrays; anything else fails the read."""
    return spark.read.schema(schemas.LII_REQUESTS).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_opinions(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """opinion_id, type and the wanted fields of opinion files, one JSON object each."""
    df = spark.read.schema(schemas.OPINIONS).option("multiLine", True).json(path).withColumnRenamed("id", "opinion_id")
    return df.select("opinion_id", "type", *fields) if fields else df


# ---- catalogs


def search(catalog: DataFrame, where: dict[str, object], order: list[str], page: int = 1, size: int = 20) -> DataFrame:
    """One page of the rows that have these values, in a fixed order."""
    for k, v in where.items():
        catalog = catalog.filter(F.col(k) == F.lit(v))
    return catalog.orderBy(*order).offset((page - 1) * size).limit(size)


def choices(catalog: DataFrame, field: str) -> DataFrame:
    return catalog.select(field).distinct()


def describe(catalog: DataFrame) -> list[tuple[str, str]]:
    return catalog.dtypes


def constitution_text(citations: DataFrame, texts: DataFrame) -> DataFrame:
    """citations with the text of their provision, from a table (provision, text) that the user supplies."""
    return citations.join(texts.withColumnRenamed("provision", "_p"), F.col("full_citation") == F.col("_p"), "left").drop("_p")


def allowed(df: DataFrame, case: str) -> DataFrame:
    """Only the fields that a use needs, so that the scan reads no others."""
    fields = {"identity": ["opinion_id", "type"], "text": ["opinion_id", "type", "html_with_citations", "plain_text"], "anchors": ["opinion_id", "html_with_citations"]}[case]
    return df.select(*[f for f in fields if f in df.columns])


def is_blank(c: Column) -> Column:
    return X.blank_to_null(c).isNull()
