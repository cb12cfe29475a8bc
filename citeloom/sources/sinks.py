"""Sinks: JSON arrays, text, Markdown reports, HTML pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text as X

_BLOCK = re.compile(r'(<script[^>]*type="application/json"[^>]*>)(.*?)(</script>)', re.S)


def json_arrays(df: DataFrame, key: str, order: str, columns: list[str] | None = None) -> DataFrame:
    """key, json: each key's rows as a JSON array in the order of a column; non-ASCII text stays."""
    columns = columns or [c for c in df.columns if c != key]
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*columns).alias("r"))))
    return df.groupBy(key).agg(F.to_json(F.transform(rows, lambda x: x["r"]), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    """A line (or several) for each row, each ended by a newline."""
    df.select(column).write.mode("overwrite").text(path)


def inline_html(template: str, payload: str) -> str:
    """A page whose JSON block holds the payload; `</` is escaped so that it cannot end the block."""
    if not _BLOCK.search(template):
        raise ValueError("the template has no JSON block")
    safe = payload.replace("</", "<\\/")
    return _BLOCK.sub(lambda m: m[1] + safe + m[3], template, count=1)


def toa_json(toa: DataFrame, doc: str = "doc_id") -> DataFrame:
    return json_arrays(toa, doc, "position", ["citation", "category", "pages", "short_forms_found"])


# ---- reports


def check_markdown(checks: DataFrame) -> DataFrame:
    """doc_id, text: counts, triage, a block for each citation in document order, appendix of unverifiable ones.

    checks: doc_id, doc_index, citation, label, found, explanation.
    """
    block = F.concat(F.lit("### "), F.col("doc_index").cast("string"), F.lit(". "), F.col("citation"), F.lit("\n"), F.when(F.col("found"), F.concat(F.lit("Support: "), F.col("label"))).otherwise("Unverifiable"), F.coalesce(F.concat(F.lit("\n"), F.col("explanation")), F.lit("")))
    rows = F.sort_array(F.collect_list(F.struct("doc_index", block.alias("block"), "label", "found", "citation")))
    names = ("Strong", "Adequate", "Weak", "Misleading", "Unable")
    x = F.col("x")
    count = lambda n: F.size(F.filter(x, lambda r: r["label"] == n)).cast("string")
    header = F.concat_ws("\n", F.lit("## Summary"), *[F.concat(F.lit(f"- {n}: "), count(n)) for n in names], F.concat(F.lit("- Unverifiable: "), F.size(F.filter(x, lambda r: ~r["found"])).cast("string")))
    urgent = F.concat(*[F.filter(x, f) for f in (lambda r: r["label"] == "Misleading", lambda r: r["label"] == "Weak", lambda r: ~r["found"])])
    first = F.concat_ws("\n", F.lit("## Triage"), F.array_join(F.transform(urgent, lambda r: F.concat(F.lit("- "), r["citation"])), "\n"))
    missing = F.filter(x, lambda r: ~r["found"])
    appendix = F.when(F.size(missing) > 0, F.concat_ws("\n", F.lit("## Unverifiable"), F.array_join(F.transform(missing, lambda r: F.concat(F.lit("- "), r["citation"])), "\n")))
    return checks.groupBy("doc_id").agg(rows.alias("x")).select("doc_id", F.concat_ws("\n\n", header, first, F.array_join(F.transform(x, lambda r: r["block"]), "\n\n"), appendix).alias("text"))


# The blocks of a citation in the report's JSON, with the columns that fill them.
CITATION = {
    "citation": {"full_text": "citation", "short_label": "short_label", "case_key": "case_key", "type": "type", "authority_level": "authority_level", "signal": "signal", "flags": "flags"},
    "location": {"page": "page", "section": "section", "footnote_id": "footnote_id", "snippet": "snippet"},
    "proposition": {"text": "proposition", "ambiguous": "ambiguous", "proposition_group": "proposition_group"},
    "source": {"found": "found", "fetch_path": "fetch_path", "external_url": "external_url", "unverifiable_reason": "unverifiable_reason"},
    "pincite": {"text": "passage", "match_tier_used": "tier", "brief_quote": "brief_quote", "actual_text": "actual_text", "quote_match": "quote_match", "match_phrase": "match_phrase"},
    "support": {"label": "label", "note": "note", "explanation": "explanation", "issues": "issues"},
    "critic": {"status": "critic_status", "reasoning": "critic_reasoning"},
    "subsequent_negative_history": {"treatment": "treatment", "by_case": "by_case", "affects_proposition": "affects"},
}
KINDS = {"page": "int", "flags": "array<string>", "issues": "array<string>", "ambiguous": "boolean", "found": "boolean", "quote_match": "boolean", "affects": "boolean", "tier": "int"}
DOCUMENT = ("filename", "title", "case_no", "format", "pages", "sections", "footnotes", "notes")


def check_json(checks: DataFrame, generated_at: str, documents: DataFrame | None = None) -> DataFrame:
    """doc_id, json: schema_version, generated_at, document and citations in their order.

    checks: doc_id, doc_index, citation, label, found and any of the columns that CITATION names; a block
    none of whose columns is there or set is left out. documents: doc_id and any of DOCUMENT.
    """
    has = set(checks.columns)

    def block(fields: dict[str, str]) -> Column:
        own = [n for n, c in fields.items() if c in has]
        whole = F.struct(*[F.col(fields[n]).cast(KINDS.get(fields[n], "string")).alias(n) for n in own]) if own else F.lit(None).cast("struct<x:string>")
        return F.when(F.coalesce(*[F.col(fields[n]).cast("string") for n in own]).isNotNull(), whole) if own else whole

    named = {c: F.col(c).cast("string") for c in ("precis", "action") if c in has}
    entry = F.struct(F.concat(F.lit("c"), F.col("doc_index").cast("string")).alias("id"), "doc_index", *[block(f).alias(n) for n, f in CITATION.items()], *[c.alias(n) for n, c in named.items()])
    told = checks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("doc_index").alias("_o"), entry.alias("e")))).alias("x"))
    citations = F.transform("x", lambda r: r["e"])
    document = [F.col("doc_id").alias("id")]
    if documents is not None:
        own = [c for c in DOCUMENT if c in documents.columns]
        told = told.join(documents.select("doc_id", *own), "doc_id", "left")
        document += [F.col(c) for c in own]
    return told.select("doc_id", F.to_json(F.struct(F.lit("1.0").alias("schema_version"), F.lit(generated_at).alias("generated_at"), F.struct(*document).alias("document"), citations.alias("citations"))).alias("json"))


def differences(checks: DataFrame, json: DataFrame) -> DataFrame:
    """Entries that only the table or only the report's JSON has, as `side` tells; empty if both say the same."""
    kind = "struct<citations:array<struct<doc_index:int,citation:struct<full_text:string>,support:struct<label:string>>>>"
    told = json.select("doc_id", F.explode(F.from_json("json", kind)["citations"]).alias("c")).select("doc_id", "c.doc_index", F.col("c.citation.full_text").alias("citation"), F.col("c.support.label").alias("label"))
    own = checks.select("doc_id", F.col("doc_index").cast("int").alias("doc_index"), "citation", "label")
    return own.exceptAll(told).withColumn("side", F.lit("table")).unionAll(told.exceptAll(own).withColumn("side", F.lit("report")))


def chain_name(citation: Column, day: Column) -> Column:
    """File name of a chain: slug and date."""
    return F.concat(X.slug(citation), F.lit("-"), F.date_format(day, "yyyy-MM-dd"))


def chain_markdown(hops: DataFrame, ends: DataFrame) -> DataFrame:
    """root, text: summary first, then a line for each hop, then how the chain ends."""
    line = F.concat(F.lit("1. Opinion "), F.col("opinion_id").cast("string"), F.coalesce(F.concat(F.lit(" (from "), F.col("parent").cast("string"), F.lit(")")), F.lit("")))
    body = hops.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("hop_index", line.alias("l")))).alias("x"))
    return body.join(ends, "root").select("root", F.concat_ws("\n\n", F.concat(F.lit("Chain of "), F.col("hops").cast("string"), F.lit(" hops, ends: "), F.col("terminal_reason")), F.array_join(F.transform("x", lambda y: y["l"]), "\n")).alias("text"))


def chain_json(hops: DataFrame) -> DataFrame:
    return json_arrays(hops, "root", "hop_index")
