"""Tables of authorities: grouping of resolved mentions, categories, order, passim, rendering, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.grammar import ROMAN as _ROMAN
from citeloom.operators.extract import part

# The seven categories in their order.
CATEGORIES = ("Cases", "Administrative Decisions", "Constitutional Provisions", "Statutes", "Rules and Regulations", "Legislative Materials", "Other Authorities")

# What courts think of passim.
COURT_RULES = {"SCOTUS": "never", "D.C. Circuit": "never", "9th Circuit": "discouraged", "Other": "allowed"}

PASSIM_PAGES = 5


def category(type_: Column, family: Column) -> Column:
    """One of the seven, or Other Authorities (see `uncertain`)."""
    return (
        F.when(family == "P03", CATEGORIES[1]).when(type_ == "case", CATEGORIES[0]).when(type_ == "constitutional", CATEGORIES[2]).when(type_ == "statute", CATEGORIES[3])
        .when(type_.isin("rule", "regulation"), CATEGORIES[4]).when(type_ == "legislative", CATEGORIES[5]).otherwise(CATEGORIES[6])
    )


def uncertain(type_: Column) -> Column:
    return ~type_.isin("case", "constitutional", "statute", "rule", "regulation", "legislative", "secondary")


def rank_of(category_: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CATEGORIES)), category_).cast("int")


def without_pinpoint(citation: Column, type_: Column) -> Column:
    """A case with its start page only; anything else as cited."""
    return F.when(type_ == "case", F.regexp_replace(citation, r"^(.*?, [0-9]+ [A-Z][A-Za-z0-9.' ]*? [0-9]+), [0-9][0-9,\-–— n.]*( \(|$)", "$1$2")).otherwise(citation)


def authorities(resolved: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """A row for each document and authority: citation, category, pages (sorted, distinct), short forms, mentions."""
    used = resolved.filter("authority_key IS NOT NULL")
    full = F.when(~F.col("type").isin("short_case", "supra", "id"), F.struct("idx", "full_citation", "type", "family"))
    short = F.when(F.col("type").isin("short_case", "supra", "id"), F.struct("idx", "full_citation"))
    grouped = used.groupBy(doc, "authority_key").agg(F.min(full).alias("f"), F.sort_array(F.collect_set(page)).alias("pages"), F.sort_array(F.collect_list(short)).alias("s"), F.count(F.lit(1)).alias("n_mentions"))
    return grouped.select(doc, "authority_key", without_pinpoint(F.col("f.full_citation"), F.col("f.type")).alias("citation"), F.col("f.type").alias("type"), category(F.col("f.type"), F.col("f.family")).alias("category"), "pages", F.array_distinct(F.transform("s", lambda x: x["full_citation"])).alias("short_forms_found"), "n_mentions", uncertain(F.col("f.type")).alias("uncertain_category"))


def passim(pages: Column, rule: Column) -> Column:
    """`passim` where the court allows it and pages are many; otherwise the pages, in doubt too."""
    return F.when((rule == "allowed") & (F.size(pages) >= PASSIM_PAGES), "passim").otherwise(F.array_join(F.transform(pages, lambda p: p.cast("string")), ", "))


def with_court_rule(df: DataFrame, court: str = "court") -> DataFrame:
    rules = F.create_map(*[F.lit(x) for kv in COURT_RULES.items() for x in kv])
    return df.withColumn("rule", F.coalesce(rules[F.col(court)], F.lit("unknown")))


def sort_keys(citation: Column, category_: Column) -> list[Column]:
    """Within a category: name, or federal first with title and section as numbers; amendments by number."""
    federal = F.when(category_.isin(CATEGORIES[2], CATEGORIES[3]), F.when(citation.contains("U.S."), 0).otherwise(1)).when(category_ == CATEGORIES[4], F.when(citation.contains("C.F.R."), 1).when(citation.contains("Fed. Reg."), 2).otherwise(0)).otherwise(0)
    law = category_.isin(CATEGORIES[3], CATEGORIES[4])
    title = F.when(law, part(citation, r"^([0-9]+) ").try_cast("int"))
    section = F.when(law, part(citation, r"§+ ?([0-9]+)").try_cast("int"))
    roman = part(citation, r"(?:amend|art)\. ([IVX]+)")
    amendment = F.when(category_ == CATEGORIES[2], F.array_position(F.array(*map(F.lit, _ROMAN)), roman))
    return [federal, F.coalesce(title, F.lit(0)), F.coalesce(section, F.lit(0)), F.coalesce(amendment, F.lit(0)), F.lower(citation), citation]




def ordered(toa: DataFrame, doc: str = "doc_id") -> DataFrame:
    """toa with cat_rank and position, 1 for a document's first authority."""
    order = Window.partitionBy(doc).orderBy("cat_rank", *sort_keys(F.col("citation"), F.col("category")))
    return toa.withColumn("cat_rank", rank_of(F.col("category"))).withColumn("position", F.row_number().over(order))


def text_line(citation: Column, pages: Column, width: int = 78) -> Column:
    """Citation, dot leaders and right-aligned pages; a long citation keeps three dots."""
    dots = F.greatest(F.lit(3), F.lit(width - 2) - F.length(citation) - F.length(pages))
    return F.concat(citation, F.lit(" "), F.repeat(F.lit("."), dots), F.lit(" "), pages)


def rendered(toa: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, text: category headings, each followed by its lines in order; empty categories vanish."""
    line = F.when(F.col("first"), F.concat(F.upper("category"), F.lit("\n"), F.col("line"))).otherwise(F.col("line"))
    first = F.row_number().over(Window.partitionBy(doc, "category").orderBy("position")) == 1
    lines = toa.withColumn("first", first).withColumn("l", line)
    return lines.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("position", "l"))).alias("x")).select(doc, F.array_join(F.transform("x", lambda y: y["l"]), "\n").alias("text"))


def violations(toa: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Rows that break the checklist: pages repeated or unsorted, category unknown, passim not allowed, order."""
    order = Window.partitionBy(doc).orderBy("position")
    checks = {
        "duplicate_pages": F.size("pages") != F.size(F.array_distinct("pages")),
        "unsorted_pages": F.col("pages") != F.array_sort("pages"),
        "no_pages": F.size("pages") == 0,
        "unknown_category": F.col("cat_rank") == 0,
        "category_order": F.lag("cat_rank").over(order) > F.col("cat_rank"),
        "passim_not_allowed": (F.col("page_text") == "passim") & (F.col("rule") != "allowed"),
    }
    named = toa.withColumn("broken", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()])))
    return named.filter(F.size("broken") > 0)
