"""Resolution of short forms against the citations before them in the same document.

Input: mentions with doc, idx and the components of `extract.components`. Short and supra forms are
keyed first, by windows over the citations of the same document and case or party: the last one before.
Then Id. takes the key of the citation before it, by one ordered window. Every window and join is
partitioned by document, and none compares a short form with all citations before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.operators.extract import case_key

FULL = ("case", "statute", "regulation", "rule", "secondary", "constitutional", "legislative")
SHORT = ("short_case", "supra", "id")
NO_AUTHORITY = "(record)"
UNRESOLVED = "(unresolved)"


def full_key() -> Column:
    """What identifies the authority of a full citation, whatever its pincite."""
    c = F.regexp_replace(F.col("full_citation"), r"\s+", " ")
    law = F.concat_ws(" ", F.col("title").cast("string"), "code", "section", "subsection")
    return (
        F.when((F.col("type") == "case") & F.col("reporter").isNotNull(), case_key(F.col("volume"), F.col("reporter"), F.col("start_page")))
        .when(F.col("type").isin("statute", "regulation") & F.col("section").isNotNull(), law)
        .when(F.col("type").isin(*FULL), c)
    )


def party_token(c: Column) -> Column:
    return X.empty_to_null(F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", "")))


def as_of_short(m: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, idx, key) of short cases: the latest earlier case of that volume and reporter that begins at or before the pincite.

    A short form asks each distinct case of its volume (rarely more than one) for its last mention so far.
    """
    case = m.filter("type = 'case' AND reporter IS NOT NULL").select(doc, "idx", "volume", "reporter", "start_page", full_key().alias("key"))
    known = case.select(doc, "volume", "reporter", "start_page", "key").distinct()
    short = m.filter("type = 'short_case' AND volume IS NOT NULL").select(doc, "idx", "volume", "reporter", F.get("pincite", F.lit(0)).alias("_p"))
    asked = short.join(known, [doc, "volume", "reporter"]).filter(F.coalesce(F.col("_p") >= F.col("start_page"), F.lit(True)))
    events = case.select(doc, "key", "idx", F.col("idx").alias("_at")).unionByName(asked.select(doc, "key", "idx", F.lit(None).cast("int").alias("_at")))
    before = Window.partitionBy(doc, "key").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    hit = events.withColumn("_last", F.max("_at").over(before)).filter("_at IS NULL AND _last IS NOT NULL")
    return hit.groupBy(doc, "idx").agg(F.max_by("key", "_last").alias("key"))


def as_of_party(m: DataFrame, kinds: tuple[str, ...] = ("supra",), doc: str = "doc_id") -> DataFrame:
    """(doc, idx, key): the latest earlier case with the named party on either side."""
    sides = F.array_distinct(F.transform(F.split("source_name", r" v\. "), party_token))
    case = m.filter("type = 'case' AND source_name IS NOT NULL").select(doc, "idx", F.explode(sides).alias("_p"), full_key().alias("key"))
    asked = m.filter(F.col("type").isin(*kinds) & F.col("source_name").isNotNull()).select(doc, "idx", party_token(F.col("source_name")).alias("_p"), F.lit(None).cast("string").alias("key"))
    before = Window.partitionBy(doc, "_p").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    events = case.withColumn("_asks", F.lit(False)).unionByName(asked.withColumn("_asks", F.lit(True))).filter("_p IS NOT NULL")
    return events.withColumn("key", F.last("key", ignorenulls=True).over(before)).filter("_asks AND key IS NOT NULL").select(doc, "idx", "key")


def resolve(m: DataFrame, doc: str = "doc_id") -> DataFrame:
    """m with authority_key (null if unresolved), resolved_index, resolved_citation and flags.

    The anchor of a group is its first full citation; every other member, repeated full citations
    too, points to it.
    """
    by_reporter = as_of_short(m, doc).withColumnRenamed("key", "_k1")
    by_party = as_of_party(m, ("supra", "short_case"), doc).withColumnRenamed("key", "_k2")
    keyed = m.join(by_reporter, [doc, "idx"], "left").join(by_party, [doc, "idx"], "left")
    own = F.when(F.col("type") == "non_authority", F.lit(NO_AUTHORITY)).when(F.col("type") == "id", F.lit(None)).otherwise(F.coalesce(full_key(), "_k1", F.when((F.col("type") == "supra") | F.col("volume").isNull(), F.col("_k2")), F.lit(UNRESOLVED)))
    order = Window.partitionBy(doc).orderBy("idx")
    before = F.last("_own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    key = F.coalesce("_own", before)
    keyed = keyed.withColumn("_own", own).withColumn("_key", F.nullif(F.nullif(key, F.lit(UNRESOLVED)), F.lit(NO_AUTHORITY)))
    group = Window.partitionBy(doc, "_key")
    anchor = F.min(F.when(F.col("type").isin(*FULL), F.struct("idx", "full_citation"))).over(group)
    out = keyed.withColumn("_a", anchor).withColumn("_to", F.when(F.col("_key").isNotNull() & (F.col("_a.idx") != F.col("idx")), F.col("_a")))
    short = F.col("type").isin(*SHORT)
    out = out.withColumns({"authority_key": F.col("_key"), "resolved_index": F.col("_to.idx"), "resolved_citation": F.col("_to.full_citation"), "flags": F.array_compact(F.array(F.when(short & F.col("_to").isNull(), "unresolved_short_form"), F.when(F.col("family") == "P27", "informal_reference")))})
    return out.drop("_k1", "_k2", "_own", "_key", "_a", "_to")


def second_pass(m: DataFrame, gaps: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Resolution once more over the citations of both passes, numbered anew in document order."""
    every = m.drop("idx").unionByName(gaps.drop("idx"), allowMissingColumns=True)
    order = Window.partitionBy(doc).orderBy("span_start", F.desc("span_end"))
    return resolve(every.withColumn("idx", F.row_number().over(order) - 1), doc)


def string_groups(m: DataFrame, doc: str = "doc_id") -> DataFrame:
    """m (with `gap`) with group_no: citations between which only a semicolon and signals stand share one; proposition_group if it has several."""
    order = Window.partitionBy(doc).orderBy("span_start")
    linked = F.col("gap").rlike(r"^\s*(?:\([^()]*\))?\s*;\s*(?:[A-Za-z.,]+\s*){0,3}$") & (F.row_number().over(order) > 1)
    numbered = m.withColumn("_fresh", (~F.coalesce(linked, F.lit(False))).cast("int")).withColumn("group_no", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")
    size = F.count(F.lit(1)).over(Window.partitionBy(doc, "group_no"))
    return numbered.withColumn("proposition_group", F.when(size > 1, F.concat(F.lit("group-"), F.col("group_no").cast("string"))))


def unique_citations(m: DataFrame) -> DataFrame:
    """One row for each case to look up."""
    return m.filter("type = 'case' AND reporter IS NOT NULL").select("volume", "reporter", "start_page").distinct()
