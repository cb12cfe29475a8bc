"""Verification of citations: lookup, identity, pages, quotations, labels and reports' columns.

Judgments are columns of input tables or of a registered scorer; nothing here pretends to judge.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import text as X

LABELS = ("Strong", "Adequate", "Weak", "Misleading", "Unable")
CONFIDENCE = {1: "full", 2: "high", 3: "medium", 4: "low"}
NEGATIVE = ("overruled", "abrogated", "limited")

# Where each type of citation is looked up, in order.
SOURCES = {
    "case": ("courtlistener-mcp", "courtlistener-rest", "google-scholar", "justia", "direct-court", "user-provided"),
    "statute": ("lii", "user-provided"),
    "regulation": ("lii", "user-provided"),
    "rule": ("lii", "direct-court", "user-provided"),
    "constitutional": ("local",),
    "secondary": ("user-provided",),
    "legislative": ("user-provided",),
}

# What a signal asks of its authority.
SIGNAL_BARS = {"none": "direct", "see": "clear", "see-also": "additional", "see-eg": "clear", "see-generally": "background", "cf": "analogous", "but-see": "contrary", "but-cf": "contrary-analogous", "contra": "contrary", "accord": "additional", "compare": "comparison", "string-cite-member": "direct"}


# ---- lookup


def lookup(citations: DataFrame, clusters: DataFrame) -> DataFrame:
    """citations (volume, reporter, start_page) with cluster_id and case_name, null where unknown; each asked once."""
    c = clusters.select(F.col("volume").alias("_v"), F.col("reporter").alias("_r"), F.col("page").alias("_p"), "cluster_id", "case_name", "sub_opinions")
    asked = citations.select("volume", "reporter", "start_page").distinct()
    hit = asked.join(c, (F.col("volume") == F.col("_v")) & (F.col("reporter") == F.col("_r")) & (F.col("start_page") == F.col("_p")), "left")
    return hit.drop("_v", "_r", "_p")


def sub_opinions(found: DataFrame, opinions: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """A row for each opinion of each cluster, with the wanted fields only."""
    o = opinions.select("opinion_id", "type", *(fields or []))
    rows = found.select("cluster_id", F.explode("sub_opinions").alias("opinion_id"))
    return rows.join(o, "opinion_id")


def choose_sub_opinion(rows: DataFrame, wanted: Column | None = None) -> DataFrame:
    """One opinion of each cluster: of the wanted kind if the citation says so, else lead, else combined."""
    want = wanted if wanted is not None else F.lit(None).cast("string")
    rank = F.when(F.col("type") == want, 0).when(F.col("type") == "020lead", 1).when(F.col("type") == "010combined", 2).when(F.col("type") == "030concurrence", 3).otherwise(4)
    order = Window.partitionBy("cluster_id").orderBy(rank, "opinion_id")
    return rows.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def identity(cited: DataFrame) -> Column:
    """True where the case that was found has the cited party names."""
    norm = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " ")
    first = F.split(norm(F.col("source_name")), " v ")[0]
    return F.col("cluster_id").isNotNull() & F.coalesce(norm(F.col("case_name")).contains(first), F.lit(False))


def plausible_text(text: Column, party: Column, reporter: Column, page: Column) -> Column:
    """Text has the party, the reporter or the page marker of its citation."""
    return F.coalesce(text.contains(party), F.lit(False)) | F.coalesce(text.contains(reporter), F.lit(False)) | F.coalesce(F.array_contains(X.page_markers(text), page), F.lit(False))


def escalate(attempts: DataFrame) -> DataFrame:
    """doc_id, cite_id, source: the first that worked, or `unverifiable`; and the sources tried, in order."""
    order = F.sort_array(F.collect_list(F.struct("priority", "source")))
    return attempts.groupBy("doc_id", "cite_id").agg(F.coalesce(F.min_by(F.when(F.col("ok"), F.col("source")), F.when(F.col("ok"), F.col("priority"))), F.lit("unverifiable")).alias("source"), F.transform(order, lambda x: x["source"]).alias("tried"))


def sources_table(spark) -> DataFrame:
    rows = [(t, i + 1, s) for t, names in SOURCES.items() for i, s in enumerate(names)]
    return spark.createDataFrame(rows, "type string, priority int, source string")


# ---- quotations and passages


def normal_quote(c: Column) -> Column:
    """Quotation without alterations: brackets opened, emphasis notes dropped, quotes straightened, space collapsed."""
    c = F.regexp_replace(c, r"\((?:emphasis|citation|internal quotation|alteration)[^)]*\)", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\[([^\]]*)\]", "$1"), "[“”\"]", "")
    c = F.regexp_replace(c, "[‘’]", "'")
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def quote_match(quote: Column, source: Column) -> Column:
    """True if the pieces between ellipses stand in the source in order; null without a quotation."""
    pieces = F.filter(F.transform(F.split(normal_quote(quote), r"(?:\. ?){3,}|…"), F.trim), lambda x: x != "")
    text = normal_quote(source)

    def after(at: Column, p: Column) -> Column:
        found = F.position(p, text, at)
        return F.when(at == 0, 0).when(found == 0, 0).otherwise(found + F.length(p))

    end = F.aggregate(pieces, F.lit(1), after)
    return F.when(X.blank_to_null(quote).isNotNull() & X.blank_to_null(source).isNotNull(), (F.size(pieces) > 0) & (end > 0))


def trivially_different(quote: Column, source: Column) -> Column:
    """Quotation that matches once case, punctuation and space are ignored."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "")
    return F.coalesce(bare(source).contains(bare(quote)), F.lit(False))


def statute_rubric(status: Column, quote: Column, text: Column) -> Column:
    """struct<label, issue>: Strong, Misleading with its issue, or Unable without a source."""
    ok = quote_match(quote, text)
    label = F.when((status != "ok") | X.blank_to_null(text).isNull(), "Unable").when(ok.isNull(), F.lit(None)).when(ok, "Strong").otherwise("Misleading")
    issue = F.when(label == "Misleading", F.when(trivially_different(quote, text), "citation-form").otherwise("misquote"))
    return F.struct(label.alias("label"), issue.alias("issue"))


def passage_window(text: Column, start: Column, end: Column, words: int = 100) -> Column:
    return X.snippet(text, start, end, words)


def match_ladder(cites: DataFrame, passages: DataFrame, scorer: Callable[[Column, Column], Column] | None = None, threshold: float = 0.5) -> DataFrame:
    """cite_id, tier, page, text of the passage that supports a citation; each tier only takes what is left.

    cites: cite_id, opinion_id, page, quote, proposition; passages: opinion_id, page, kind (page or
    parenthetical), text. Tier 1: the quotation itself within a page. Tiers 2 to 4: the best passage by the
    scorer among parentheticals, the cited page, the whole opinion. One join and one aggregation: every
    passage gets the best tier it can serve, and each citation takes its best passage.
    """
    p = passages.select(F.col("opinion_id").alias("_o"), F.col("page").alias("_p"), "kind", F.col("text").alias("passage"))
    joined = cites.join(p, F.col("opinion_id") == F.col("_o"))
    off = F.abs(F.col("_p") - F.col("page"))
    quoted = F.coalesce(off <= 1, F.lit(True)) & F.coalesce(quote_match(F.col("quote"), F.col("passage")), F.lit(False))
    tier, score = F.when(quoted, 1), F.lit(0.0)
    if scorer is not None:
        joined = joined.withColumn("_score", scorer(F.col("proposition"), F.col("passage")))
        good = F.col("_score") >= threshold
        tier = tier.when(good & (F.col("kind") == "parenthetical"), 2).when(good & (F.col("kind") == "page") & (F.col("_p") == F.col("page")), 3).when(good & (F.col("kind") == "page"), 4)
        score = F.when(quoted, 0.0).otherwise(F.col("_score"))
    # the least: lowest tier, then for quotations the nearest page and for the others the best score, then the first page
    rank = F.struct(F.col("_tier"), F.when(F.col("_tier") == 1, F.coalesce(off, F.lit(0)).cast("double")).otherwise(-score).alias("far"), F.col("_p"), F.col("passage"))
    best = joined.withColumn("_tier", tier).filter("_tier IS NOT NULL").groupBy("cite_id").agg(F.min(rank).alias("x"))
    return best.select("cite_id", F.col("x._tier").alias("tier"), F.col("x._p").alias("page"), F.col("x.passage").alias("text"))


def unlocated(cites: DataFrame, found: DataFrame) -> DataFrame:
    """cites with tier and page of what the ladder found, flagged where it found nothing."""
    got = cites.select("cite_id").join(found.select("cite_id", "tier", "page"), "cite_id", "left")
    return got.withColumn("flags", F.array_compact(F.array(F.when(F.col("tier").isNull(), "pincite_page_unresolvable"))))


def combined_passages(cites: DataFrame, page_rows: DataFrame) -> DataFrame:
    """cite_id, passage: the texts of all its pincite pages in order."""
    rows = cites.select("cite_id", "opinion_id", F.posexplode("pincite").alias("n", "page")).join(page_rows.select("opinion_id", "page", "text"), ["opinion_id", "page"])
    return rows.groupBy("cite_id").agg(F.sort_array(F.collect_list(F.struct("n", "text"))).alias("x")).select("cite_id", F.array_join(F.transform("x", lambda y: y["text"]), " ").alias("passage"))


def other_source_text(status: Column, subsection: Column, subsection_text: Column, section_text: Column) -> Column:
    """Text to assess of a statute or regulation: its subsection, or the section if none was cited."""
    return F.when(status == "ok", F.when(subsection.isNull(), section_text).otherwise(subsection_text))


# ---- labels


def support_label(judged: Column, source_found: Column, pincite_found: Column) -> Column:
    """The judged label; Unable without source or pincite, and for words that are no label."""
    return F.when(~source_found | ~pincite_found, "Unable").when(judged.isin(*LABELS), judged).otherwise("Unable")


def indirect_label(inference: Column) -> Column:
    """Support by inference: Adequate if a judge calls the inference short, Weak otherwise, null if it was not judged."""
    return F.when(inference == "short", "Adequate").when(inference.isNotNull(), "Weak")


def tier_confidence(tier: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])[tier]


def confident_label(label: Column, tier: Column, downgrade: bool = False) -> Column:
    return F.when(F.lit(downgrade) & (tier == 4) & (label == "Strong"), "Adequate").otherwise(label)


def signal_bar(signal: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in SIGNAL_BARS.items() for x in kv])[signal]


def with_negative_history(df: DataFrame, treatments: DataFrame) -> DataFrame:
    """df (case_key) with negative_history (worst first) and a flag; distinguished or criticised is not negative."""
    bad = treatments.filter(F.col("treatment").isin(*NEGATIVE) & F.col("affects")).groupBy("case_key").agg(F.array_join(F.sort_array(F.collect_set("treatment"), False), ", ").alias("negative_history"))
    return df.join(bad, "case_key", "left").withColumn("flagged", F.col("negative_history").isNotNull())


def with_critic(df: DataFrame, critic: DataFrame) -> DataFrame:
    """df (cite_id, has_pincite) with critic_status and marker."""
    c = critic.select("cite_id", F.col("status").alias("_s"))
    state = F.when(~F.col("has_pincite"), "not-dispatched").when(F.col("_s").isin("agrees", "partial", "disagrees"), F.col("_s")).otherwise("unavailable")
    marker = F.when(F.col("critic_status").isin("partial", "disagrees"), "CRITIC DISAGREES").when(F.col("critic_status") == "unavailable", "CRITIC UNAVAILABLE")
    return df.join(c, "cite_id", "left").withColumn("critic_status", state).withColumn("marker", marker).drop("_s")


def verified_suggestions(suggestions: DataFrame, lookups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Suggested authorities that were looked up, and those to be left out with a note."""
    key = ["volume", "reporter", "start_page"]
    known = lookups.filter("cluster_id IS NOT NULL").select(*key)
    return suggestions.join(known, key, "left_semi"), suggestions.join(known, key, "left_anti").withColumn("note", F.lit("suggested authority could not be verified"))


def renderer_mode(matched: Column) -> Column:
    return F.when(matched.isNull(), "neutral").when(matched, "match").otherwise("divergent")


def precis_ok(precis: Column) -> Column:
    """Whether a summary has two to five sentences."""
    return F.size(X.sentences(precis)).between(2, 5)


# ---- counts


def label_counts(checks: DataFrame, labels: DataFrame) -> DataFrame:
    """label, n of every label, zeros too, and of Unverifiable."""
    n = checks.select(F.explode(F.array_compact(F.array(F.col("label"), F.when(~F.col("found"), "Unverifiable")))).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return labels.join(n, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def triage(checks: DataFrame) -> DataFrame:
    """Checks to look at first: Misleading, Weak, Unverifiable, each in document order."""
    kind = F.when(F.col("label") == "Misleading", 1).when(F.col("label") == "Weak", 2).when(~F.col("found"), 3)
    out = checks.withColumn("priority", kind).filter("priority IS NOT NULL")
    return out.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("priority", "doc_index")))


# ---- scorers

_SCORERS: dict[str, Callable[[Column, Column], Column]] = {}


def register_scorer(name: str, score: Callable[[Column, Column], Column]) -> None:
    """A scorer takes two columns and gives their relevance; pandas UDFs fit."""
    _SCORERS[name] = score


def scorer(name: str) -> Callable[[Column, Column], Column]:
    return _SCORERS[name]


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Share of a's distinct words (letters and digits, any case) that b has, 0 where a has none."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != ""))
    return F.when(F.size(words(a)) > 0, F.size(F.array_intersect(words(a), words(b))) / F.size(words(a))).otherwise(F.lit(0.0))


register_scorer("cosine", cosine)
register_scorer("overlap", overlap)


def contained(docs: DataFrame, items: DataFrame, block: int = 20_000, batch_docs: int = 500) -> DataFrame:
    """doc_id, n: how many items (q) the documents (doc_id, t) contain; every document is scanned once for each block of items."""

    def blocks(names: dict[str, pa.DataType], size: int):
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    part = batch.slice(at, size)
                    yield pa.RecordBatch.from_arrays([pa.array([part.column(c).to_pylist()], pa.list_(k)) for c, k in names.items()], names=list(names))

        return run

    def scan(batches):
        import ahocorasick

        known, automaton = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["q"] != known:
                    known, automaton = row["q"], ahocorasick.Automaton()
                    for q, n in Counter(known).items():
                        automaton.add_word(q, (q, n))
                    automaton.make_automaton()
                counts = [(i, sum(n for _, n in {x for _, x in automaton.iter(t or "")})) for i, t in zip(row["doc_id"], row["t"])]
                kept = [x for x in counts if x[1]]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in kept], pa.int64()) for k in (0, 1)], names=["doc_id", "n"])

    parts = items.select("q").filter("q <> ''").mapInArrow(blocks({"q": pa.string()}, block), "q array<string>")
    left = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "t").mapInArrow(blocks({"doc_id": pa.int64(), "t": pa.string()}, batch_docs), "doc_id array<long>, t array<string>")
    return left.crossJoin(parts).mapInArrow(scan, "doc_id long, n long")


def containing(docs: DataFrame, items: DataFrame, most: int = 8) -> DataFrame:
    """doc_id, n: how many items (q, flat lower-case text) each document (doc_id, t, likewise flat) contains.

    An item's inner words stand whole in any document that holds it. Items of three words or more are
    found by their first inner words, up to `most`, as one key: equal runs of documents are their
    candidates, and the texts decide. Items of one or two words have no inner word; all documents are
    scanned for them, in blocks of items.
    """
    items = items.filter("q <> ''").withColumn("_n", F.size(F.split("q", " ")))
    m = F.least(F.col("_n") - 2, F.lit(most))
    keyed = items.filter("_n > 2").select("q", m.alias("m"), F.xxhash64(m, F.array_join(F.slice(F.split("q", " "), F.lit(2), m), " ")).alias("k"))
    lengths = [r["m"] for r in keyed.select("m").distinct().collect()]  # at most `most`
    d = docs.withColumn("w", F.split("t", " "))
    run = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.xxhash64(F.lit(n), F.array_join(F.slice("w", i, F.lit(n)), " ")))
    runs = d.select("doc_id", F.explode(F.array_distinct(F.concat(*[run(n) for n in lengths]) if lengths else F.array().cast("array<bigint>"))).alias("k"))
    pairs = runs.join(keyed.select("k", "q"), "k").select("doc_id", "q")
    long = pairs.join(docs.select("doc_id", "t"), "doc_id").filter(F.contains("t", "q")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return long.unionByName(contained(docs, items.filter("_n <= 2"))).groupBy("doc_id").agg(F.sum("n").alias("n"))


def nearest(queries: DataFrame, rows: DataFrame, k: int, block: int = 1000) -> DataFrame:
    """vec_id, best, r: for each query (vec_id, v) the k other rows of highest cosine, to six places, then of lowest id.

    Every row meets every query, block by block; a pair of blocks yields at most k rows for each query.
    Rows without a vector are left out.
    """

    def packed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block).to_pydict()
                kept = [(i, v) for i, v in zip(part["vec_id"], part["v"]) if i is not None and v is not None]
                yield pa.RecordBatch.from_arrays([pa.array([[i for i, _ in kept]], pa.list_(pa.int64())), pa.array([[v for _, v in kept]], pa.list_(pa.list_(pa.float64())))], names=["ids", "vs"])

    def best(batches):
        for batch in batches:
            for p in batch.to_pylist():
                if not p["ids"] or not p["q_ids"]:
                    continue
                ids, v, q = np.array(p["ids"], np.int64), np.array(p["vs"]), np.array(p["q_vs"])
                norm = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))
                score = np.round(np.divide(q @ v.T, norm, out=np.zeros(norm.shape), where=norm > 0), 6) + 0.0
                for i, s in zip(p["q_ids"], score):
                    other = np.flatnonzero(ids != i)
                    top = other[np.lexsort((ids[other], -s[other]))[:k]]
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(top), pa.int64()), pa.array(ids[top]), pa.array(s[top])], names=["vec_id", "best", "score"])

    kind = "ids array<long>, vs array<array<double>>"
    left = rows.select("vec_id", "v").mapInArrow(packed, kind)
    right = queries.select("vec_id", "v").mapInArrow(packed, kind).select(F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"))
    pairs = left.crossJoin(right).mapInArrow(best, "vec_id long, best long, score double")
    order = Window.partitionBy("vec_id").orderBy(F.desc("score"), "best")
    return pairs.withColumn("r", F.row_number().over(order).cast("long")).filter(F.col("r") <= k).select("vec_id", "best", "r")


def route(task: Column, flag_rate: Column, high: float = 0.3) -> Column:
    """struct<route, promote>: mechanical work goes cheap, judgment and criticism do not; many flags promote."""
    way = F.when(task.isin("extract", "lookup", "format"), "mechanical").when(task == "critic", "critic").otherwise("judgment")
    return F.struct(way.alias("route"), ((way == "mechanical") & (flag_rate > high)).alias("promote"))
