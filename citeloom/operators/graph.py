"""Citation graphs: anchors in opinion text, the next hop, walks backward and their ends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import text as X

SPAN = r'<span class="citation[^"]*"[^>]*>.*?</span>'
FORWARD = 1500
NEEDLE = 120
CHECKPOINT = 8
MOST_CANDIDATES = 5


def pick_text(html_with_citations: Column, plain_text: Column, html: Column, xml: Column | None = None) -> Column:
    """struct<field, text> of the first text that is not blank, or null."""
    fields = [("html_with_citations", html_with_citations), ("plain_text", plain_text), ("html", html)] + ([("xml_harvard", xml)] if xml is not None else [])
    return F.coalesce(*[F.when(F.length(F.trim(c)) > 0, F.struct(F.lit(n).alias("field"), c.alias("text"))) for n, c in fields])


def _tagged(t: Column, pattern: str) -> Column:
    return X.empty_to_null(F.regexp_extract(t, pattern, 1))


def anchors(html: Column) -> Column:
    """array<struct<ord, data_id, href, dst, page, text, offset, no_link>> in document order."""
    found = X.spans(html, SPAN)
    return F.transform(
        found,
        lambda s, i: F.struct(
            (i + 1).alias("ord"), _tagged(s["text"], r'data-id="([0-9]+)"').alias("data_id"), _tagged(s["text"], r'href="([^"]*)"').alias("href"), _tagged(s["text"], r'href="/opinion/([0-9]+)/').try_cast("long").alias("dst"),
            _tagged(s["text"], r'href="[^"#]*#\*?([0-9]+)"').try_cast("int").alias("page"), X.strip_tags(s["text"]).alias("text"), s["start"].alias("offset"), F.regexp_extract(s["text"], r'href="/opinion/([0-9]+)/', 1).eqNullSafe("").alias("no_link"),
        ),
    )


def classify_non_case(c: Column) -> Column:
    """Kind of a citation that is no case, tested in this order, or null."""
    t = F.lower(c)
    return (
        F.when(t.contains("u.s.c."), "cites_statute").when(t.contains("c.f.r.") | t.contains("fed. reg."), "cites_statute").when(t.contains("fed. r."), "cites_statute").when(t.contains("restatement"), "cites_restatement")
        .when(t.contains("const.") | t.contains("constitution"), "cites_constitution").when(t.contains("cong. rec.") | t.contains("rep. no."), "cites_legislative_history").when(t.rlike(r"l\. rev\.|l\.j\."), "cites_law_review").when(t.rlike(r" § [0-9.]+ \("), "cites_treatise")
    )


def find_sentence(text: Column, sentence: Column, needle: int = NEEDLE) -> Column:
    """struct<start,end> of the first place where the sentence's beginning stands, whatever tags and space lie between its words."""
    words = F.filter(F.split(F.substring(F.trim(sentence), 1, needle), r"\s+"), lambda w: w != "")
    quoted = F.transform(words, lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    pattern = F.concat(F.lit("(?is)"), F.array_join(quoted, r"(?:\s|<[^>]*>)+"))
    at = F.regexp_instr(text, pattern)
    return F.when((F.size(words) > 0) & (at > 0), F.struct((at - 1).alias("start"), (at - 1 + F.length(F.regexp_substr(text, pattern))).alias("end")))


def window(found: Column, start: Column, end: Column, forward: int = FORWARD) -> Column:
    """Anchors from the sentence's start to `forward` characters beyond its end."""
    return F.filter(found, lambda a: a["offset"].between(start, end + forward))


def next_hop(found: Column, visited: Column) -> Column:
    """struct<next, siblings, terminal, target> of the anchors after a sentence.

    The first linked and unvisited anchor is next, the others are siblings; else the first
    classified citation ends the chain, else a visited target closes a cycle, else nothing is left.
    """
    usable = F.filter(found, lambda a: ~a["no_link"] & ~F.array_contains(visited, a["dst"]))
    cycle = F.filter(found, lambda a: ~a["no_link"] & F.array_contains(visited, a["dst"]))
    law = F.filter(F.transform(F.filter(found, lambda a: a["no_link"]), lambda a: F.struct(classify_non_case(a["text"]).alias("kind"), a["text"].alias("text"))), lambda x: x["kind"].isNotNull())
    terminal = F.when(F.size(usable) > 0, F.lit(None).cast("string")).when(F.size(law) > 0, F.get(law, F.lit(0))["kind"]).when(F.size(cycle) > 0, F.lit("cycle_detected")).otherwise(F.lit("no_outbound_for_proposition"))
    siblings = F.transform(F.slice(usable, F.lit(2), F.greatest(F.size(usable) - 1, F.lit(0))), lambda a: a["dst"])
    return F.struct(F.get(usable, F.lit(0))["dst"].alias("next"), siblings.alias("siblings"), terminal.alias("terminal"), F.when(terminal == "cycle_detected", F.get(cycle, F.lit(0))["dst"]).alias("target"), F.when(F.size(usable) == 0, F.get(law, F.lit(0))["text"]).alias("terminal_citation"))


# ---- walks

def adjacency(edges: DataFrame) -> DataFrame:
    """src, nbrs: linked targets in order, without repeats."""
    linked = edges.filter(~F.col("no_link")).groupBy("src").agg(F.sort_array(F.collect_list(F.struct("ord", "dst"))).alias("x"))
    return linked.select("src", F.array_distinct(F.transform("x", lambda y: y["dst"])).alias("nbrs"))


def walk(edges: DataFrame, seeds: DataFrame, most_hops: int | None = None) -> DataFrame:
    """root, path: from each seed to the first unvisited target of each opinion, until none is left.

    All walks go one hop at a time, by a join of their last opinions with the adjacency; only `most_hops`
    cuts a walk. A round reads the walks that are still under way and nothing else.
    """
    adj = _cut(adjacency(edges))
    live = seeds.select(F.col("opinion_id").cast("long").alias("root"), F.array(F.col("opinion_id").cast("long")).alias("path"))
    done, hop = [], 0
    while most_hops is None or hop < most_hops:
        joined = live.join(adj, F.element_at("path", -1) == F.col("src"), "left").withColumn("t", F.expr("get(filter(coalesce(nbrs, array()), x -> NOT array_contains(path, x)), 0)"))
        joined = _cut(joined.select("root", "path", "t"))
        done = _gathered([*done, joined.filter("t IS NULL").select("root", "path")])
        live = joined.filter("t IS NOT NULL").select("root", F.array_append("path", F.col("t")).alias("path"))
        hop += 1
        if live.isEmpty():
            break
    return reduce(DataFrame.unionByName, [*done, live])


def _gathered(parts: list[DataFrame], most: int = 16) -> list[DataFrame]:
    """Written anew as one where there are many parts, so that the plan stays small."""
    return parts if len(parts) < most else [_cut(reduce(DataFrame.unionByName, parts))]


def _cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    from citeloom.sources.shared import checkpointed

    return checkpointed(df)


def hops(walks: DataFrame) -> DataFrame:
    """root, hop_index, opinion_id, parent: a row for each opinion of each walk."""
    rows = walks.select("root", "path", F.posexplode("path").alias("hop_index", "opinion_id"))
    return rows.select("root", "hop_index", "opinion_id", F.when(F.col("hop_index") > 0, F.element_at("path", F.col("hop_index"))).alias("parent"))


def terminals(walks: DataFrame, edges: DataFrame, opinions: DataFrame | None = None) -> DataFrame:
    """root, hops, last, terminal_reason, cycle_path of each walk; where opinions are given, a last one that is not among them is missing."""
    laws = edges.groupBy("src").agg(F.collect_set(F.when(~F.col("no_link"), F.col("dst"))).alias("linked"), F.count_if("no_link").alias("laws"))
    joined = walks.withColumn("last", F.element_at("path", -1)).join(laws, F.col("last") == F.col("src"), "left")
    if opinions is None:
        joined = joined.withColumn("_known", F.lit(True))
    else:
        joined = joined.join(opinions.select(F.col("opinion_id").alias("_o"), F.lit(True).alias("_known")), F.col("last") == F.col("_o"), "left")
    linked = F.coalesce("linked", F.array().cast("array<bigint>"))
    free = F.filter(linked, lambda x: ~F.array_contains("path", x))
    reason = F.when(F.size(free) > 0, "hop_limit").when(F.col("_known").isNull(), "courtlistener_missing").when(F.coalesce("laws", F.lit(0)) > 0, "cites_statute").when(F.size(linked) > 0, "cycle_detected").otherwise("no_outbound_for_proposition")
    closing = F.array_min(F.filter(linked, lambda x: F.array_contains("path", x)))
    out = joined.withColumn("terminal_reason", reason)
    return out.select("root", (F.size("path") - 1).alias("hops"), "last", "terminal_reason", F.when(F.col("terminal_reason") == "cycle_detected", F.array_append("path", closing)).alias("cycle_path"))


# Reasons that end a chain; the advice is ours.
SUGGESTIONS = {
    "cites_statute": "Read the statute or regulation itself; the proposition rests on enacted text.",
    "cites_constitution": "Read the constitutional provision; no earlier case carries the proposition.",
    "cites_restatement": "Check the Restatement section and its reporter's notes.",
    "cites_treatise": "Check the treatise section that is cited.",
    "cites_law_review": "Read the article; the proposition began as scholarship.",
    "cites_legislative_history": "Read the report or debate that is cited.",
    "no_outbound_for_proposition": "The opinion states the proposition on its own; treat it as the origin.",
    "cycle_detected": "The opinions cite each other; pick the earliest by date.",
    "hop_limit": "Start again from the last opinion with a higher limit.",
    "courtlistener_missing": "Supply the opinion's text from another source.",
    "pincite_page_unresolvable": "Supply a copy with page numbers.",
    "user_stopped_at_checkpoint": "Resume from the last checkpoint.",
}


def suggestion(reason: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in SUGGESTIONS.items() for x in kv])[reason]


def checkpoints(hop_rows: DataFrame, every: int = CHECKPOINT, most: int | None = None) -> DataFrame:
    """hop rows with checkpoint_no, cut after `most` opinions (then user_stopped_at_checkpoint)."""
    n = F.col("hop_index") + 1
    out = hop_rows.withColumn("checkpoint_no", F.floor((n - 1) / every).cast("int"))
    return out if most is None else out.filter(n <= most).withColumn("stopped", n == most)


def forest(edges: DataFrame, seeds: DataFrame, levels: int | None = None) -> DataFrame:
    """root, parent, opinion_id, level: every opinion reachable from a root, once, at its first level; one join a level until none is new."""
    start = seeds.select(F.col("opinion_id").alias("root"), F.lit(None).cast("long").alias("parent"), "opinion_id", F.lit(0).alias("level"))
    linked = edges.filter(~F.col("no_link")).select("src", "dst")
    parts, frontier, level = [start], start, 0
    while levels is None or level < levels:
        level += 1
        step = frontier.join(linked, F.col("opinion_id") == F.col("src")).groupBy("root", F.col("dst").alias("opinion_id")).agg(F.min("src").alias("parent")).select("root", "parent", "opinion_id", F.lit(level).alias("level"))
        reached = reduce(DataFrame.unionByName, parts)
        frontier = _cut(step.join(reached.select("root", "opinion_id"), ["root", "opinion_id"], "left_anti").select("root", "parent", "opinion_id", "level"))
        if frontier.isEmpty():
            break
        parts = _gathered([*parts, frontier])
    return reduce(DataFrame.unionByName, parts)


def fan_out(candidates: DataFrame, chosen: DataFrame | None = None, most: int = MOST_CANDIDATES) -> DataFrame:
    """candidates (root, opinion_id, match) ranked exact, paraphrase, broadens or narrows; more than `most` need a choice."""

    strength = F.when(F.col("match") == "exact", 0).when(F.col("match") == "paraphrase", 1).otherwise(2)
    n = F.count(F.lit(1)).over(Window.partitionBy("root"))
    if chosen is not None:
        candidates = candidates.join(chosen.select("root", "opinion_id"), ["root", "opinion_id"], "left_semi")
    out = candidates.withColumn("n_candidates", n).withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy(strength, "opinion_id")))
    return out.withColumn("status", F.when(F.col("n_candidates") > most, "needs_user_choice").otherwise("evaluated"))


def relationship(passage: Column, proposition: Column, hop_index: Column) -> Column:
    """seed, quoting (quotation marks around the shared words), holding (the court holds), or paraphrasing."""
    quoted = passage.rlike("[\"“][^\"”]{10,}[\"”]")
    return F.when(hop_index == 0, "seed").when(quoted, "quoting").when(F.lower(passage).rlike(r"\bwe (?:hold|conclude)\b|\bheld that\b"), "holding").otherwise("paraphrasing")


def drift(passage: Column, proposition: Column, judged_kind: Column) -> Column:
    """Null for an exact match; otherwise the judged kind."""
    same = F.regexp_replace(F.lower(passage), r"\W+", " ").contains(F.trim(F.regexp_replace(F.lower(proposition), r"\W+", " ")))
    return F.when(~F.coalesce(same, F.lit(False)), judged_kind)


def intake(seeds: DataFrame) -> DataFrame:
    """seeds (type, pincite, us) with reject_reason, or needs_choice where several pincites stand."""
    reason = F.when(F.col("type").isin("short_case", "id", "supra"), "short_form").when(F.col("type").isin("statute", "rule", "regulation", "constitutional"), "not_a_case").when(~F.col("us"), "not_us")
    return seeds.withColumn("reject_reason", reason).withColumn("needs_choice", reason.isNull() & (F.size("pincite") > 1))


def seed_status(resolved: Column, proposition_found: Column) -> Column:
    return F.when(~resolved, "seed_citation_unverifiable").when(~proposition_found, "proposition_not_in_seed").otherwise("ok")


def nearest_location(locations: DataFrame, found: DataFrame) -> DataFrame:
    """Of several matches (opinion_id, offset) the one nearest before an outbound anchor, flagged if there were several."""

    near = locations.join(found.select(F.col("opinion_id").alias("_o"), F.col("offset").alias("_at")), (F.col("opinion_id") == F.col("_o")) & (F.col("_at") >= F.col("offset")), "left").groupBy("opinion_id", "offset").agg(F.min(F.col("_at") - F.col("offset")).alias("distance"))
    order = Window.partitionBy("opinion_id").orderBy(F.col("distance").asc_nulls_last(), "offset")
    ranked = near.withColumn("r", F.row_number().over(order)).withColumn("flags", F.when(F.count(F.lit(1)).over(Window.partitionBy("opinion_id")) > 1, F.array(F.lit("multiple_proposition_locations"))).otherwise(F.array().cast("array<string>")))
    return ranked.filter("r = 1").drop("r")


def with_terminal_rows(hop_rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Every walk's hops and one row for its end, whatever ended it."""
    end = ends.select("root", (F.col("hops") + 1).cast("int").alias("hop_index"), F.lit(None).cast("long").alias("opinion_id"), F.col("last").alias("parent"), "terminal_reason")
    return hop_rows.withColumn("terminal_reason", F.lit(None).cast("string")).unionByName(end)


def summary_critic(hop_rows: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """hop rows with a reviewer's note for each root, where notes are supplied."""
    return hop_rows.withColumn("note", F.lit(None).cast("string")) if notes is None else hop_rows.join(notes.select("root", "note"), "root", "left")


def methodology(hop_rows: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Counts over all walks: opinions fetched, hops, checkpoints, and fan-outs, hops from an opinion with several targets."""
    wide = None if edges is None else adjacency(edges).filter(F.size("nbrs") > 1).select(F.col("src").alias("_w"))
    rows = hop_rows.withColumn("_w", F.lit(None)) if wide is None else hop_rows.join(wide, F.col("parent") == F.col("_w"), "left")
    return rows.agg(F.countDistinct("opinion_id").alias("opinions_fetched"), F.count_if(F.col("hop_index") > 0).alias("hops"), F.countDistinct("root").alias("walks"), F.count_if(F.col("hop_index") % CHECKPOINT == CHECKPOINT - 1).alias("checkpoints"), F.count("_w").alias("fan_outs"))
