"""Queries over what is left to flags, review and judgment: made of part numbers, with the expected rows as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import grammar as G
from citeloom.functions import text as X
from citeloom.operators import extract as E
from citeloom.operators import graph as H
from citeloom.operators import resolve as R
from citeloom.operators import structure as S
from citeloom.operators import toa as T
from citeloom.operators import verify as V
from citeloom.plans import corpus as C
from citeloom.registry import query
from citeloom.sources import readers
from citeloom.sources import sinks as K


def made(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return C.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(text).alias("text"))


def part(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    return C.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), *[F.expr(v).alias(k) for k, v in columns.items()])


# ---- extraction

BARE = "concat('Under ', 1 + p_partkey % 50, ' U.S.C. § ', 200 + p_partkey % 99, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '(c)(1)' END, ' it is so. ', 'But § ', 200 + p_partkey % 99 + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END, ' was enacted later.')"
_NEAR = "p_partkey % 3 <> 0 AND p_partkey % 5 <> 0"


@query("bare_section", f"SELECT p_partkey AS doc_id, CASE WHEN {_NEAR} THEN 1 + p_partkey % 50 END AS title, CASE WHEN {_NEAR} THEN 'U.S.C.' END AS code, CAST(200 + p_partkey % 99 + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS section, CASE WHEN {_NEAR} THEN '(c)(1)' END AS subsection, CASE WHEN {_NEAR} THEN '' ELSE 'ambiguous_section_reference' END AS flags FROM part")
def bare_section(spark, sf_dir):
    m = E.with_flags(E.bare_sections(E.components(E.mentions(made(spark, sf_dir, BARE))))).filter("family = 'P29'")
    return m.select("doc_id", F.col("title").cast("long").alias("title"), "code", "section", "subsection", F.array_join("flags", ",").alias("flags"))


PAREN = "concat('It is so. See Roe v. Doe, 5 U.S. ', 10 + p_partkey, ' (1999)', CASE p_partkey % 4 WHEN 0 THEN ' (quoting Poe v. Zoe, 3 F.3d 4 (2d Cir. 2000))' WHEN 1 THEN ' (citing Poe v. Zoe, 3 F.3d 4 (2d Cir. 2000))' WHEN 2 THEN ' (holding that the rule (as amended) applies)' ELSE ' (en banc)' END, '. Ann v. Bob, 7 F.3d 8 (2001).')"


@query(
    "parenthetical_entries",
    "SELECT p_partkey AS doc_id, 0 AS idx, NULL AS verb, NULL AS parent_idx, true AS own_entry, CASE WHEN p_partkey % 4 = 2 THEN 'the rule (as amended) applies' END AS holding, '' AS flags FROM part UNION ALL SELECT p_partkey, 1, CASE p_partkey % 4 WHEN 0 THEN 'quoting' ELSE 'citing' END, 0, p_partkey % 4 = 0, NULL, CASE p_partkey % 4 WHEN 0 THEN '' ELSE 'citing_parenthetical' END FROM part WHERE p_partkey % 4 < 2 UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN 2 ELSE 1 END, NULL, NULL, true, NULL, '' FROM part",
)
def parenthetical_entries(spark, sf_dir):
    m = E.with_flags(E.parentheticals(E.mentions(made(spark, sf_dir, PAREN), context=("verb", "follows"))))
    return m.select("doc_id", "idx", "verb", "parent_idx", "own_entry", "holding", F.array_join("flags", ",").alias("flags"))


FLAGGED = "concat('It is so. Roe v. Doe, 5 U.S. ', 10 + p_partkey, ' (1999)', CASE p_partkey % 3 WHEN 0 THEN ', overruled by law. ' WHEN 1 THEN ', aff''d, and more. ' ELSE '. ' END, 'The First Amendment holds. In 12 Foo. Rep. ', 1 + p_partkey, ' (1990) too. Then Nobody, supra, at 7.')"


@query(
    "mention_flags",
    "SELECT p_partkey AS doc_id, 0 AS idx, 'case' AS type, CASE WHEN p_partkey % 3 = 0 THEN 'subsequent_negative_history' ELSE '' END AS flags FROM part UNION ALL SELECT p_partkey, 1, 'constitutional', 'informal_reference' FROM part UNION ALL SELECT p_partkey, 2, 'unknown', 'uncertain_category' FROM part UNION ALL SELECT p_partkey, 3, 'supra', 'unresolved_short_form' FROM part",
)
def mention_flags(spark, sf_dir):
    m = E.components(E.mentions(made(spark, sf_dir, FLAGGED), context=("lead", "tail")))
    return E.with_flags(R.resolve(m)).select("doc_id", "idx", "type", F.array_join("flags", ",").alias("flags"))


DOCKETS = (*G.FAMILIES, G.Family("U01", "docket", r"No\. [0-9]+-[0-9]+", r"No\."))


@query("cite_other_types", "SELECT p_partkey AS doc_id, 'unknown' AS type, NULL AS class, concat('12 Foo. Rep. ', 1 + p_partkey, ' (1990)') AS full_citation FROM part UNION ALL SELECT p_partkey, 'other', 'docket', concat('No. 12-', p_partkey) FROM part")
def cite_other_types(spark, sf_dir):
    text = "concat('See 12 Foo. Rep. ', 1 + p_partkey, ' (1990) and No. 12-', p_partkey, ' here.')"
    return E.dispatched(E.mentions(made(spark, sf_dir, text), families=DOCKETS)).select("doc_id", "type", "class", "full_citation")


JOURNAL = "concat('See Jane Roe, The Law of Part ', p_partkey, ', ', 10 + p_partkey % 90, ' Harv. L. Rev. ', 100 + p_partkey % 900, ', ', 101 + p_partkey % 900, ' (', 1960 + p_partkey % 60, ').')"


@query("cite_journal_components", "SELECT p_partkey AS doc_id, 'Jane Roe' AS author, concat('The Law of Part ', p_partkey) AS work_title, 10 + p_partkey % 90 AS volume, 'Harv. L. Rev.' AS journal, 100 + p_partkey % 900 AS start_page, CAST(101 + p_partkey % 900 AS VARCHAR) AS pincites, 1960 + p_partkey % 60 AS year FROM part")
def cite_journal_components(spark, sf_dir):
    m = E.components(E.mentions(made(spark, sf_dir, JOURNAL)))
    return m.select("doc_id", "author", "work_title", F.col("volume").cast("long").alias("volume"), "journal", F.col("start_page").cast("long").alias("start_page"), F.array_join(F.transform("pincite", lambda x: x.cast("string")), ",").alias("pincites"), F.col("year").cast("long").alias("year"))


RARE = "concat('Cal. Const. art. I, § ', 1 + p_partkey % 30, '. Hearing before the Committee on Rules ', p_partkey, ', 94th Cong. (1976). 3 Nimmer, Copyright Law § ', 1 + p_partkey % 20, ' (4th ed. 2010). Then the Paxton court spoke.')"


@query("cite_rare_families", "SELECT p_partkey AS doc_id, 'P08' AS family, concat('Cal. Const. art. I, § ', 1 + p_partkey % 30) AS full_citation FROM part UNION ALL SELECT p_partkey, 'P18', concat('Hearing before the Committee on Rules ', p_partkey, ', 94th Cong. (1976)') FROM part UNION ALL SELECT p_partkey, 'P20', concat('3 Nimmer, Copyright Law § ', 1 + p_partkey % 20, ' (4th ed. 2010)') FROM part UNION ALL SELECT p_partkey, 'P27', 'the Paxton court' FROM part")
def cite_rare_families(spark, sf_dir):
    return E.mentions(made(spark, sf_dir, RARE)).select("doc_id", "family", "full_citation")


@query("cite_repaired_subsection", "SELECT p_partkey AS doc_id, CASE p_partkey % 3 WHEN 0 THEN '(b)' WHEN 1 THEN '(a)(2)' END AS subsection FROM part")
def cite_repaired_subsection(spark, sf_dir):
    text = "concat('See 17 U.S.C. § ', 500 + p_partkey % 50, CASE p_partkey % 3 WHEN 0 THEN '(b)' WHEN 1 THEN ' (a)(2)' ELSE '' END, ' now.')"
    m = E.components(E.mentions(made(spark, sf_dir, text), context=("tail",)))
    return m.select("doc_id", E.repaired_subsection(F.col("tail"), F.col("subsection")).alias("subsection"))


@query("cite_labels", "SELECT p_partkey AS doc_id, i AS doc_index, CASE i WHEN 1 THEN concat('Roe', p_partkey) ELSE concat('17 U.S.C. § ', 500 + p_partkey % 50) END AS short_label FROM part, (VALUES (1), (2)) t(i)")
def cite_labels(spark, sf_dir):
    text = "concat('See Roe', p_partkey, ' v. Doe, 5 U.S. 6 (1999). 17 U.S.C. § ', 500 + p_partkey % 50, '.')"
    m = E.components(E.mentions(made(spark, sf_dir, text)))
    return m.select("doc_id", (F.col("idx") + 1).alias("doc_index"), E.short_label(F.col("source_name"), F.col("full_citation")).alias("short_label"))


@query("footnote_bodies", "SELECT p_partkey AS doc_id, NULL AS footnote_id, concat('Body ', p_partkey) AS text FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, CAST(p_partkey % 9 AS VARCHAR), concat('Note ', p_partkey) FROM part WHERE p_partkey % 3 <> 0")
def footnote_bodies(spark, sf_dir):
    bodies = part(spark, sf_dir, text="concat('Body ', p_partkey)").filter("doc_id % 3 <> 0")
    notes = part(spark, sf_dir, footnote_id="CAST(p_partkey % 9 AS STRING)", text="concat('Note ', p_partkey)")
    return S.with_footnotes(bodies, notes).select("doc_id", "footnote_id", "text")


# ---- resolution and tables

SECOND = "concat('See Roe v. Doe, ', 1 + p_partkey % 300, ' F.3d 5 (1999). Id. at 6. Roe, ', 1 + p_partkey % 300, ' F.3d at 7. Poe, supra, at 8.')"


@query("resolve_second_pass", "SELECT p_partkey AS doc_id, i AS idx, CASE WHEN i IN (1, 2) THEN 0 END AS resolved_index, CASE WHEN i = 3 THEN 'unresolved_short_form' ELSE '' END AS flags FROM part, (VALUES (0), (1), (2), (3)) t(i)")
def resolve_second_pass(spark, sf_dir):
    docs = made(spark, sf_dir, SECOND)
    late = tuple(f for f in G.FAMILIES if f.id == "P01")
    first = E.components(E.mentions(docs, families=tuple(f for f in G.FAMILIES if f.id != "P01")))
    return R.second_pass(first.filter("type <> 'unknown'"), E.components(E.mentions(docs, families=late))).select("doc_id", F.col("idx").cast("int").alias("idx"), "resolved_index", F.array_join("flags", ",").alias("flags"))


@query("resolve_parallel_reporters", "SELECT p_partkey AS doc_id, 2 AS n_keys, 'scotus' AS level, 'Cases' AS category FROM part")
def resolve_parallel_reporters(spark, sf_dir):
    """`S. Ct.` has the type, level and category of `U.S.`; the two stay two authorities."""
    text = "concat('Roe v. Doe, 5 U.S. ', 6 + p_partkey, ' (1999). Roe v. Doe, 7 S. Ct. ', 8 + p_partkey, ' (1999).')"
    m = R.resolve(E.components(E.mentions(made(spark, sf_dir, text))))
    named = m.select("doc_id", "authority_key", E.authority_level(F.col("type"), F.col("reporter")).alias("level"), T.category(F.col("type"), F.col("family")).alias("category"))
    return named.groupBy("doc_id", "level", "category").agg(F.countDistinct("authority_key").cast("int").alias("n_keys"))


SEVEN = "concat('3 Nimmer, Copyright Law § 13 (4th ed. 2010). S. Rep. No. 94-47 (1976). 37 C.F.R. § 201.5. Fed. R. Civ. P. ', 1 + p_partkey % 80, '. 17 U.S.C. § 512(c)(2). 17 U.S.C. § 90. U.S. Const. amend. XIV. U.S. Const. amend. V. IPR2015-00123; see Roe v. Doe, ', 1 + p_partkey % 300, ' F.3d 5, 6 (1999). Ann v. Bob, 7 U.S. 8 (1990).')"


@query(
    "toa_seven_categories",
    "SELECT p_partkey AS doc_id, n AS position, category, replace(citation, '@', CAST(CASE n WHEN 2 THEN 1 + p_partkey % 300 ELSE 1 + p_partkey % 80 END AS VARCHAR)) AS citation FROM part, (VALUES (1, 'Cases', 'Ann v. Bob, 7 U.S. 8 (1990)'), (2, 'Cases', 'Roe v. Doe, @ F.3d 5 (1999)'), (3, 'Administrative Decisions', 'IPR2015-00123'), (4, 'Constitutional Provisions', 'U.S. Const. amend. V'), (5, 'Constitutional Provisions', 'U.S. Const. amend. XIV'), (6, 'Statutes', '17 U.S.C. § 90'), (7, 'Statutes', '17 U.S.C. § 512(c)(2)'), (8, 'Rules and Regulations', 'Fed. R. Civ. P. @'), (9, 'Rules and Regulations', '37 C.F.R. § 201.5'), (10, 'Legislative Materials', 'S. Rep. No. 94-47 (1976)'), (11, 'Other Authorities', '3 Nimmer, Copyright Law § 13 (4th ed. 2010)')) t(n, category, citation)",
)
def toa_seven_categories(spark, sf_dir):
    m = R.resolve(E.reclassified(E.components(E.mentions(made(spark, sf_dir, SEVEN)))).withColumn("page", F.lit(1)))
    t = T.ordered(T.authorities(m))
    return t.select("doc_id", F.col("position").cast("int").alias("position"), "category", "citation")


# ---- lookup and verification


@query("sources_by_type", "SELECT doc_id, type, string_agg(source, ',' ORDER BY n) AS sources FROM (SELECT p_partkey AS doc_id, CASE p_partkey % 3 WHEN 0 THEN 'statute' WHEN 1 THEN 'case' ELSE 'constitutional' END AS type FROM part) JOIN (VALUES ('statute', 1, 'lii'), ('statute', 2, 'user-provided'), ('case', 1, 'courtlistener-mcp'), ('case', 2, 'courtlistener-rest'), ('case', 3, 'google-scholar'), ('case', 4, 'justia'), ('case', 5, 'direct-court'), ('case', 6, 'user-provided'), ('constitutional', 1, 'local')) v(t, n, source) ON t = type GROUP BY 1, 2")
def sources_by_type(spark, sf_dir):
    cites = part(spark, sf_dir, type="CASE p_partkey % 3 WHEN 0 THEN 'statute' WHEN 1 THEN 'case' ELSE 'constitutional' END")
    rows = cites.join(F.broadcast(V.sources_table(spark)), "type")
    return rows.groupBy("doc_id", "type").agg(F.sort_array(F.collect_list(F.struct("priority", "source"))).alias("x")).select("doc_id", "type", F.array_join(F.transform("x", lambda y: y["source"]), ",").alias("sources"))


@query("constitution_text", "SELECT p_partkey AS doc_id, CASE p_partkey % 3 WHEN 0 THEN 'Congress shall make no law' WHEN 1 THEN 'No person shall be held' END AS text FROM part")
def constitution_text(spark, sf_dir):
    cites = part(spark, sf_dir, full_citation="concat('U.S. Const. amend. ', CASE p_partkey % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'V' ELSE 'XL' END)")
    texts = spark.createDataFrame([("U.S. Const. amend. I", "Congress shall make no law"), ("U.S. Const. amend. V", "No person shall be held")], "provision string, text string")
    return readers.constitution_text(cites, texts).select("doc_id", "text")


@query("opinion_fields", f"SELECT opinion_id, type FROM ({C.opinions_sql()})")
def opinion_fields(spark, sf_dir):
    return readers.allowed(C.opinions(spark, sf_dir), "identity")


@query("text_plausible", "SELECT p_partkey AS doc_id, p_partkey % 4 <> 3 AS plausible FROM part")
def text_plausible(spark, sf_dir):
    t = part(spark, sf_dir, t="CASE p_partkey % 4 WHEN 0 THEN 'Roe argued' WHEN 1 THEN 'in F.3d it stands' WHEN 2 THEN concat('*', p_partkey, ' begins') ELSE concat('*', p_partkey + 1, ' nothing') END")
    return t.select("doc_id", V.plausible_text(F.col("t"), F.lit("Roe"), F.lit("F.3d"), F.col("doc_id").cast("int")).alias("plausible"))


@query("pincite_passages", "SELECT concat('c', p_partkey) AS cite_id, CASE WHEN p_partkey % 2 = 0 THEN concat('page 3 of ', p_partkey, ' page 1 of ', p_partkey) ELSE concat('page 2 of ', p_partkey) END AS passage FROM part")
def pincite_passages(spark, sf_dir):
    cites = part(spark, sf_dir, cite_id="concat('c', p_partkey)", opinion_id="p_partkey", pincite="CASE WHEN p_partkey % 2 = 0 THEN array(3, 1, 9) ELSE array(2) END")
    pages = part(spark, sf_dir, opinion_id="p_partkey", page="explode(array(1, 2, 3))").withColumn("text", F.expr("concat('page ', page, ' of ', opinion_id)"))
    return V.combined_passages(cites, pages).select("cite_id", "passage")


@query("passage_window", "SELECT p_partkey AS doc_id, concat(CASE WHEN p_partkey % 5 > 0 THEN concat(repeat('w ', least(3, p_partkey % 5)), '') ELSE '' END, 'here', ' x y z') AS passage FROM part")
def passage_window(spark, sf_dir):
    t = part(spark, sf_dir, t="concat(repeat('w ', p_partkey % 5), 'here x y z more words')", s="CAST(2 * (p_partkey % 5) AS INT)")
    return t.select("doc_id", F.ltrim(V.passage_window(F.col("t"), F.col("s"), F.col("s") + 4, 3)).alias("passage"))


@query("verified_suggestions", "SELECT 100 + p_partkey AS volume, CASE WHEN p_partkey % 4 = 0 THEN 'suggested authority could not be verified' END AS note FROM part")
def verified_suggestions(spark, sf_dir):
    s = part(spark, sf_dir, volume="100 + p_partkey", reporter="'U.S.'", start_page="p_partkey")
    known = s.withColumn("cluster_id", F.expr("CASE WHEN doc_id % 4 <> 0 THEN doc_id END"))
    kept, left = V.verified_suggestions(s, known)
    return kept.withColumn("note", F.lit(None).cast("string")).unionByName(left).select("volume", "note")


@query("other_source_text", "SELECT p_partkey AS doc_id, CASE p_partkey % 4 WHEN 0 THEN 'whole' WHEN 1 THEN 'part' END AS text FROM part")
def other_source_text(spark, sf_dir):
    t = part(spark, sf_dir, status="CASE p_partkey % 4 WHEN 2 THEN 'anchor_not_found' WHEN 3 THEN 'not_found' ELSE 'ok' END", sub="CASE WHEN p_partkey % 4 > 0 THEN '(a)' END")
    return t.select("doc_id", V.other_source_text(F.col("status"), F.col("sub"), F.lit("part"), F.lit("whole")).alias("text"))


@query("precis_length", "SELECT p_partkey AS doc_id, p_partkey % 7 BETWEEN 2 AND 5 AS fits FROM part")
def precis_length(spark, sf_dir):
    return part(spark, sf_dir, t="repeat('The court said a good many words here. ', CAST(p_partkey % 7 AS INT))").select("doc_id", V.precis_ok(F.col("t")).alias("fits"))


@query("indirect_labels", "SELECT p_partkey AS doc_id, CASE p_partkey % 3 WHEN 0 THEN 'Adequate' WHEN 1 THEN 'Weak' END AS label FROM part")
def indirect_labels(spark, sf_dir):
    t = part(spark, sf_dir, inference="CASE p_partkey % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'long' END")
    return t.select("doc_id", V.indirect_label(F.col("inference")).alias("label"))


@query("task_routes", "SELECT p_partkey AS doc_id, CASE p_partkey % 4 WHEN 0 THEN 'mechanical' WHEN 1 THEN 'judgment' WHEN 2 THEN 'critic' ELSE 'mechanical' END AS route, p_partkey % 4 IN (0, 3) AND p_partkey % 10 > 3 AS promote FROM part")
def task_routes(spark, sf_dir):
    t = part(spark, sf_dir, task="CASE p_partkey % 4 WHEN 0 THEN 'extract' WHEN 1 THEN 'assess' WHEN 2 THEN 'critic' ELSE 'format' END", rate="(p_partkey % 10) / 10D")
    return t.select("doc_id", V.route(F.col("task"), F.col("rate")).alias("r")).select("doc_id", "r.route", "r.promote")


# ---- chains


@query("fan_out", "SELECT root, opinion_id, CASE WHEN n > 5 THEN 'needs_user_choice' ELSE 'evaluated' END AS status, row_number() OVER (PARTITION BY root ORDER BY CASE opinion_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, opinion_id) AS rank FROM (SELECT l_orderkey AS root, l_partkey AS opinion_id, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem))")
def fan_out(spark, sf_dir):
    c = C.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("root"), F.col("l_partkey").alias("opinion_id")).distinct().withColumn("match", F.expr("CASE opinion_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'paraphrase' ELSE 'broadens' END"))
    return H.fan_out(c).select("root", "opinion_id", "status", F.col("rank").cast("long").alias("rank"))


@query("hop_relationship", "SELECT p_partkey AS doc_id, CASE p_partkey % 4 WHEN 0 THEN 'seed' WHEN 1 THEN 'quoting' WHEN 2 THEN 'holding' ELSE 'paraphrasing' END AS relationship, CASE WHEN p_partkey % 4 <> 3 THEN 'broadens' END AS drift FROM part")
def hop_relationship(spark, sf_dir):
    t = part(spark, sf_dir, passage="CASE p_partkey % 4 WHEN 1 THEN 'It said \"the rule does apply\" there' WHEN 2 THEN 'Today we hold as before' ELSE concat('In sum, the  rule applies in case ', p_partkey) END", hop="CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1 END", proposition="CASE WHEN p_partkey % 4 = 0 THEN 'something else' ELSE concat('The rule applies in case ', p_partkey) END")
    return t.select("doc_id", H.relationship(F.col("passage"), F.col("proposition"), F.col("hop")).alias("relationship"), H.drift(F.col("passage"), F.col("proposition"), F.lit("broadens")).alias("drift"))


@query("chain_intake", "SELECT p_partkey AS doc_id, CASE p_partkey % 5 WHEN 0 THEN 'short_form' WHEN 1 THEN 'not_a_case' WHEN 2 THEN 'not_us' END AS reject_reason, p_partkey % 5 = 4 AS needs_choice, CASE p_partkey % 3 WHEN 0 THEN 'seed_citation_unverifiable' WHEN 1 THEN 'proposition_not_in_seed' ELSE 'ok' END AS status FROM part")
def chain_intake(spark, sf_dir):
    s = part(spark, sf_dir, type="CASE p_partkey % 5 WHEN 0 THEN 'id' WHEN 1 THEN 'statute' ELSE 'case' END", us="p_partkey % 5 <> 2", pincite="CASE WHEN p_partkey % 5 = 4 THEN array(1, 2) ELSE array(1) END")
    status = H.seed_status(F.col("doc_id") % 3 != 0, F.col("doc_id") % 3 != 1)
    return H.intake(s).select("doc_id", "reject_reason", "needs_choice", status.alias("status"))


@query("nearest_location", "SELECT p_partkey AS opinion_id, CASE WHEN p_partkey % 3 = 0 THEN 10 ELSE 500 END AS offset_found, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'multiple_proposition_locations' END AS flags FROM part")
def nearest_location(spark, sf_dir):
    places = part(spark, sf_dir, offset="explode(CASE WHEN p_partkey % 3 = 0 THEN array(10) ELSE array(10, 500) END)").withColumnRenamed("doc_id", "opinion_id")
    anchors = part(spark, sf_dir, offset="520").withColumnRenamed("doc_id", "opinion_id")
    return H.nearest_location(places, anchors).select("opinion_id", F.col("offset").alias("offset_found"), F.array_join("flags", ",").alias("flags"))


# ---- reports


@query("json_arrays", """SELECT l_orderkey AS doc_id, concat('[', string_agg(concat('{"idx":', n, ',"k":', l_partkey, ',"t":"§ ', l_partkey, '","none":null}'), ',' ORDER BY n), ']') AS json FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY """ + ", ".join(C.ORDER_KEY) + """) AS n FROM lineitem) GROUP BY 1""")
def json_arrays(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*C.ORDER_KEY))
    rows = C.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), n.alias("idx"), F.col("l_partkey").alias("k"), F.expr("concat('§ ', l_partkey)").alias("t"), F.lit(None).cast("string").alias("none"))
    return K.json_arrays(rows, "doc_id", "idx")


#: Every field of the report that a part number can fill.
FULL = {
    "citation": "concat('Roe v. Doe, ', p_partkey, ' U.S. 5')", "short_label": "'Roe'", "case_key": "concat(p_partkey, ' U.S. 5')", "type": "'case'", "authority_level": "'scotus'", "signal": "CASE WHEN p_partkey % 2 = 0 THEN 'see' ELSE 'none' END", "flags": "array('informal_reference')",
    "page": "CAST(p_partkey % 40 AS INT)", "section": "'ARGUMENT'", "snippet": "concat('so says ', p_partkey)", "proposition": "'The rule applies.'", "found": "p_partkey % 3 <> 0", "fetch_path": "CASE WHEN p_partkey % 3 = 0 THEN 'none' ELSE 'justia' END", "tier": "CAST(1 + p_partkey % 4 AS INT)", "quote_match": "p_partkey % 5 = 0",
    "label": "CASE WHEN p_partkey % 3 = 0 THEN 'Unable' ELSE 'Strong' END", "explanation": "concat('because of ', p_partkey)", "issues": "array('misquote', 'weight-concern')", "critic_status": "'agrees'", "precis": "'Two sentences. At least.'", "treatment": "CASE WHEN p_partkey % 6 = 0 THEN 'overruled' END",
}


@query(
    "report_json",
    "SELECT p_partkey AS doc_id, '1.0' AS version, concat('brief-', p_partkey, '.docx') AS filename, 'c1' AS id, concat('Roe v. Doe, ', p_partkey, ' U.S. 5') AS full_text, CASE WHEN p_partkey % 2 = 0 THEN 'see' ELSE 'none' END AS signal, CAST(p_partkey % 40 AS VARCHAR) AS page, CASE WHEN p_partkey % 3 = 0 THEN 'false' ELSE 'true' END AS found, CAST(1 + p_partkey % 4 AS VARCHAR) AS tier, CASE WHEN p_partkey % 5 = 0 THEN 'true' ELSE 'false' END AS quote_match, CASE WHEN p_partkey % 3 = 0 THEN 'Unable' ELSE 'Strong' END AS label, '[\"misquote\",\"weight-concern\"]' AS issues, 'agrees' AS critic, CASE WHEN p_partkey % 6 = 0 THEN '{\"treatment\":\"overruled\"}' END AS history, 'Two sentences. At least.' AS precis FROM part",
)
def report_json(spark, sf_dir):
    checks = part(spark, sf_dir, doc_index="1", **FULL)
    documents = part(spark, sf_dir, filename="concat('brief-', p_partkey, '.docx')", format="'docx'", sections="array(named_struct('heading', 'ARGUMENT', 'page_start', 1, 'page_end', 9))")
    told = K.check_json(checks, "2026-01-01T00:00:00Z", documents)
    at = {"version": "schema_version", "filename": "document.filename", "id": "citations[0].id", "full_text": "citations[0].citation.full_text", "signal": "citations[0].citation.signal", "page": "citations[0].location.page", "found": "citations[0].source.found", "tier": "citations[0].pincite.match_tier_used", "quote_match": "citations[0].pincite.quote_match", "label": "citations[0].support.label", "issues": "citations[0].support.issues", "critic": "citations[0].critic.status", "history": "citations[0].subsequent_negative_history", "precis": "citations[0].precis"}
    return told.select("doc_id", *[F.get_json_object("json", f"$.{path}").alias(name) for name, path in at.items()])


@query("report_names", "SELECT p_partkey AS doc_id, concat('roe-v-doe-', p_partkey, '-u-s-5-2026-01-02') AS name FROM part")
def report_names(spark, sf_dir):
    t = part(spark, sf_dir, c="concat('Roe v. Doe, ', p_partkey, ' U.S. 5')")
    return t.select("doc_id", K.chain_name(F.col("c"), F.lit("2026-01-02").cast("date")).alias("name"))


@query("plain_spaces", "SELECT p_partkey AS doc_id, concat('a b c', p_partkey) AS t FROM part")
def plain_spaces(spark, sf_dir):
    odd = X.ODD_SPACES
    t = part(spark, sf_dir, n="CAST(p_partkey AS STRING)")
    return t.select("doc_id", X.plain_spaces(F.concat(F.lit(f"a{odd[0]}b{odd[-1]}c"), F.col("n"))).alias("t"))
