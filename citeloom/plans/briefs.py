"""Queries over the projected briefs: extraction, resolution, pages, tables of authorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.operators import extract as E
from citeloom.operators import resolve as R
from citeloom.operators import structure as S
from citeloom.operators import toa as T
from citeloom.plans import corpus as C
from citeloom.registry import query
from citeloom.sources import sinks as K
from citeloom.sources.shared import checkpointed

DENSE = "dense_linked"


def joined(c: Column, sep: str = ",") -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)


# ---- extraction


def found(spark: SparkSession, sf_dir: str, variant: str = "base") -> DataFrame:
    return E.reclassified(E.components(E.mentions(C.briefs(spark, sf_dir, variant).drop("court"))))


PLACED = C.briefs_sql("base")


@query(
    "cite_extract_case",
    f"SELECT brief_id, ord - 1 AS idx, cite_text AS full_citation, concat('Supplier', s, ' v. Nation', s % 25) AS source_name, 100 + s AS volume, {C.REP} AS reporter, 10 + 7 * s AS start_page, CAST(pin AS VARCHAR) AS pincites, 1950 + s % 70 AS year, span_start, span_end FROM ({PLACED}) WHERE h < 4",
)
def cite_extract_case(spark, sf_dir):
    m = found(spark, sf_dir).filter("type = 'case'")
    return m.select("brief_id", F.col("idx").cast("long").alias("idx"), "full_citation", "source_name", F.col("volume").cast("long").alias("volume"), "reporter", F.col("start_page").cast("long").alias("start_page"), joined(F.col("pincite")).alias("pincites"), F.col("year").cast("long").alias("year"), F.col("span_start").cast("long").alias("span_start"), F.col("span_end").cast("long").alias("span_end"))


@query("cite_extract_statute", f"SELECT brief_id, ord - 1 AS idx, 1 + s % 54 AS title, 'U.S.C.' AS code, CAST(100 + k % 900 AS VARCHAR) AS section, '(c)(2)' AS subsection FROM ({C.mentions_sql()}) WHERE h = 9")
def cite_extract_statute(spark, sf_dir):
    m = found(spark, sf_dir).filter("type = 'statute'")
    return m.select("brief_id", F.col("idx").cast("long").alias("idx"), F.col("title").cast("long").alias("title"), "code", "section", "subsection")


@query("cite_extract_regulation", f"SELECT brief_id, ord - 1 AS idx, 1 + s % 50 AS title, 'C.F.R.' AS code, concat(100 + k % 900, '.', s % 90) AS section FROM ({C.mentions_sql()}) WHERE h = 10")
def cite_extract_regulation(spark, sf_dir):
    m = found(spark, sf_dir).filter("type = 'regulation'")
    return m.select("brief_id", F.col("idx").cast("long").alias("idx"), F.col("title").cast("long").alias("title"), "code", "section")


KIND = "CASE WHEN h < 4 THEN 'case' WHEN h IN (4, 5) THEN 'short_case' WHEN h IN (6, 7) THEN 'id' WHEN h = 8 THEN 'supra' WHEN h = 9 THEN 'statute' WHEN h = 10 THEN 'regulation' ELSE 'non_authority' END"


@query("cite_doc_order", f"SELECT brief_id, ord - 1 AS idx, {KIND} AS type, cite_text AS full_citation FROM ({C.mentions_sql()})")
def cite_doc_order(spark, sf_dir):
    return found(spark, sf_dir).select("brief_id", F.col("idx").cast("long").alias("idx"), "type", "full_citation")


@query("cite_short_forms", f"SELECT brief_id, ord - 1 AS idx, {KIND} AS type, CAST(pin AS VARCHAR) AS pincites, CASE WHEN h IN (5, 8) THEN concat('Supplier', s) END AS source_name FROM ({C.mentions_sql()}) WHERE h BETWEEN 4 AND 8")
def cite_short_forms(spark, sf_dir):
    m = found(spark, sf_dir).filter(F.col("type").isin(*R.SHORT))
    return m.select("brief_id", F.col("idx").cast("long").alias("idx"), "type", joined(F.col("pincite")).alias("pincites"), "source_name")


@query("cite_exclude_non_authority", f"SELECT brief_id, count(*) AS n_kept, count(*) FILTER (WHERE h < 4) AS n_cases FROM ({C.mentions_sql()}) WHERE h <> 11 GROUP BY brief_id")
def cite_exclude_non_authority(spark, sf_dir):
    m = found(spark, sf_dir).filter("type <> 'non_authority'")
    return m.groupBy("brief_id").agg(F.count(F.lit(1)).alias("n_kept"), F.count_if(F.col("type") == "case").alias("n_cases"))


@query("cite_derived_keys", f"SELECT DISTINCT concat(100 + s, ' ', {C.REP}, ' ', 10 + 7 * s) AS case_key, CASE s % 4 WHEN 0 THEN 'scotus' WHEN 1 THEN 'circuit' WHEN 2 THEN 'district' ELSE 'scotus' END AS authority_level FROM ({C.mentions_sql()}) WHERE h < 4")
def cite_derived_keys(spark, sf_dir):
    m = found(spark, sf_dir).filter("type = 'case'")
    return m.select(E.case_key(F.col("volume"), F.col("reporter"), F.col("start_page")).alias("case_key"), E.authority_level(F.col("type"), F.col("reporter")).alias("authority_level")).distinct()


@query("cite_unique", f"SELECT DISTINCT 100 + s AS volume, {C.REP} AS reporter, 10 + 7 * s AS start_page FROM ({C.mentions_sql()}) WHERE h < 4")
def cite_unique(spark, sf_dir):
    return R.unique_citations(found(spark, sf_dir)).select(F.col("volume").cast("long").alias("volume"), "reporter", F.col("start_page").cast("long").alias("start_page"))


SIGNAL_NAME = "CASE k % 5 WHEN 1 THEN 'see' WHEN 2 THEN 'cf' WHEN 3 THEN 'but-see' WHEN 4 THEN 'see-generally' ELSE 'none' END"


@query("cite_signal", f"SELECT brief_id, ord - 1 AS idx, {SIGNAL_NAME} AS signal FROM ({C.mentions_sql()})")
def cite_signal(spark, sf_dir):
    m = E.mentions(C.briefs(spark, sf_dir).drop("court"), context=("lead",))
    return m.select("brief_id", F.col("idx").cast("long").alias("idx"), E.signal(F.col("lead")).alias("signal"))


@query("cite_proposition", f"SELECT brief_id, ord - 1 AS idx, concat('Point ', ord, ' holds.') AS proposition FROM ({C.mentions_sql()})")
def cite_proposition(spark, sf_dir):
    p = F.regexp_replace(E.proposition(F.col("lead")), r"(?s)^.*## PAGE [0-9]+\s*", "")
    return E.mentions(C.briefs(spark, sf_dir).drop("court"), context=("lead",)).select("brief_id", F.col("idx").cast("long").alias("idx"), p.alias("proposition"))


# ---- families without a counterpart in the briefs: made of part numbers


def _made(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return C.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(text).alias("text"))


def _made_found(spark, sf_dir, text) -> DataFrame:
    return E.components(E.mentions(_made(spark, sf_dir, text)))


RULES = "concat('Under Rules ', 400 + p_partkey % 10, '–', 400 + p_partkey % 10 + p_partkey % 4, ' and Fed. R. Civ. P. ', 1 + p_partkey % 80, '(b)(', 1 + p_partkey % 6, ') this follows.')"


@query(
    "cite_extract_rule_expand",
    "SELECT p_partkey AS doc_id, 'Rules' AS rule_set, CAST(400 + p_partkey % 10 + i AS VARCHAR) AS rule_number FROM part, (VALUES (0), (1), (2), (3)) t(i) WHERE i <= p_partkey % 4 UNION ALL SELECT p_partkey, 'Fed. R. Civ. P.', CAST(1 + p_partkey % 80 AS VARCHAR) FROM part",
)
def cite_extract_rule_expand(spark, sf_dir):
    return E.split_rules(_made_found(spark, sf_dir, RULES).filter("type = 'rule'")).select("doc_id", "rule_set", "rule_number")


CONST = "concat('The ', CASE p_partkey % 3 WHEN 0 THEN 'First' WHEN 1 THEN 'Fourth' ELSE 'Twenty-First' END, ' Amendment and Article ', CASE p_partkey % 2 WHEN 0 THEN 'III' ELSE 'I' END, ' apply; so does U.S. Const. art. I, § ', 1 + p_partkey % 10, ', cl. 8.')"


@query(
    "cite_extract_const",
    "SELECT p_partkey AS doc_id, 0 AS idx, concat('U.S. Const. amend. ', CASE p_partkey % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'IV' ELSE 'XXI' END) AS formal, true AS informal FROM part UNION ALL SELECT p_partkey, 1, concat('U.S. Const. art. ', CASE p_partkey % 2 WHEN 0 THEN 'III' ELSE 'I' END), true FROM part UNION ALL SELECT p_partkey, 2, concat('U.S. Const. art. I, § ', 1 + p_partkey % 10, ', cl. 8'), false FROM part",
)
def cite_extract_const(spark, sf_dir):
    m = E.mentions(_made(spark, sf_dir, CONST)).filter("type = 'constitutional'")
    formal = F.when(F.col("family") == "P07", E.informal_constitution(F.col("full_citation"))).otherwise(F.col("full_citation"))
    return m.select("doc_id", "idx", formal.alias("formal"), (F.col("family") == "P07").alias("informal"))


LEGISLATIVE = "concat('See H.R. Rep. No. ', 80 + p_partkey % 30, '-', 1 + p_partkey % 999, ', at ', 1 + p_partkey % 50, ' (1976); ', 100 + p_partkey % 60, ' Cong. Rec. S', 1 + p_partkey, ' (1974).')"


@query("cite_extract_legislative", "SELECT p_partkey AS doc_id, 'P17' AS family, concat('H.R. Rep. No. ', 80 + p_partkey % 30, '-', 1 + p_partkey % 999, ', at ', 1 + p_partkey % 50, ' (1976)') AS full_citation FROM part UNION ALL SELECT p_partkey, 'P16', concat(100 + p_partkey % 60, ' Cong. Rec. S', 1 + p_partkey, ' (1974)') FROM part")
def cite_extract_legislative(spark, sf_dir):
    return E.mentions(_made(spark, sf_dir, LEGISLATIVE)).filter("type = 'legislative'").select("doc_id", "family", "full_citation")


SECONDARY = "concat('See Jane Roe, The Law of Part ', p_partkey, ', ', 10 + p_partkey % 90, ' Harv. L. Rev. ', 100 + p_partkey % 900, ' (', 1960 + p_partkey % 60, '); Restatement (Second) of Torts § ', 1 + p_partkey % 900, ' (1965); https://example.org/p', p_partkey, '.')"


@query(
    "cite_extract_secondary",
    "SELECT p_partkey AS doc_id, 'P19' AS family, 'Jane Roe' AS author, concat('The Law of Part ', p_partkey) AS work_title, CAST(NULL AS VARCHAR) AS url, 1960 + p_partkey % 60 AS year FROM part UNION ALL SELECT p_partkey, 'P21', NULL, 'Restatement (Second) of Torts', NULL, 1965 FROM part UNION ALL SELECT p_partkey, 'P22', NULL, NULL, concat('https://example.org/p', p_partkey), NULL FROM part",
)
def cite_extract_secondary(spark, sf_dir):
    return _made_found(spark, sf_dir, SECONDARY).filter("type = 'secondary'").select("doc_id", "family", "author", "work_title", "url", F.col("year").cast("long").alias("year"))


SUBSECTIONS = "concat('Compare 47 U.S.C. §§ ', 300 + p_partkey % 99, '(a), (d), and (e) with 17 U.S.C. § ', 500 + p_partkey % 50, '.')"


@query("cite_subsection_explode", "SELECT p_partkey AS doc_id, CAST(300 + p_partkey % 99 AS VARCHAR) AS section, sub AS subsection FROM part, (VALUES ('(a)'), ('(d)'), ('(e)')) t(sub) UNION ALL SELECT p_partkey, CAST(500 + p_partkey % 50 AS VARCHAR), NULL FROM part")
def cite_subsection_explode(spark, sf_dir):
    return E.split_subsections(_made_found(spark, sf_dir, SUBSECTIONS)).select("doc_id", "section", "subsection")


STATUTES = "concat('Under 17 U.S.C. § ', 500 + p_partkey % 50, CASE p_partkey % 2 WHEN 0 THEN '' ELSE ' ' END, '(b)', ' and the Lanham Act, also Cal. Civ. Code § ', 1000 + p_partkey % 700, ' applies.')"


@query("cite_statute_families", "SELECT p_partkey AS doc_id, 'P11' AS family, '15 U.S.C. § 1051' AS stands_for FROM part UNION ALL SELECT p_partkey, 'P10', concat('Cal. Civ. Code § ', 1000 + p_partkey % 700) FROM part UNION ALL SELECT p_partkey, 'P09', concat('17 U.S.C. § ', 500 + p_partkey % 50, CASE p_partkey % 2 WHEN 0 THEN '(b)' ELSE '' END) FROM part")
def cite_statute_families(spark, sf_dir):
    m = E.mentions(_made(spark, sf_dir, STATUTES))
    return m.select("doc_id", "family", F.coalesce(E.popular_names()[F.col("full_citation")], F.col("full_citation")).alias("stands_for"))


AGENCY = "concat('IPR2015-', 10000 + p_partkey, '; ', 2000 + p_partkey % 20, ' WL ', 100000 + p_partkey, '; Case C-', 1 + p_partkey % 600, '/12; App. no. ', 1 + p_partkey, '/07; ', 60 + p_partkey % 30, ' Fed. Reg. ', 1000 + p_partkey, '.')"


@query(
    "cite_agency_foreign",
    "SELECT p_partkey AS doc_id, 'P03' AS family, concat('IPR2015-', 10000 + p_partkey) AS full_citation FROM part UNION ALL SELECT p_partkey, 'P02', concat(2000 + p_partkey % 20, ' WL ', 100000 + p_partkey) FROM part UNION ALL SELECT p_partkey, 'P04', concat('Case C-', 1 + p_partkey % 600, '/12') FROM part UNION ALL SELECT p_partkey, 'P05', concat('App. no. ', 1 + p_partkey, '/07') FROM part UNION ALL SELECT p_partkey, 'P15', concat(60 + p_partkey % 30, ' Fed. Reg. ', 1000 + p_partkey) FROM part",
)
def cite_agency_foreign(spark, sf_dir):
    return E.mentions(_made(spark, sf_dir, AGENCY)).select("doc_id", "family", "full_citation")


PIN = "CASE p_partkey % 6 WHEN 0 THEN concat(p_partkey, ', ', p_partkey + 7) WHEN 1 THEN concat(p_partkey, '–', p_partkey % 100) WHEN 2 THEN concat('at ', p_partkey) WHEN 3 THEN concat(p_partkey, ' n.4') WHEN 4 THEN '' ELSE concat(p_partkey, '-', p_partkey + 3, ', ', p_partkey + 9) END"


@query("cite_split_pin", "SELECT p_partkey AS doc_id, CASE p_partkey % 6 WHEN 0 THEN concat(p_partkey, ',', p_partkey + 7) WHEN 1 THEN CAST(p_partkey AS VARCHAR) WHEN 2 THEN CAST(p_partkey AS VARCHAR) WHEN 5 THEN concat(p_partkey, ',', p_partkey + 9) ELSE '' END AS pages FROM part")
def cite_split_pin(spark, sf_dir):
    return _made(spark, sf_dir, PIN).select("doc_id", joined(X.pincites(F.col("text"))).alias("pages"))


NUMBER = "CASE p_partkey % 5 WHEN 0 THEN concat(' ', p_partkey, ' ') WHEN 1 THEN concat(p_partkey, '.5') WHEN 2 THEN concat(p_partkey, '_000') WHEN 3 THEN concat('+', p_partkey) ELSE '' END"


@query("cite_to_int", "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 5 IN (0, 3) THEN CAST(p_partkey AS INT) END AS value FROM part")
def cite_to_int(spark, sf_dir):
    return _made(spark, sf_dir, NUMBER).select("doc_id", X.to_int(F.col("text")).alias("value"))


PARENS = "CASE p_partkey % 5 WHEN 0 THEN '(quoting A v. B, 1 U.S. 2)' WHEN 1 THEN '(citing A v. B)' WHEN 2 THEN '(holding that it is so)' WHEN 3 THEN '(Overruling A v. B)' ELSE '(en banc)' END"


@query("cite_parenthetical", "SELECT p_partkey AS doc_id, CASE p_partkey % 5 WHEN 0 THEN 'entry' WHEN 1 THEN 'flag' WHEN 2 THEN 'attribute' WHEN 3 THEN 'flag' ELSE 'none' END AS kind FROM part")
def cite_parenthetical(spark, sf_dir):
    return _made(spark, sf_dir, PARENS).select("doc_id", E.parenthetical_kind(F.col("text")).alias("kind"))


HISTORY = "concat('See Roe v. Doe, ', 100 + p_partkey % 300, ' F.3d ', 1 + p_partkey, ' (2d Cir. 1999)', CASE p_partkey % 4 WHEN 0 THEN ', cert. denied, 5 U.S. 6' WHEN 1 THEN ', aff''d, 7 U.S. 8' WHEN 2 THEN ', vacated' ELSE '.' END)"


@query("cite_history", "SELECT p_partkey AS doc_id, concat(100 + p_partkey % 300, ' F.3d ', 1 + p_partkey) AS case_key, '2d Cir.' AS court, CASE p_partkey % 4 WHEN 0 THEN 'cert. denied' WHEN 1 THEN 'aff''d' WHEN 2 THEN 'vacated' END AS subsequent_history FROM part")
def cite_history(spark, sf_dir):
    m = E.components(E.mentions(_made(spark, sf_dir, HISTORY), context=("tail",))).filter("idx = 0")
    return m.select("doc_id", E.case_key(F.col("volume"), F.col("reporter"), F.col("start_page")).alias("case_key"), "court", E.history(F.col("tail")).alias("subsequent_history"))


STRING = "concat('This is so. See Roe v. Doe, ', 1 + p_partkey % 300, ' F.3d 1 (1999)', CASE p_partkey % 2 WHEN 0 THEN '; ' ELSE '. ' END, 'Roe v. Poe, 7 F.3d 8 (2000)', CASE p_partkey % 3 WHEN 0 THEN '; see also ' ELSE '. Cf. ' END, 'Poe v. Doe, 9 U.S. 10 (2001).')"


@query(
    "cite_string_groups",
    "SELECT p_partkey AS doc_id, i AS idx, CASE WHEN i = 0 THEN 1 WHEN i = 1 THEN 1 + p_partkey % 2 ELSE 1 + p_partkey % 2 + CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END END AS group_no, CASE WHEN (i = 0 AND p_partkey % 2 = 0) OR (i = 1 AND (p_partkey % 2 = 0 OR p_partkey % 3 = 0)) OR (i = 2 AND p_partkey % 3 = 0) THEN true ELSE false END AS shares_proposition FROM part, (VALUES (0), (1), (2)) t(i)",
)
def cite_string_groups(spark, sf_dir):
    out = R.string_groups(E.mentions(_made(spark, sf_dir, STRING), context=("gap",)))
    return out.select("doc_id", "idx", "group_no", F.col("proposition_group").isNotNull().alias("shares_proposition"))


@query("cite_gap_antijoin", f"SELECT brief_id, span_start, span_end, 'grammar' AS origin FROM ({PLACED}) WHERE h < 4 UNION ALL SELECT brief_id, span_start, span_end, 'gap' FROM ({PLACED}) WHERE h >= 4")
def cite_gap_antijoin(spark, sf_dir):
    m = found(spark, sf_dir).select("brief_id", "type", F.col("span_start").cast("long").alias("span_start"), F.col("span_end").cast("long").alias("span_end"))
    both = E.with_gap_pass(m.filter("type = 'case'").withColumn("origin", F.lit("grammar")), m.withColumn("origin", F.lit("gap")), "brief_id")
    return both.select("brief_id", "span_start", "span_end", "origin")


# ---- resolution


def resolved(spark: SparkSession, sf_dir: str, variant: str = DENSE) -> DataFrame:
    m = E.reclassified(E.components(E.mentions(C.briefs(spark, sf_dir, variant), context=("page",))))
    return R.resolve(checkpointed(m), "brief_id")  # read three times: extract once


def resolved_sql(variant: str = DENSE) -> str:
    """brief_id, ord, page, h, s, cite_text, key: null key if unresolved."""
    m = f"SELECT *, min(CASE WHEN h < 4 THEN ord END) OVER (PARTITION BY brief_id, s) AS first_full FROM ({C.mentions_sql(variant)})"
    own = f"SELECT *, CASE WHEN h < 4 THEN concat('case ', s) WHEN h IN (4, 5, 8) THEN CASE WHEN first_full < ord THEN concat('case ', s) ELSE '?' END WHEN h IN (9, 10) THEN cite_text WHEN h = 11 THEN '-' END AS own FROM ({m})"
    island = f"SELECT *, sum(CASE WHEN own IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY brief_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS island FROM ({own})"
    return f"SELECT *, nullif(nullif(max(own) OVER (PARTITION BY brief_id, island), '?'), '-') AS key FROM ({island})"


ANCHORED = f"SELECT *, min(CASE WHEN h < 4 OR h IN (9, 10) THEN ord END) OVER (PARTITION BY brief_id, key) AS anchor FROM ({resolved_sql()})"
TO = "CASE WHEN key IS NOT NULL AND anchor <> ord THEN anchor - 1 END"


def _pointers(spark, sf_dir, kinds: tuple[str, ...]) -> DataFrame:
    r = resolved(spark, sf_dir).filter(F.col("type").isin(*kinds))
    return r.select("brief_id", F.col("idx").cast("long").alias("idx"), F.col("resolved_index").cast("long").alias("resolved_index"))


@query("resolve_groups", f"SELECT brief_id, ord - 1 AS idx, {TO} AS resolved_index FROM ({ANCHORED}) WHERE h < 4 OR h IN (9, 10)")
def resolve_groups(spark, sf_dir):
    return _pointers(spark, sf_dir, R.FULL)


@query("resolve_id", f"SELECT brief_id, ord - 1 AS idx, {TO} AS resolved_index FROM ({ANCHORED}) WHERE h IN (6, 7)")
def resolve_id(spark, sf_dir):
    return _pointers(spark, sf_dir, ("id",))


@query("resolve_short_case", f"SELECT brief_id, ord - 1 AS idx, {TO} AS resolved_index FROM ({ANCHORED}) WHERE h IN (4, 5)")
def resolve_short_case(spark, sf_dir):
    return _pointers(spark, sf_dir, ("short_case",))


@query("resolve_supra", f"SELECT brief_id, ord - 1 AS idx, {TO} AS resolved_index FROM ({ANCHORED}) WHERE h = 8")
def resolve_supra(spark, sf_dir):
    return _pointers(spark, sf_dir, ("supra",))


@query("resolve_id_non_authority", f"SELECT brief_id, ord - 1 AS idx FROM (SELECT *, lag(h) OVER (PARTITION BY brief_id ORDER BY ord) AS before FROM ({C.mentions_sql(DENSE)})) WHERE h IN (6, 7) AND before = 11")
def resolve_id_non_authority(spark, sf_dir):
    from pyspark.sql import Window

    r = resolved(spark, sf_dir).withColumn("before", F.lag("type").over(Window.partitionBy("brief_id").orderBy("idx")))
    return r.filter("type = 'id' AND before = 'non_authority' AND authority_key IS NULL").select("brief_id", F.col("idx").cast("long").alias("idx"))


@query("resolve_unresolved_flags", f"SELECT brief_id, count(*) AS n_short, sum(CASE WHEN {TO} IS NULL THEN 1 ELSE 0 END) AS n_flagged FROM ({ANCHORED}) WHERE h BETWEEN 4 AND 8 GROUP BY brief_id")
def resolve_unresolved_flags(spark, sf_dir):
    r = resolved(spark, sf_dir).filter(F.col("type").isin(*R.SHORT))
    return r.groupBy("brief_id").agg(F.count(F.lit(1)).alias("n_short"), F.count_if(F.array_contains("flags", "unresolved_short_form")).alias("n_flagged"))


# ---- pages and sections


PAGES = "SELECT brief_id, page, mark + length(concat('## PAGE ', page)) AS start, coalesce(lead(mark) OVER (PARTITION BY brief_id ORDER BY page), total) AS stop FROM (SELECT brief_id, page, ord, before + CASE WHEN ord = 1 THEN 0 ELSE 1 END AS mark, max(span_end + 2) OVER (PARTITION BY brief_id) AS total FROM ({p})) WHERE ord % 2 = 1"


@query("page_split", f"SELECT brief_id, page, start, stop FROM ({PAGES.format(p=PLACED)})")
def page_split(spark, sf_dir):
    p = S.pages(C.briefs(spark, sf_dir), "brief_id")
    return p.select("brief_id", "page", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"))


@query("offset_to_page", f"SELECT brief_id, ord - 1 AS idx, page FROM ({C.mentions_sql(DENSE)})")
def offset_to_page(spark, sf_dir):
    return resolved(spark, sf_dir).select("brief_id", F.col("idx").cast("long").alias("idx"), "page")


@query("page_straddle", f"SELECT m.brief_id, m.ord - 1 AS idx, string_agg(CAST(p.page AS VARCHAR), ',' ORDER BY p.page) AS pages FROM ({PLACED}) m JOIN ({PAGES.format(p=PLACED)}) p ON m.brief_id = p.brief_id AND p.start < m.span_end + 20 AND p.stop > m.span_start GROUP BY 1, 2")
def page_straddle(spark, sf_dir):
    b = C.briefs(spark, sf_dir)
    m = E.mentions(b.drop("court")).withColumn("span_end", F.col("span_end") + 20)
    out = S.straddling(m, S.pages(b, "brief_id"), "brief_id")
    return out.select("brief_id", F.col("idx").cast("long").alias("idx"), joined(F.col("pages")).alias("pages"))


LAST = f"SELECT brief_id, max(page) AS last FROM ({C.mentions_sql()}) GROUP BY brief_id"


@query("section_ranges", f"SELECT brief_id, n AS section_no, heading, CASE WHEN n = 1 THEN NULL WHEN n = 2 THEN 1 ELSE last END AS page_start, CASE WHEN n = 1 THEN NULL ELSE last END AS page_end FROM ({LAST}), (VALUES (1, 'TABLE OF CONTENTS'), (2, 'ARGUMENT'), (3, 'CONCLUSION'), (4, 'CERTIFICATE OF SERVICE')) t(n, heading)")
def section_ranges(spark, sf_dir):
    r = S.section_ranges(C.briefs(spark, sf_dir, framed=True), "brief_id")
    return r.select("brief_id", F.col("section_no").cast("int").alias("section_no"), "heading", "page_start", "page_end")


@query("section_of_mention", f"SELECT m.brief_id, count(*) FILTER (WHERE page < last) AS n_argument, count(*) FILTER (WHERE page = last) AS n_last FROM ({C.mentions_sql()}) m JOIN ({LAST}) l ON m.brief_id = l.brief_id GROUP BY 1")
def section_of_mention(spark, sf_dir):
    b = C.briefs(spark, sf_dir, framed=True)
    m = E.mentions(b, context=("page",)).filter("page IS NOT NULL").select("brief_id", "idx", "page", "full_citation")
    of = S.section_of(m.filter("NOT full_citation LIKE 'Decoy%'"), S.section_ranges(b, "brief_id").filter("heading <> 'CERTIFICATE OF SERVICE'"), "brief_id")
    return of.groupBy("brief_id").agg(F.count_if(F.col("heading") == "ARGUMENT").alias("n_argument"), F.count_if(F.col("heading") == "CONCLUSION").alias("n_last"))


@query("body_sections", f"SELECT brief_id, count(*) FILTER (WHERE h < 4) AS n_cases FROM ({C.mentions_sql()}) GROUP BY brief_id")
def body_sections(spark, sf_dir):
    kept = S.body_text(C.briefs(spark, sf_dir, framed=True), "brief_id")
    return E.mentions(kept).groupBy("brief_id").agg(F.count_if(F.col("type") == "case").alias("n_cases"))


#: Words of a brief around every mention: its text without page lines, cut at the citation.
AROUND = f"SELECT brief_id, ord, cite_text, list_filter(string_split_regex(substr(body, 1, CAST(pos0 AS BIGINT)), '\\s+'), lambda x: x <> '') AS b, list_filter(string_split_regex(substr(body, CAST(pos0 AS BIGINT) + length(cite_text) + 1), '\\s+'), lambda x: x <> '') AS a FROM (SELECT brief_id, ord, cite_text, coalesce(sum(length(seg)) OVER (PARTITION BY brief_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(seg) - length(cite_text) - 2 AS pos0, string_agg(seg, '' ORDER BY ord) OVER (PARTITION BY brief_id) AS body FROM (SELECT *, concat('Point ', ord, ' holds. ', {C.SIGNAL}, cite_text, '. ') AS seg FROM ({C.mentions_sql()})))"


@query("snippet", f"SELECT brief_id, ord - 1 AS idx, concat_ws(' ', nullif(array_to_string(list_slice(b, -30, -1), ' '), ''), cite_text, nullif(array_to_string(list_slice(a, 1, 30), ' '), '')) AS snippet FROM ({AROUND})")
def snippet(spark, sf_dir):
    b = C.briefs(spark, sf_dir).drop("court").withColumn("text", F.regexp_replace("text", r"\n?## PAGE [0-9]+\s", ""))
    return E.mentions(b, context=("snippet",)).select("brief_id", F.col("idx").cast("long").alias("idx"), "snippet")


# ---- tables of authorities


CAT = "CASE WHEN h < 4 THEN 'Cases' WHEN h = 9 THEN 'Statutes' ELSE 'Rules and Regulations' END"
RANK = "CASE WHEN h < 4 THEN 1 WHEN h = 9 THEN 4 ELSE 5 END"
CITED = f"CASE WHEN h < 4 THEN concat('Supplier', s, ' v. Nation', s % 25, ', ', 100 + s, ' ', {C.REP}, ' ', 10 + 7 * s, ' (', 1950 + s % 70, ')') ELSE cite_text END"
#: One row for each brief and authority.
GROUPED = f"""SELECT brief_id, key, arg_min({CAT}, ord) FILTER (WHERE h NOT BETWEEN 4 AND 8) AS category, arg_min({RANK}, ord) FILTER (WHERE h NOT BETWEEN 4 AND 8) AS cat_rank, arg_min({CITED}, ord) FILTER (WHERE h NOT BETWEEN 4 AND 8) AS citation, count(*) AS n_mentions, count(DISTINCT page) AS n_pages
  FROM ({resolved_sql()}) WHERE key IS NOT NULL GROUP BY brief_id, key"""
PAGE_LIST = f"SELECT brief_id, key, string_agg(CAST(page AS VARCHAR), ', ' ORDER BY page) AS pages FROM (SELECT DISTINCT brief_id, key, page FROM ({resolved_sql()}) WHERE key IS NOT NULL) GROUP BY brief_id, key"
SORTED = f"""SELECT g.*, p.pages, row_number() OVER (PARTITION BY g.brief_id ORDER BY cat_rank, CASE WHEN cat_rank = 5 THEN 1 ELSE 0 END, CASE WHEN cat_rank = 1 THEN 0 ELSE CAST(split_part(citation, ' ', 1) AS INT) END,
  CASE WHEN cat_rank = 1 THEN 0 ELSE CAST(regexp_extract(citation, '§ ([0-9]+)', 1) AS INT) END, lower(citation), citation) AS position FROM ({GROUPED}) g JOIN ({PAGE_LIST}) p ON g.brief_id = p.brief_id AND g.key = p.key"""


def toa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered table of every dense brief, with its court's rule and page text."""
    r = resolved(spark, sf_dir)
    table = T.ordered(T.authorities(r, "brief_id"), "brief_id").withColumn("court", F.expr(C.COURT))
    return T.with_court_rule(table).withColumn("page_text", T.passim(F.col("pages"), F.col("rule")))


@query("toa_basic", f"SELECT brief_id, category, citation, pages, n_mentions, position FROM ({SORTED})")
def toa_basic(spark, sf_dir):
    return toa(spark, sf_dir).select("brief_id", "category", "citation", joined(F.col("pages"), ", ").alias("pages"), "n_mentions", F.col("position").cast("long").alias("position"))


@query("toa_passim", f"SELECT brief_id, citation, CASE WHEN brief_id % 4 = 3 AND n_pages >= 5 THEN 'passim' ELSE pages END AS page_text FROM ({SORTED})")
def toa_passim(spark, sf_dir):
    return toa(spark, sf_dir).select("brief_id", "citation", "page_text")


@query("toa_categories", f"SELECT brief_id, category, count(*) AS n FROM ({GROUPED}) GROUP BY 1, 2")
def toa_categories(spark, sf_dir):
    return T.authorities(resolved(spark, sf_dir), "brief_id").groupBy("brief_id", "category").agg(F.count(F.lit(1)).alias("n"))


@query("toa_sorted", f"SELECT brief_id, cat_rank, position, citation FROM ({SORTED})")
def toa_sorted(spark, sf_dir):
    return toa(spark, sf_dir).select("brief_id", F.col("cat_rank").cast("int").alias("cat_rank"), F.col("position").cast("long").alias("position"), "citation")


LINE = "concat(citation, ' ', repeat('.', greatest(3, 76 - length(citation) - length(pt))), ' ', pt)"


@query("toa_text", f"SELECT brief_id, string_agg(CASE WHEN first THEN concat(upper(category), chr(10), line) ELSE line END, chr(10) ORDER BY position) AS text FROM (SELECT *, {LINE} AS line, row_number() OVER (PARTITION BY brief_id, category ORDER BY position) = 1 AS first FROM (SELECT *, CASE WHEN brief_id % 4 = 3 AND n_pages >= 5 THEN 'passim' ELSE pages END AS pt FROM ({SORTED}))) GROUP BY brief_id")
def toa_text(spark, sf_dir):
    t = toa(spark, sf_dir)
    return T.rendered(t.withColumn("line", T.text_line(F.col("citation"), F.col("page_text"))), "brief_id")


@query("toa_short_forms", f"SELECT brief_id, key, string_agg(cite_text, '|' ORDER BY o) AS short_forms FROM (SELECT brief_id, replace(key, 'case ', '') AS key, cite_text, min(ord) AS o FROM ({resolved_sql()}) WHERE key LIKE 'case %' AND h BETWEEN 4 AND 8 GROUP BY 1, 2, 3) GROUP BY 1, 2")
def toa_short_forms(spark, sf_dir):
    t = T.authorities(resolved(spark, sf_dir), "brief_id").filter("type = 'case' AND size(short_forms_found) > 0")
    return t.select("brief_id", F.regexp_extract("citation", r"^Supplier([0-9]+)", 1).alias("key"), F.array_join("short_forms_found", "|").alias("short_forms"))


#: Rows of the tables as a careless hand left them: what it did to the table of brief n, by n % 8.
CARELESS = "CASE brief_id % 8 WHEN 1 THEN 'duplicate_pages,unsorted_pages' WHEN 2 THEN 'no_pages' WHEN 3 THEN 'unknown_category' WHEN 4 THEN 'passim_not_allowed' END"


@query("toa_checklist_violations", f"SELECT brief_id, citation, broken FROM (SELECT *, CASE WHEN brief_id % 8 = 1 THEN CASE WHEN n_pages > 1 THEN 'duplicate_pages,unsorted_pages' ELSE 'duplicate_pages' END WHEN brief_id % 8 = 5 THEN CASE WHEN lag(cat_rank) OVER (PARTITION BY brief_id ORDER BY position DESC) > cat_rank THEN 'category_order' END ELSE {CARELESS} END AS broken FROM ({SORTED})) WHERE broken IS NOT NULL")
def toa_checklist_violations(spark, sf_dir):
    n = F.col("brief_id") % 8
    t = toa(spark, sf_dir)
    t = t.withColumn("pages", F.when(n == 1, F.concat("pages", F.slice("pages", 1, 1))).when(n == 2, F.array().cast("array<int>")).otherwise(F.col("pages"))).withColumn("cat_rank", F.when(n == 3, 0).otherwise(F.col("cat_rank")))
    t = t.withColumn("page_text", F.when(n == 4, "passim").otherwise(F.col("page_text"))).withColumn("position", F.when(n == 5, -F.col("position")).otherwise(F.col("position")))
    return T.violations(t, "brief_id").select("brief_id", "citation", F.array_join("broken", ",").alias("broken"))


@query("toa_clean_checklist", f"SELECT brief_id, count(*) AS n_authorities, 0 AS n_broken FROM ({SORTED}) GROUP BY 1")
def toa_clean_checklist(spark, sf_dir):
    t = toa(spark, sf_dir)
    broken = T.violations(t, "brief_id").groupBy("brief_id").agg(F.count(F.lit(1)).cast("int").alias("n_broken"))
    return t.groupBy("brief_id").agg(F.count(F.lit(1)).alias("n_authorities")).join(broken, "brief_id", "left").select("brief_id", "n_authorities", F.coalesce("n_broken", F.lit(0)).alias("n_broken"))


@query("toa_json", f"""SELECT brief_id, concat('[', string_agg(concat('{{"citation":"', citation, '","category":"', category, '","pages":[', replace(pages, ' ', ''), '],"n_mentions":', n_mentions, '}}'), ',' ORDER BY position), ']') AS json FROM ({SORTED}) GROUP BY brief_id""")
def toa_json(spark, sf_dir):
    return K.json_arrays(toa(spark, sf_dir), "brief_id", "position", ["citation", "category", "pages", "n_mentions"])
