"""Queries over lookup, verification and report tables, made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.operators import sections as L
from citeloom.operators import verify as V
from citeloom.plans import corpus as C
from citeloom.registry import query
from citeloom.sources import readers
from citeloom.sources import sinks as K

CLUSTERS = C.clusters_sql()
ASKED = f"SELECT DISTINCT 100 + s AS volume, {C.REP} AS reporter, 10 + 7 * s AS start_page, s FROM (SELECT l_suppkey + CASE WHEN l_partkey % 5 = 0 THEN 100000 ELSE 0 END AS s FROM lineitem WHERE l_partkey % 12 < 4)"


def _asked(spark, sf_dir):
    s = C.table(spark, sf_dir, "lineitem").filter("l_partkey % 12 < 4").select(F.expr("l_suppkey + CASE WHEN l_partkey % 5 = 0 THEN 100000 ELSE 0 END").alias("s"))
    return s.select((F.col("s") + 100).alias("volume"), F.expr(C.REP).alias("reporter"), (F.col("s") * 7 + 10).alias("start_page"), F.expr("concat('Supplier', s, ' v. Nation', s % 25)").alias("source_name"))


@query("lookup_components", f"SELECT a.volume, a.reporter, a.start_page, c.cluster_id, c.case_name FROM ({ASKED}) a LEFT JOIN ({CLUSTERS}) c ON a.volume = c.volume AND a.reporter = c.reporter AND a.start_page = c.page")
def lookup_components(spark, sf_dir):
    return V.lookup(_asked(spark, sf_dir), C.clusters(spark, sf_dir)).select("volume", "reporter", "start_page", "cluster_id", "case_name")


@query("identity_check", f"SELECT a.s AS s, c.cluster_id IS NOT NULL AND a.s % 7 <> 0 AS same FROM ({ASKED}) a LEFT JOIN ({CLUSTERS}) c ON a.volume = c.volume AND a.reporter = c.reporter AND a.start_page = c.page")
def identity_check(spark, sf_dir):
    cited = _asked(spark, sf_dir).distinct().withColumn("s", F.col("volume") - 100).withColumn("source_name", F.when(F.col("s") % 7 == 0, "Nobody v. Else").otherwise(F.col("source_name")))
    hit = V.lookup(cited, C.clusters(spark, sf_dir))
    return cited.join(hit, ["volume", "reporter", "start_page"]).select("s", V.identity(cited).alias("same"))


@query("sub_opinion_choice", "SELECT 500000 + s_suppkey AS cluster_id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey + 1 ELSE s_suppkey END AS opinion_id FROM supplier WHERE s_suppkey + 1 < (SELECT count(*) FROM supplier)")
def sub_opinion_choice(spark, sf_dir):
    n = C.table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"))
    o = C.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("opinion_id"), F.when(F.col("s_suppkey") % 3 == 0, "040dissent").otherwise("020lead").alias("type"))
    rows = V.sub_opinions(C.clusters(spark, sf_dir).join(F.broadcast(n), F.col("cluster_id") - 500000 + 1 < F.col("n")), o)
    return V.choose_sub_opinion(rows).select("cluster_id", "opinion_id")


ATTEMPTS = "SELECT l_orderkey AS doc_id, concat('c', l_partkey % 50) AS cite_id, l_linenumber AS priority, CASE l_linenumber % 3 WHEN 0 THEN 'lii' WHEN 1 THEN 'justia' ELSE 'direct-court' END AS source, l_suppkey % 4 = 0 AS ok FROM lineitem"


@query("escalation_first_ok", f"SELECT doc_id, cite_id, coalesce(arg_min(source, priority) FILTER (WHERE ok), 'unverifiable') AS source, count(*) AS n_tried FROM ({ATTEMPTS}) GROUP BY 1, 2")
def escalation_first_ok(spark, sf_dir):
    a = C.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.expr("concat('c', l_partkey % 50)").alias("cite_id"), F.col("l_linenumber").alias("priority"), F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'lii' WHEN 1 THEN 'justia' ELSE 'direct-court' END").alias("source"), F.expr("l_suppkey % 4 = 0").alias("ok"))
    e = V.escalate(a)
    return e.select("doc_id", "cite_id", "source", F.size("tried").cast("long").alias("n_tried"))


@query("unverifiable_appendix", f"SELECT doc_id, cite_id, string_agg(source, ', ' ORDER BY priority, source) AS tried FROM ({ATTEMPTS}) GROUP BY 1, 2 HAVING NOT bool_or(ok)")
def unverifiable_appendix(spark, sf_dir):
    a = C.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.expr("concat('c', l_partkey % 50)").alias("cite_id"), F.col("l_linenumber").alias("priority"), F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'lii' WHEN 1 THEN 'justia' ELSE 'direct-court' END").alias("source"), F.expr("l_suppkey % 4 = 0").alias("ok"))
    return V.escalate(a).filter("source = 'unverifiable'").select("doc_id", "cite_id", F.array_join("tried", ", ").alias("tried"))


# ---- statutes

TYPE = "CASE p_partkey % 4 WHEN 0 THEN 'statute' WHEN 1 THEN 'regulation' WHEN 2 THEN 'rule' ELSE 'statute' END"
SECTION = "CASE WHEN p_partkey % 8 = 3 THEN ' ' ELSE concat(' ', p_partkey, ' ') END"
SUB = "CASE p_partkey % 5 WHEN 0 THEN '(c)(2)' WHEN 1 THEN '(b)(2)(C)(i)' WHEN 2 THEN 'c_2' WHEN 3 THEN '' ELSE '(' END"
URL = f"CASE WHEN trim({SECTION}) = '' THEN NULL WHEN {TYPE} = 'statute' THEN concat('https://www.law.cornell.edu/uscode/text/17/', p_partkey) WHEN {TYPE} = 'regulation' THEN concat('https://www.law.cornell.edu/cfr/text/17/', p_partkey) END"


def _requests(spark, sf_dir):
    return C.table(spark, sf_dir, "part").select(F.expr("concat('r', p_partkey)").alias("id"), F.expr(TYPE).alias("type"), F.lit("17").alias("title"), F.expr(SECTION).alias("section"), F.expr(SUB).alias("subsection"), "p_partkey")


@query("lii_url", f"SELECT concat('r', p_partkey) AS id, {URL} AS url FROM part")
def lii_url(spark, sf_dir):
    return _requests(spark, sf_dir).select("id", L.resolve_url(F.col("type"), F.col("title"), F.col("section")).alias("url"))


ANCHOR = "CASE p_partkey % 5 WHEN 0 THEN 'c_2' WHEN 1 THEN 'b_2_C_i' WHEN 2 THEN 'c_2' END"


@query("lii_anchor", f"SELECT concat('r', p_partkey) AS id, {ANCHOR} AS anchor FROM part")
def lii_anchor(spark, sf_dir):
    return _requests(spark, sf_dir).select("id", L.anchor(F.col("subsection")).alias("anchor"))


BODY = "CASE WHEN p_partkey % 7 = 5 THEN 'too short' ELSE concat('Section ', p_partkey, ' says at some length what is asked here, and it says so in more than eighty characters. ') END"
PART = """CASE p_partkey % 3 WHEN 0 THEN '<div class="subsection"><a name="c_2"></a>Part c two.</div>' WHEN 1 THEN '<p class="psection-1"><span class="enumxml" id="c_2">Part c</span> two.</p>' ELSE '<div class="paragraph indent1"><a name="c_2"></a><b>Part c</b> two.</div>' END"""
#: An element of the same id that is no anchor, the asked part, and another part behind it.
PAGE = f"""concat('<html><div class="section"><p id="c_2">', {BODY}, '</p>', {PART}, '<div class="paragraph"><a name="d"></a>Part d.</div></div></html>')"""
HTTP = "CASE p_partkey % 11 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 200 END"


def _fetched(spark, sf_dir):
    pages = C.table(spark, sf_dir, "part").filter("p_partkey % 13 <> 0").select(F.expr(URL).alias("url"), F.expr(HTTP).alias("http_status"), F.expr(PAGE).alias("html")).filter("url IS NOT NULL")
    return L.fetch(_requests(spark, sf_dir).drop("p_partkey"), pages)


STATUS = f"CASE WHEN {URL} IS NULL OR p_partkey % 13 = 0 THEN 'network_error' WHEN p_partkey % 11 = 0 THEN 'not_found' WHEN p_partkey % 11 = 1 THEN 'network_error' WHEN p_partkey % 7 = 5 THEN 'not_found' WHEN p_partkey % 5 = 1 THEN 'anchor_not_found' ELSE 'ok' END"


@query("lii_status", f"SELECT concat('r', p_partkey) AS id, {STATUS} AS status, {STATUS} = 'ok' AND p_partkey % 5 IN (0, 2) AS anchor_matched FROM part")
def lii_status(spark, sf_dir):
    return _fetched(spark, sf_dir).select("id", "status", "anchor_matched")


@query("lii_section_text", f"SELECT concat('r', p_partkey) AS id, concat(trim({BODY}), 'Part c two.Part d.') AS section_text, CASE WHEN {STATUS} = 'ok' AND p_partkey % 5 IN (0, 2) THEN 'Part c two.' END AS subsection_text FROM part WHERE {STATUS} IN ('ok', 'anchor_not_found')")
def lii_section_text(spark, sf_dir):
    got = _fetched(spark, sf_dir).filter("section_text IS NOT NULL")
    return got.select("id", F.regexp_replace("section_text", r"\. Part c", ".Part c").alias("section_text"), "subsection_text")


QUOTE = "CASE p_partkey % 6 WHEN 0 THEN 'what is asked here' WHEN 1 THEN '[w]hat is asked ... says so in more' WHEN 2 THEN 'What IS  asked here' WHEN 3 THEN 'says so ... what is asked' WHEN 4 THEN 'what is-asked, here' END"


@query("quote_match", "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 6 = 5 THEN NULL ELSE p_partkey % 7 <> 5 AND p_partkey % 6 < 3 END AS matched, CASE WHEN p_partkey % 6 = 5 THEN 'neutral' WHEN p_partkey % 7 <> 5 AND p_partkey % 6 < 3 THEN 'match' ELSE 'divergent' END AS mode FROM part")
def quote_match(spark, sf_dir):
    m = C.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), V.quote_match(F.expr(QUOTE), F.expr(BODY)).alias("matched"))
    return m.withColumn("mode", V.renderer_mode(F.col("matched")))


@query("benchmark_quotes", "SELECT d.doc_id, count(*) AS n FROM documents d JOIN benchmark b ON contains(lower(regexp_replace(d.text, '\\s+', ' ', 'g')), lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g')))) GROUP BY 1")
def benchmark_quotes(spark, sf_dir):
    flat = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    d = C.table(spark, sf_dir, "documents").select("doc_id", flat(F.col("text")).alias("t"))
    b = C.table(spark, sf_dir, "benchmark").select(F.trim(flat(F.col("text"))).alias("q"))
    return V.containing(d, b)


@query("statute_rubric", f"SELECT p_partkey AS doc_id, CASE WHEN {STATUS} <> 'ok' THEN 'Unable' WHEN p_partkey % 6 IN (0, 1, 2) THEN 'Strong' WHEN p_partkey % 6 IN (3, 4) THEN 'Misleading' END AS label, CASE WHEN {STATUS} <> 'ok' THEN NULL WHEN p_partkey % 6 = 3 THEN 'misquote' WHEN p_partkey % 6 = 4 THEN 'citation-form' END AS issue FROM part")
def statute_rubric(spark, sf_dir):
    asked = _requests(spark, sf_dir).select("id", F.col("p_partkey").alias("doc_id"), F.expr(QUOTE).alias("quote"))
    r = asked.join(_fetched(spark, sf_dir).select("id", "status", "section_text"), "id").select("doc_id", V.statute_rubric(F.col("status"), F.col("quote"), F.col("section_text")).alias("r"))
    return r.select("doc_id", "r.label", "r.issue")


# ---- labels and reports

LABEL = "CASE l_partkey % 6 WHEN 0 THEN 'Strong' WHEN 1 THEN 'Adequate' WHEN 2 THEN 'Weak' WHEN 3 THEN 'Misleading' ELSE 'Strong' END"
CHECKS = f"SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(C.ORDER_KEY)}) AS doc_index, concat('cite ', l_partkey) AS citation, CASE WHEN l_suppkey % 9 = 0 THEN 'Unable' ELSE {LABEL} END AS label, l_suppkey % 9 <> 0 AS found FROM lineitem"


def _checks(spark, sf_dir):
    t = C.table(spark, sf_dir, "lineitem")
    label = V.support_label(F.expr(LABEL), F.expr("l_suppkey % 9 <> 0"), F.lit(True))
    return t.select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*C.ORDER_KEY)).alias("doc_index"), F.expr("concat('cite ', l_partkey)").alias("citation"), label.alias("label"), F.expr("l_suppkey % 9 <> 0").alias("found"), F.lit(None).cast("string").alias("explanation"))


@query("label_counts", f"SELECT t.label, count(c.label) AS n FROM (VALUES ('Strong'), ('Adequate'), ('Weak'), ('Misleading'), ('Unable'), ('Unverifiable')) t(label) LEFT JOIN (SELECT label FROM ({CHECKS}) UNION ALL SELECT 'Unverifiable' FROM ({CHECKS}) WHERE NOT found) c ON t.label = c.label GROUP BY 1")
def label_counts(spark, sf_dir):
    labels = spark.sql("SELECT explode(array('Strong', 'Adequate', 'Weak', 'Misleading', 'Unable', 'Unverifiable')) AS label")
    return V.label_counts(_checks(spark, sf_dir), labels)


@query("triage", f"SELECT doc_id, citation, doc_index, row_number() OVER (PARTITION BY doc_id ORDER BY p, doc_index) AS place FROM (SELECT *, CASE WHEN label = 'Misleading' THEN 1 WHEN label = 'Weak' THEN 2 WHEN NOT found THEN 3 END AS p FROM ({CHECKS})) WHERE p IS NOT NULL")
def triage(spark, sf_dir):
    t = V.triage(_checks(spark, sf_dir))
    return t.select("doc_id", "citation", F.col("doc_index").cast("long").alias("doc_index"), F.col("place").cast("long").alias("place"))


COUNTED = "concat('## Summary', chr(10), '- Strong: ', count(*) FILTER (WHERE label = 'Strong'), chr(10), '- Adequate: ', count(*) FILTER (WHERE label = 'Adequate'), chr(10), '- Weak: ', count(*) FILTER (WHERE label = 'Weak'), chr(10), '- Misleading: ', count(*) FILTER (WHERE label = 'Misleading'), chr(10), '- Unable: ', count(*) FILTER (WHERE label = 'Unable'), chr(10), '- Unverifiable: ', count(*) FILTER (WHERE NOT found))"
URGENT = "concat('## Triage', chr(10), coalesce(string_agg(concat('- ', citation), chr(10) ORDER BY CASE WHEN label = 'Misleading' THEN 1 WHEN label = 'Weak' THEN 2 ELSE 3 END, doc_index) FILTER (WHERE label IN ('Misleading', 'Weak') OR NOT found), ''))"
BLOCKS = "string_agg(concat('### ', doc_index, '. ', citation, chr(10), CASE WHEN found THEN concat('Support: ', label) ELSE 'Unverifiable' END), concat(chr(10), chr(10)) ORDER BY doc_index)"
MISSING = "CASE WHEN bool_or(NOT found) THEN concat('## Unverifiable', chr(10), string_agg(concat('- ', citation), chr(10) ORDER BY doc_index) FILTER (WHERE NOT found)) END"


@query("report_markdown", f"SELECT doc_id, concat_ws(concat(chr(10), chr(10)), {COUNTED}, {URGENT}, {BLOCKS}, {MISSING}) AS text FROM ({CHECKS}) GROUP BY 1")
def report_markdown(spark, sf_dir):
    return K.check_markdown(_checks(spark, sf_dir)).select("doc_id", "text")


#: What a report says that was changed by hand: labels of some citations, and some left out.
TOLD = f"SELECT doc_id, CAST(doc_index AS INT) AS doc_index, citation, CASE WHEN length(citation) % 3 = 0 THEN 'Strong' ELSE label END AS label FROM ({CHECKS}) WHERE doc_index <> 5"
OWN = f"SELECT doc_id, CAST(doc_index AS INT) AS doc_index, citation, label FROM ({CHECKS})"


@query("report_consistency", f"SELECT *, 'table' AS side FROM ({OWN} EXCEPT ALL {TOLD}) UNION ALL SELECT *, 'report' FROM ({TOLD} EXCEPT ALL {OWN})")
def report_consistency(spark, sf_dir):
    c = _checks(spark, sf_dir)
    changed = c.filter("doc_index <> 5").withColumn("label", F.when(F.length("citation") % 3 == 0, "Strong").otherwise(F.col("label")))
    return K.differences(c, K.check_json(changed, "2026-01-01T00:00:00Z"))


@query("report_determinism", f"SELECT doc_id, count(*) AS n, false AS differs FROM ({CHECKS}) GROUP BY 1")
def report_determinism(spark, sf_dir):
    """Reports of the same checks in another order of rows say the same."""
    c = _checks(spark, sf_dir)
    one = K.check_json(c, "2026-01-01T00:00:00Z").select("doc_id", F.col("json").alias("a"))
    two = K.check_json(c.repartition(7, "citation"), "2026-01-01T00:00:00Z").select("doc_id", F.col("json").alias("b"))
    return one.join(two, "doc_id").select("doc_id", F.json_array_length(F.get_json_object("a", "$.citations")).cast("long").alias("n"), (F.col("a") != F.col("b")).alias("differs"))


@query("tier_confidence", "SELECT p_partkey AS doc_id, CASE p_partkey % 5 WHEN 1 THEN 'full' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' WHEN 4 THEN 'low' END AS confidence, CASE WHEN p_partkey % 5 = 4 THEN 'Adequate' ELSE 'Strong' END AS label FROM part")
def tier_confidence(spark, sf_dir):
    t = C.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.nullif(F.col("p_partkey") % 5, F.lit(0)).cast("int").alias("tier"))
    return t.select("doc_id", V.tier_confidence(F.col("tier")).alias("confidence"), F.coalesce(V.confident_label(F.lit("Strong"), F.col("tier"), True), F.lit("Strong")).alias("label"))


@query("critic_flags", "SELECT concat('c', p_partkey) AS cite_id, CASE WHEN p_partkey % 7 = 0 THEN 'not-dispatched' WHEN p_partkey % 4 = 0 THEN 'agrees' WHEN p_partkey % 4 = 1 THEN 'partial' WHEN p_partkey % 4 = 2 THEN 'disagrees' ELSE 'unavailable' END AS critic_status, CASE WHEN p_partkey % 7 = 0 OR p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 IN (1, 2) THEN 'CRITIC DISAGREES' ELSE 'CRITIC UNAVAILABLE' END AS marker FROM part")
def critic_flags(spark, sf_dir):
    p = C.table(spark, sf_dir, "part")
    cites = p.select(F.expr("concat('c', p_partkey)").alias("cite_id"), F.expr("p_partkey % 7 <> 0").alias("has_pincite"))
    critic = p.filter("p_partkey % 4 <> 3 OR p_partkey % 8 = 3").select(F.expr("concat('c', p_partkey)").alias("cite_id"), F.expr("CASE p_partkey % 4 WHEN 0 THEN 'agrees' WHEN 1 THEN 'partial' WHEN 2 THEN 'disagrees' ELSE 'error' END").alias("status"))
    return V.with_critic(cites, critic).select("cite_id", "critic_status", "marker")


@query("negative_history", "SELECT p_partkey AS s, CASE WHEN p_partkey % 6 = 0 THEN 'overruled, limited' WHEN p_partkey % 6 = 2 THEN 'abrogated' END AS negative_history FROM part")
def negative_history(spark, sf_dir):
    p = C.table(spark, sf_dir, "part")
    cases = p.select("p_partkey", F.col("p_partkey").cast("string").alias("case_key"))
    t = p.select(F.col("p_partkey").cast("string").alias("case_key"), F.explode(F.expr("CASE p_partkey % 6 WHEN 0 THEN array('limited', 'overruled', 'distinguished') WHEN 1 THEN array('criticized') WHEN 2 THEN array('abrogated') ELSE array('distinguished') END")).alias("treatment"), F.lit(True).alias("affects"))
    return V.with_negative_history(cases, t).select(F.col("p_partkey").alias("s"), "negative_history")


@query("signal_bars", "SELECT p_partkey AS doc_id, CASE p_partkey % 6 WHEN 0 THEN 'direct' WHEN 1 THEN 'clear' WHEN 2 THEN 'background' WHEN 3 THEN 'analogous' WHEN 4 THEN 'contrary' END AS bar FROM part")
def signal_bars(spark, sf_dir):
    s = F.expr("CASE p_partkey % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'see' WHEN 2 THEN 'see-generally' WHEN 3 THEN 'cf' WHEN 4 THEN 'but-see' ELSE 'no such signal' END")
    return C.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), V.signal_bar(s).alias("bar"))


LADDER = "CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 4 END WHEN 3 THEN 4 END"


@query(
    "match_ladder",
    f"SELECT p_partkey AS cite_id, {LADDER} AS tier, CAST(CASE p_partkey % 5 WHEN 0 THEN p_partkey % 9 WHEN 2 THEN p_partkey % 9 WHEN 3 THEN p_partkey % 9 + 5 END AS INT) AS page, CASE WHEN p_partkey % 5 = 4 THEN 'pincite_page_unresolvable' ELSE '' END AS flags FROM part",
)
def match_ladder(spark, sf_dir):
    p = C.table(spark, sf_dir, "part")
    cites = p.select(
        F.col("p_partkey").alias("cite_id"), F.col("p_partkey").alias("opinion_id"), F.expr("CAST(p_partkey % 9 + p_partkey % 2 AS INT)").alias("page"), F.expr("CASE p_partkey % 5 WHEN 0 THEN 'the rule holds' ELSE 'another thing' END").alias("quote"),
        F.expr("CASE p_partkey % 5 WHEN 1 THEN 'notice was due' WHEN 2 THEN 'rule holds here' WHEN 3 THEN 'Court takes record' ELSE 'none of this' END").alias("proposition"),
    )
    kinds = "array(named_struct('page', CAST(p_partkey % 9 AS INT), 'kind', 'page', 'text', 'We say that The Rule  holds here.'), named_struct('page', CAST(p_partkey % 9 + 5 AS INT), 'kind', 'page', 'text', 'Elsewhere, a court takes note for the record.'), named_struct('page', CAST(NULL AS INT), 'kind', 'parenthetical', 'text', concat('holding that notice number ', p_partkey, ' was due')))"
    passages = p.select(F.col("p_partkey").alias("opinion_id"), F.inline(F.expr(kinds)))
    return V.unlocated(cites, V.match_ladder(cites, passages, V.scorer("overlap"))).select("cite_id", "tier", "page", F.array_join("flags", ",").alias("flags"))


@query("catalog_search", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey LIMIT 20 OFFSET 20")
def catalog_search(spark, sf_dir):
    return readers.search(C.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), {"c_nationkey": 3}, ["c_custkey"], page=2, size=20)


@query("catalog_choices", "SELECT DISTINCT c_mktsegment FROM customer")
def catalog_choices(spark, sf_dir):
    return readers.choices(C.table(spark, sf_dir, "customer"), "c_mktsegment")


WIDE = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@query("semantic_scorer_topk", f"SELECT vec_id, best, r FROM (SELECT a.vec_id, b.vec_id AS best, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.vec_id) AS r FROM (SELECT vec_id, {WIDE} AS v FROM embeddings WHERE vec_id % 100 = 0) a JOIN (SELECT vec_id, {WIDE} AS v FROM embeddings) b ON a.vec_id <> b.vec_id) WHERE r <= 3")
def semantic_scorer_topk(spark, sf_dir):
    e = C.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return V.nearest(e.filter("vec_id % 100 = 0"), e, 3)
