"""Hand-written cases with literal expectations."""

import io
import json
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom import registry
from citeloom.functions import text as X
from citeloom.operators import extract as E
from citeloom.operators import graph as H
from citeloom.operators import resolve as R
from citeloom.operators import sections as L
from citeloom.operators import structure as S
from citeloom.operators import toa as T
from citeloom.operators import verify as V
from citeloom.plans import corpus as C
from citeloom.sources import readers, sinks


def value(spark, column, **row):
    """A column expression over one row of strings."""
    names = list(row) or ["x"]
    df = spark.createDataFrame([tuple(row[n] for n in names) if row else (None,)], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("v")).collect()[0].v


@pytest.mark.parametrize("pin,pages", [("163, 170", [163, 170]), ("163–65", [163]), ("at 163", [163]), ("163 n.4", []), (None, []), ("", [])])
def test_pincites(spark, pin, pages):
    assert value(spark, X.pincites(F.col("c")), c=pin) == pages


@pytest.mark.parametrize("raw,n", [(" 12 ", 12), ("+5", 5), ("12.5", None), ("1_000", None), ("", None), (None, None)])
def test_lossy_int(spark, raw, n):
    assert value(spark, X.to_int(F.col("c")), c=raw) == n


def test_title_zero_falls_through(spark):
    assert value(spark, E.title_or_chapter(F.lit(0), F.lit(5))) == 5


@pytest.mark.parametrize("a,b,name", [("A", "B", "A v. B"), ("A", None, "A"), (None, "B", "B"), (None, None, None)])
def test_source_name(spark, a, b, name):
    assert value(spark, E.compose_source_name(F.col("a"), F.col("b")), a=a, b=b) == name


@pytest.mark.parametrize("sub,anchor", [("(c)(2)", "c_2"), ("(b)(2)(C)(i)", "b_2_C_i"), ("c_2", "c_2"), ("", None), ("(", None), ("(c)(2)-(4)", "c_2_4")])
def test_anchor(spark, sub, anchor):
    assert value(spark, L.anchor(F.col("c")), c=sub) == anchor


@pytest.mark.parametrize("kind,title,section,tail", [("statute", "17", "512", "uscode/text/17/512"), ("regulation", "37", "201.5", "cfr/text/37/201.5"), ("rule", "1", "2", None), ("statute", "17", " ", None)])
def test_urls(spark, kind, title, section, tail):
    got = value(spark, L.resolve_url(F.col("a"), F.col("b"), F.col("c")), a=kind, b=title, c=section)
    assert got is None if tail is None else got.endswith(tail)


LONG = "x" * 80


def test_request_states(spark):
    page = f'<div class="section"><p>{LONG}</p></div>'
    requests = spark.createDataFrame([("a", "statute", "1", "1", None), ("b", "statute", "1", "2", None), ("c", "statute", "1", "3", None), ("d", "statute", "1", "4", "(z)"), ("e", "statute", "1", "5", None), ("f", "statute", None, "5", None), ("g", "statute", "1", "9", None)], "id string, type string, title string, section string, subsection string")
    url = f"{L.BASE}/uscode/text/1/"
    pages = spark.createDataFrame([(url + "1", 404, ""), (url + "2", 500, ""), (url + "3", 200, f'<div class="section">{LONG[:79]}</div>'), (url + "4", 200, page), (url + "5", 200, page)], "url string, http_status int, html string")
    got = {r.id: r for r in L.fetch(requests, pages).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "not_found", "b": "network_error", "c": "not_found", "d": "anchor_not_found", "e": "ok", "f": "network_error", "g": "network_error"}
    assert got["a"].flags == ["source_not_found"] and got["c"].error == "empty_section_body" and got["d"].flags == ["anchor_not_found"]
    assert got["d"].section_text == LONG and got["d"].subsection_text is None
    assert not got["e"].anchor_matched and got["e"].subsection_text is None and got["f"].error == "unsupported_or_incomplete_entry"


def test_section_layouts():
    inside = '<div class="section"><p>Start</p><div class="subsection"><a name="c_2"></a>Part <b>c</b>&amp;</div><p>Rest</p></div><p>Out</p>'
    assert L.extract_section(inside, "c_2") == ("StartPart c&Rest", "Part c&", True)
    before = '<div class="section"><p>Start</p><a name="c_2"></a><div class="subsection">Own</div><p>Rest</p></div>'
    assert L.extract_section(before, "c_2")[1] == "OwnRest"
    regulation = '<div class="section"><p class="psection-1"><span class="enumxml" id="a">(a)</span> first</p><p class="psection-1"><span class="enumxml" id="b">(b)</span> second</p>tail</div>'
    assert L.extract_section(regulation, "a")[1] == "(a) first" and L.extract_section(regulation, "b")[1] == "(b) second"
    nested = '<div class="section"><div class="subsection"><a name="c"></a><div class="paragraph"><a name="c_1"></a>one</div><div class="paragraph indent2"><a name="c_2"></a>two</div></div></div>'
    assert L.extract_section(nested, "c_1")[1] == "one" and L.extract_section(nested, "c")[1] == "onetwo"
    assert L.extract_section('<div class="section"><p id="x">no anchor</p><a id="x">nor this</a></div>', "x")[1:] == (None, False)
    assert L.extract_section('<div class="subsection">x</div>', None) == ("", None, False)
    assert L.extract_section("a</p><p>b", None)[0] == ""


def test_tags_against_section_text(spark):
    assert value(spark, X.strip_tags(F.col("c")), c="a</p><p>b") == "a b"


def test_text_preference(spark):
    got = value(spark, H.pick_text(F.col("a"), F.col("b"), F.col("c")), a=" ", b="plain", c="html")
    assert (got.field, got.text) == ("plain_text", "plain")


@pytest.mark.parametrize("text,page,plain", [("*4 four *5 five is here *6 six", 5, "*5 five is here"), ("*50 only", 5, None), ("*5 a *6 b is long", 5, "*5 a *6 b is long"), ('<p>x <span page-label="7">7</span> seven <span page-label="8">8</span>', 7, "7 seven")])
def test_page_span(spark, text, page, plain):
    got = value(spark, X.page_or_whole(F.col("c"), F.lit(page)), c=text)
    assert got.plain == plain if plain else not got.found


@pytest.mark.parametrize(
    "text,sentences",
    [
        ("See id. The Court held that the rule applies.", ["See id. The Court held that the rule applies."]),
        ("A sentence that is long enough. Yes.", ["A sentence that is long enough. Yes."]),
        ("Yes. No.", ["Yes. No."]),
        ("One sentence of a fair length. And another one of a fair length.", ["One sentence of a fair length.", "And another one of a fair length."]),
        ("", []),
    ],
)
def test_sentences(spark, text, sentences):
    assert value(spark, X.sentences(F.col("c")), c=text) == sentences


@pytest.mark.parametrize("text,kind", [("17 U.S.C. 5 and Restatement", "cites_statute"), ("Restatement", "cites_restatement"), ("U.S. Const. art. I", "cites_constitution"), ("12 F.3d 34", None)])
def test_non_case(spark, text, kind):
    assert value(spark, H.classify_non_case(F.col("c")), c=text) == kind


def hop(spark, anchors, visited):
    kind = "array<struct<dst:bigint,text:string,no_link:boolean>>"
    df = spark.createDataFrame([(anchors, visited)], f"a {kind}, v array<bigint>")
    return df.select(H.next_hop(F.col("a"), F.col("v")).alias("r")).collect()[0].r


def test_next_hop(spark):
    got = hop(spark, [(3, "Op", False), (None, "1 U.S.C. 5", True), (9, "Op", False), (4, "Op", False)], [9])
    assert (got.next, got.siblings, got.terminal) == (3, [4], None)
    assert hop(spark, [(None, "12 F.3d 34", True)], [1]).terminal == "no_outbound_for_proposition"
    got = hop(spark, [(9, "Op", False)], [9])
    assert (got.terminal, got.target) == ("cycle_detected", 9)
    assert hop(spark, [(None, "Restatement § 1", True), (9, "Op", False)], [9]).terminal == "cites_restatement"


def extracted(spark, text):
    return E.components(E.mentions(spark.createDataFrame([(1, text)], "doc_id long, text string")))


def test_reporters_nest(spark):
    (r,) = extracted(spark, "See Roe v. Doe, 165 F. Supp. 2d 465, 470 (S.D.N.Y. 2001).").collect()
    assert (r.source_name, r.volume, r.reporter, r.start_page, r.pincite, r.court, r.year) == ("Roe v. Doe", 165, "F. Supp. 2d", 465, [470], "S.D.N.Y.", 2001)


def test_every_family(spark):
    text = (
        "Acme Corp. v. Doe, 1 U.S. 2 (1999). 2019 WL 12345. IPR2015-00123. ECLI:EU:C:2014:317. App. no. 5/07. U.S. Const. amend. XIV, § 1. The First Amendment. Cal. Const. art. I, § 7. 17 U.S.C. § 512(c)(2). 47 U.S.C. §§ 315(a), (d), and (e). "
        "Cal. Civ. Code § 1942. Lanham Act. Fed. R. Civ. P. 12(b)(6). Rules 413–415. 37 C.F.R. § 201.5. 80 Fed. Reg. 1234. 120 Cong. Rec. S123 (1974). H.R. Rep. No. 94-1476 (1976). Hearing before the Committee on Rules, 94th Cong. (1976). "
        "Jane Roe, Some Long Title, 90 Harv. L. Rev. 365 (1977). 3 Nimmer, Copyright Law § 13 (4th ed. 2010). Restatement (Second) of Torts § 402A (1965). https://example.org/a. Id. at 4. Doe, 1 U.S. at 5. 1 U.S. at 6. Doe, supra, at 7. the Paxton court. Under § 230, R. at 45."
    )
    got = [r.family for r in extracted(spark, text).orderBy("idx").collect()]
    want = "P01 P02 P03 P04 P05 P06 P07 P08 P09 P28 P10 P11 P12 P13 P14 P15 P16 P17 P18 P19 P20 P21 P22 P23 P24 P25 P26 P27 P29 P30".split()
    assert got == want


def test_spans_are_the_text(spark):
    text = "Emoji 😀 then Roe v. Doe, 1 U.S. 2 (1999); and 17 U.S.C. § 5."
    for r in extracted(spark, text).collect():
        assert text[r.span_start : r.span_end].replace(" ", " ") == r.full_citation


def resolved(spark, text):
    return R.resolve(extracted(spark, text)).orderBy("idx").collect()


def test_repeated_full_citation_points_to_the_first(spark):
    a, b = resolved(spark, "Roe v. Doe, 1 U.S. 2 (1999). Roe v. Doe, 1 U.S. 2, 5 (1999).")
    assert a.resolved_index is None and b.resolved_index == 0 and b.flags == []


def test_lone_id_is_flagged(spark):
    (r,) = resolved(spark, "Id. at 5 says so.")
    assert r.flags == ["unresolved_short_form"]


def test_id_after_a_record_cite_has_no_authority(spark):
    rows = resolved(spark, "Roe v. Doe, 1 U.S. 2 (1999). R. at 45. Id.")
    assert rows[2].authority_key is None and rows[2].flags == ["unresolved_short_form"]


def test_same_party_is_told_apart_by_volume(spark):
    rows = resolved(spark, "Roe v. Doe, 1 U.S. 2 (1999). Roe v. Poe, 3 F.3d 4 (2000). Roe, 1 U.S. at 5. Poe, supra, at 6. Id. at 7.")
    assert [r.resolved_index for r in rows] == [None, None, 0, 1, 1]


def test_splits(spark):
    subs = E.split_subsections(extracted(spark, "47 U.S.C. §§ 315(a), (d), and (e)")).orderBy("part").collect()
    assert [(r.section, r.subsection) for r in subs] == [("315", "(a)"), ("315", "(d)"), ("315", "(e)")]
    rules = E.split_rules(extracted(spark, "Rules 413–415").filter("type = 'rule'")).collect()
    assert sorted(r.rule_number for r in rules) == ["413", "414", "415"]


@pytest.mark.parametrize("court,text", [("SCOTUS", "1, 2, 3, 4, 5"), ("9th Circuit", "1, 2, 3, 4, 5"), ("Elsewhere", "1, 2, 3, 4, 5"), ("Other", "passim")])
def test_passim(spark, court, text):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], court)], "pages array<int>, court string")
    assert T.with_court_rule(df).select(T.passim(F.col("pages"), F.col("rule")).alias("v")).collect()[0].v == text


def test_straddling_pages(spark):
    pages = spark.createDataFrame([(1, 1, 0, 100), (1, 2, 100, 200)], "doc_id long, page int, start int, end int")
    m = spark.createDataFrame([(1, 0, 90, 110), (1, 1, 10, 20), (1, 2, 100, 120)], "doc_id long, idx int, span_start int, span_end int")
    assert {r.idx: r.pages for r in S.straddling(m, pages).collect()} == {0: [1, 2], 1: [1], 2: [2]}


@pytest.mark.parametrize("kind,what", [("(quoting X)", "entry"), ("(citing X)", "flag"), ("(holding that)", "attribute")])
def test_parentheticals(spark, kind, what):
    assert value(spark, E.parenthetical_kind(F.col("c")), c=kind) == what


@pytest.mark.parametrize("text,mode", [("*854 x *870 y", "reporter"), ("*1 x *40 y", "slip_only"), ("none", "none")])
def test_pagination_mode(spark, text, mode):
    assert value(spark, X.pagination_mode(F.col("c"), F.lit(860)), c=text) == mode


def test_sub_opinions(spark):
    rows = spark.createDataFrame([(1, 11, "010combined"), (1, 12, "020lead"), (2, 21, "010combined"), (3, 31, "020lead"), (3, 32, "040dissent")], "cluster_id long, opinion_id long, type string")
    assert {r.cluster_id: r.opinion_id for r in V.choose_sub_opinion(rows).collect()} == {1: 12, 2: 21, 3: 31}
    assert {r.opinion_id for r in V.choose_sub_opinion(rows, F.when(F.col("cluster_id") == 3, "040dissent")).collect()} == {12, 21, 32}


SOURCE = "The provider shall not be liable for monetary relief."


@pytest.mark.parametrize("quote,label,issue", [("shall not be liable", "Strong", None), ("[s]hall not be liable", "Strong", None), ("shall not-be liable", "Misleading", "citation-form"), ("shall be liable", "Misleading", "misquote"), (None, None, None)])
def test_statute_rubric(spark, quote, label, issue):
    got = value(spark, V.statute_rubric(F.lit("ok"), F.col("q"), F.col("s")), q=quote, s=SOURCE)
    assert (got.label, got.issue) == (label, issue)


def test_critic(spark):
    cites = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "cite_id string, has_pincite boolean")
    critic = spark.createDataFrame([("a", "partial"), ("b", "error"), ("c", "agrees")], "cite_id string, status string")
    got = {r.cite_id: (r.critic_status, r.marker) for r in V.with_critic(cites, critic).collect()}
    assert got == {"a": ("partial", "CRITIC DISAGREES"), "b": ("unavailable", "CRITIC UNAVAILABLE"), "c": ("not-dispatched", None)}


def docx(path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    body = f'<w:p>{run("Main")}<w:r><w:footnoteReference w:id="2"/></w:r>{run(" text")}</w:p><w:p></w:p><w:p><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:ins>{run("kept")}</w:ins></w:p>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/footnotes.xml", f'<w:footnotes {w}><w:footnote w:id="2"><w:p>{run("A note.")}</w:p></w:footnote></w:footnotes>')
    path.write_bytes(data.getvalue())


def test_docx(spark, tmp_path):
    docx(tmp_path / "a.docx")
    rows = readers.read_docx(spark, str(tmp_path / "a.docx"))
    assert [r.text for r in rows.orderBy("para_no").collect()] == ["Main text", "kept"]
    assert readers.docx_text(rows).collect()[0].text == "Main text[FN2: A note.]\n\nkept"


def test_html_inline():
    page = '<html><script id="d" type="application/json">{}</script></html>'
    assert "<\\/script>" in sinks.inline_html(page, '{"x": "</script>"}')
    with pytest.raises(ValueError):
        sinks.inline_html("<html></html>", "{}")


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "b.md").write_text("## PAGE 3\nthree\n## PAGE 4\nfour§ 5")
    pages = readers.read_markdown_pages(spark, str(tmp_path / "b.md")).orderBy("page").collect()
    assert [(r.page, r.text.strip()) for r in pages] == [(3, "three"), (4, "four§ 5")]
    (tmp_path / "r.json").write_text('[{"id": "a", "type": "statute", "title": 17, "section": "512"}]')
    assert readers.read_requests(spark, str(tmp_path / "r.json")).collect()[0].title == "17"
    (tmp_path / "bad.json").write_text("not json")
    with pytest.raises(Exception):
        readers.read_requests(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "o.json").write_text('{"id": 5, "type": "020lead", "plain_text": "x"}')
    assert readers.read_opinions(spark, str(tmp_path / "o.json"), ["plain_text"]).collect()[0].plain_text == "x"
    df = spark.createDataFrame([(1, 2, "ü"), (1, 1, "a")], "doc_id long, idx int, t string")
    assert sinks.json_arrays(df, "doc_id", "idx").collect()[0].json == '[{"idx":1,"t":"a"},{"idx":2,"t":"ü"}]'
    sinks.write_text(df, "t", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_walks_equal_a_plain_replay(spark):
    rows = [(i, n, (i * 3 + n) % 11, (i + n) % 4 == 3) for i in range(11) for n in range(1, 4)]
    edges = spark.createDataFrame(rows, "src long, ord int, dst long, no_link boolean")
    for most in (None, 0, 3):
        want = {}
        for root in (0, 5, 7):
            path = [root]
            while most is None or len(path) <= most:
                free = [d for s, _, d, law in rows if s == path[-1] and not law and d not in path]
                if not free:
                    break
                path.append(free[0])
            want[root] = path
        seeds = spark.createDataFrame([(0,), (5,), (7,)], "opinion_id long")
        assert {r.root: r.path for r in H.walk(edges, seeds, most).collect()} == want


def test_fan_out_and_intake(spark):
    c = spark.createDataFrame([(1, i, "exact" if i == 3 else "paraphrase") for i in range(4)] + [(2, i, "exact") for i in range(6)], "root long, opinion_id long, match string")
    rows = H.fan_out(c).collect()
    assert {r.status for r in rows if r.root == 2} == {"needs_user_choice"} and [r.opinion_id for r in rows if r.root == 1 and r.rank == 1] == [3]
    seeds = spark.createDataFrame([("id", [1], True), ("statute", [1], True), ("case", [1], False), ("case", [1, 2], True)], "type string, pincite array<int>, us boolean")
    assert [(r.reject_reason, r.needs_choice) for r in H.intake(seeds).collect()] == [("short_form", False), ("not_a_case", False), ("not_us", False), (None, True)]


def test_streaming_stack_equals_the_batch(spark, tmp_path):
    from citeloom.streaming.citation_stack import resolve_stream

    rows = [(1, 1, "a"), (1, 2, None), (2, 1, None), (1, 3, "b"), (1, 4, None)]
    spark.createDataFrame(rows, "brief_id long, ord int, own_key string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("brief_id long, ord int, own_key string").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # batches for timeouts alone never end
    q = resolve_stream(stream).writeStream.format("memory").queryName("stack").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r.brief_id, r.ord, r.key) for r in spark.table("stack").collect()) == [(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "b"), (2, 1, None)]


def test_walk_and_forest_have_no_cap(spark):
    edges = spark.createDataFrame([(i, 1, i + 1, False) for i in range(20)] + [(20, 1, 7, False)], "src long, ord int, dst long, no_link boolean")
    seeds = spark.createDataFrame([(0,), (15,)], "opinion_id long")
    walks = H.walk(edges, seeds)
    assert {r.root: r.path for r in walks.collect()} == {0: list(range(21)), 15: [*range(15, 21), *range(7, 15)]}
    assert {(r.root, r.hops, r["last"], r.terminal_reason, r.cycle_path[-1]) for r in H.terminals(walks, edges).collect()} == {(0, 20, 20, "cycle_detected", 7), (15, 13, 14, "cycle_detected", 15)}
    assert {(r.opinion_id, r.level) for r in H.forest(edges, seeds.filter("opinion_id = 0")).collect()} == {(i, i) for i in range(21)}
    known = spark.createDataFrame([(i,) for i in range(20) if i != 14], "opinion_id long")
    assert {r.root: r.terminal_reason for r in H.terminals(walks, edges, known).collect()} == {0: "courtlistener_missing", 15: "courtlistener_missing"}


def test_every_opinion_is_a_root(spark):
    sf = "/root/testdata/sf0.001"
    nbrs, all_ids = {}, set()
    for e in sorted(C.edges(spark, sf).collect(), key=lambda e: (e.src, e.ord)):
        all_ids.add(e.src)
        if not e.no_link:
            nbrs.setdefault(e.src, []).append(e.dst)
    want = set()
    for root in all_ids:
        path = [root]
        while path:
            want.add((root, len(path) - 1, path[-1]))
            free = [x for x in nbrs.get(path[-1], []) if x not in path]
            if not free:
                break
            path.append(free[0])
    got = [(r.root, r.hop_index, r.opinion_id) for r in registry.queries()["chain_walk"](spark, sf).collect()]
    assert len(all_ids) == C.table(spark, sf, "lineitem").select("l_orderkey").distinct().count() and set(got) == want and len(got) == len(want)
    assert {r.root for r in registry.queries()["chain_forest"](spark, sf).collect()} == all_ids


def test_nearest_of_all_labels(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.vec_id: np.array(r.embedding, float) for r in C.table(spark, sf, "embeddings").collect()}
    unit = {i: v / np.linalg.norm(v) for i, v in rows.items()}
    want = {(q, b, k + 1) for q in rows if q % 100 == 0 for k, b in enumerate(sorted((i for i in rows if i != q), key=lambda i: (-round(float(unit[q] @ unit[i]), 6), i))[:3])}
    assert {tuple(r) for r in registry.queries()["semantic_scorer_topk"](spark, sf).collect()} == want
    e = C.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    assert {tuple(r) for r in V.nearest(e.filter("vec_id % 100 = 0"), e, 3, block=7).collect()} == want


def test_short_benchmark_items_are_found(spark, tmp_path):
    long = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, f"Asked: what  is law? {long}."), (2, "法律は何ですか。"), (3, "nothing"), (4, "WHAT IS LAW? what is law?")]
    items = [(1, "What is law?"), (2, "何ですか"), (3, long), (4, "what is law?"), (5, "absent here"), (6, "one two three four five six seven eight nine")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {tuple(r) for r in registry.queries()["benchmark_quotes"](spark, str(tmp_path)).collect()} == {(1, 4), (2, 1), (4, 2)}


def test_context_of_a_mention(spark):
    text = "First it began. ## PAGE 99999999999 is none.\n## PAGE 7\nAs (quoting Ann v. Bob, 7 U.S. 8 (2001)) said. See Roe v. Doe, 1 U.S. 2 (1999) (holding that (so)). Unclosed (citing Poe v. Zoe, 3 F.3d 4 (2000)."
    rows = E.mentions(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), context=tuple(E.CONTEXT)).orderBy("idx").collect()
    assert [(r.verb, r.follows, r.page) for r in rows] == [("quoting", None, 7), (None, "(holding that (so))", 7), (None, None, 7)]
    assert rows[1].lead.endswith("said. See ") and rows[1].tail.startswith(" (holding") and rows[1].gap == ") said. See "
    assert rows[0].snippet.startswith("First it began.") and "Ann v. Bob, 7 U.S. 8 (2001)" in rows[0].snippet


def test_pages_and_page_numbers(spark):
    df = spark.createDataFrame([(1, "no page"), (2, "x\n## PAGE 2\ntwo\n## PAGE 3\n"), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.page, r.start, r.end, r.text) for r in S.pages(df).orderBy("page").collect()] == [(2, 2, 11, 16, "\ntwo\n"), (2, 3, 25, 26, "\n")]
    assert [r.b for r in df.select(X.page_bounds(F.col("text")).alias("b")).collect()][2] is None


def test_sections_of_pages(spark):
    ranges = spark.createDataFrame([(1, 1, "A", 1, 2), (1, 2, "B", 2, 4), (1, 3, "C", 7, 9)], "doc_id long, section_no long, heading string, page_start int, page_end int")
    m = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 6), (1, 3, 9), (2, 4, 1), (1, 5, None)], "doc_id long, idx int, page int")
    assert {r.idx: r.heading for r in S.section_of(m, ranges).collect()} == {0: "A", 1: "B", 2: None, 3: "C", 4: None, 5: None}


def test_short_forms_take_the_last_case_before(spark):
    rows = resolved(spark, "Roe v. Doe, 1 U.S. 2 (1999). Roe v. Poe, 1 U.S. 40 (1999). Roe, 1 U.S. at 5. Roe, 1 U.S. at 41. Doe, supra, at 6. Roe, supra, at 7. Zoe, supra, at 8. 9 U.S. at 10.")
    assert [r.resolved_index for r in rows] == [None, None, 0, 1, 0, 1, None, None]


def test_rare_items_in_documents(spark):
    docs = spark.createDataFrame([(1, "what is law? it is law"), (2, None), (3, "outlaw? islaw")], "doc_id long, t string")
    items = spark.createDataFrame([("law?",), ("is law",), ("law?",), ("",), ("at is law? i",), ("t is law? it is l",)], "q string")
    assert {tuple(r) for r in V.containing(docs, items).collect()} == {(1, 5), (3, 2)}
    few = V.contained(docs, items, block=2, batch_docs=1).groupBy("doc_id").agg(F.sum("n").alias("n"))
    assert {tuple(r) for r in few.collect()} == {(1, 5), (3, 2)}


def test_report_json_leaves_out_what_is_not_set(spark):
    checks = spark.createDataFrame([(1, 1, "A", "Strong", True, None), (1, 2, "B", None, False, "why")], "doc_id long, doc_index int, citation string, label string, found boolean, note string")
    got = json.loads(sinks.check_json(checks, "t").collect()[0].json)
    assert got["document"] == {"id": 1} and [set(c) for c in got["citations"]] == [{"id", "doc_index", "citation", "source", "support"}] * 2
    assert got["citations"][1]["support"] == {"note": "why"} and got["citations"][0]["citation"] == {"full_text": "A"}


def test_numbers_of_agency_decisions_are_whole(spark, tmp_path):
    spark.range(1).selectExpr("explode(array(0L, 89999L, 90000L, 5000000000L)) AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["cite_agency_foreign"]).fetchall()
    assert sorted(tuple(r) for r in registry.queries()["cite_agency_foreign"](spark, str(tmp_path)).collect()) == sorted(want)
    cut = E.mentions(spark.createDataFrame([(1, "PGR2020-123456 (PTAB 2020). CBM2014-00123.")], "doc_id long, text string"))
    assert [r.full_citation for r in cut.orderBy("idx").collect()] == ["PGR2020-123456", "CBM2014-00123"]


def test_next_hop_reads_long_opinions_to_their_end(spark, tmp_path):
    # the only link of opinion 4 stands last; all lines of the other are links
    lines = [(4, 12 * n + (0 if n == 30 else 9), n, n) for n in range(1, 31)] + [(3000118435, 12 * n, 3000000000 + n, n) for n in range(1, 31)]
    df = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    df.selectExpr("*", "timestamp'2020-01-01' AS l_shipdate", "1.5D AS l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["anchor_next_hop"]).fetchall()
    got = {r.opinion_id: tuple(r) for r in registry.queries()["anchor_next_hop"](spark, str(tmp_path)).collect()}
    assert sorted(got.values()) == sorted(want) and got[4][1:] == (0, 0, None) and got[3000118435][2] == 27
