import re
from collections import Counter

from citeloom.llm import quality as Q
from tests.llm.conftest import frame

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = W.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = {g for g, c in Counter(grams).items() if c > 1}
    covered = {j for i, g in enumerate(grams) if g in often for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if W.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(docs):
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in Q.query(docs).collect():
        want = brute(rows[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_lines_fall_by_rule_and_documents_by_loss(spark):
    good = "This is a fine sentence with plenty of plain words in it."
    rows = [
        (1, f"{good}\nHome | About | Contact | Help", None, None, 0),
        (2, f"{good}\n*** ### $$$ %%% &&&\nAll rights reserved.", None, None, 0),
        (3, "WORDS!! IN!! CAPITALS!! ALL!! OVER!! THE!! WHOLE!! LINE!! AND!! MORE!!\nshort good line here", None, None, 0),
        (4, f"{good}\n\n{good}\nAnother line that is perfectly good prose too.", None, None, 0),
        (5, "the the the the the is is is is is of of of of of", None, None, 0),
    ]
    got = {r.doc_id: r for r in Q.clean(frame(spark, rows)).collect()}
    assert got[1].kept and got[1].clean_text == good and got[1].lines_removed == 1
    assert got[2].kept and got[2].clean_text == good and got[2].lines_removed == 2
    assert not got[3].kept and not got[5].kept
    assert got[4].lines_removed == 1 and got[4].n_dup_lines == 1 and "Another" in got[4].clean_text


def test_stage_keeps_columns_and_clean_texts(spark, docs):
    out = Q.kept_documents(docs)
    assert out.columns == docs.columns
    verdict = {r.doc_id: r.kept for r in Q.query(docs).collect()}
    assert {r.doc_id for r in out.collect()} == {i for i, k in verdict.items() if k}


def test_edges(spark, empty):
    assert Q.query(empty).count() == 0
    rows = [(1, None, "a", "b", 0), (1, None, "a", "b", 0), (2, "", "a", "b", 0), (None, "x " * 60_000, None, None, None)]
    got = Q.query(frame(spark, rows)).collect()
    assert len(got) == 4 and not any(r.kept for r in got)
    clash = frame(spark, rows).withColumnsRenamed({"source": "kept", "lang": "n_words"})
    assert Q.clean(clash).filter("kept").count() == 0
