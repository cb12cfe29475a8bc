import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from citeloom.llm import packing as P
from tests.llm.conftest import frame


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 50), max_size=20))
def test_plan_places_every_piece_once(histogram):
    plan = P.shortest_pack_first(histogram, 64)
    filled = defaultdict(set)
    for length, count in histogram.items():
        starts = plan.rank.get(length, []) + [count]
        assert not count or starts[0] == 0
        for (seq, offset, repeats), a, b in zip(plan.place.get(length, []), starts, starts[1:]):
            for r in range(a, b):
                s, o = seq + (r - a) // repeats, offset + (r - a) % repeats * length
                new = set(range(o, o + length))
                assert not filled[s] & new
                filled[s] |= new
    assert set(filled) == set(range(plan.sequences))
    assert all(x == set(range(len(x))) and len(x) <= 64 for x in filled.values())
    # a new pack is opened only where none has room, so two packs never hold less than one
    sizes = sorted(len(x) for x in filled.values())
    assert len(sizes) < 2 or sizes[0] + sizes[1] > 64


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_ids_of_words_are_ids_of_the_text(text):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    known = P._words(P.default_tokenizer())
    w = text.encode().split()
    known.learn({x.lower() for x in w})
    assert b"".join(known[x.lower()] for x in w) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("size", [4096, 64])
def test_pieces_and_sequences(docs, size):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = P.pack(docs, size=size).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(rows)
    for i, text in rows.items():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for x in by_seq.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= size
    waste = 1 - sum(r.length for r in got) / (size * len(by_seq))
    assert waste < 0.1


def test_a_small_memory_of_words_gives_the_same_ids():
    small, large = P.WordIds(P.default_tokenizer(), 40), P._words(P.default_tokenizer())
    for k in range(30):
        texts = [f"w{chr(97 + (k * i) % 26) * 3}x, %%% !! Word{chr(97 + i % 26)}. a b'c {k} Größe?".encode() for i in range(25)]
        assert (small.ids(texts, 2)[0] == large.ids(texts, 2)[0]).all()


@pytest.mark.parametrize("word", ["İstanbul", "İ", "İ,", "DİYARBAKIR.", "\u0958a", "\ufb1d"])
def test_letters_that_the_tokenizer_takes_apart(word):
    known = P.WordIds(P.default_tokenizer())
    text = f"first {word} and {word} last"
    want = known.tokenizer.encode(text, add_special_tokens=False).ids + [2]
    assert known.ids([text.encode(), b"other words"], 2)[0].tolist()[: len(want)] == want


def test_every_letter_and_special_strings():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    known = P.WordIds(P.default_tokenizer())
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha() and c < 0x3400 or c in (0x4E00, 0xAC00, 0xFB1D, 0x1D400)]
    texts = [f"{c} a{c} {c}b, {c}." for c in letters]
    texts += ["<|endoftext|> hi", "so <|EndOfText|>.", "x<|startoftext|>y <|endoftext|><|endoftext|>", "<|endoftext| > no", "\t<|endoftext|>\n Größe"]
    want = [e.ids + [2] for e in t.encode_batch(texts, add_special_tokens=False)]
    flat, first = known.ids([x.encode() for x in texts], 2)
    got = [flat[a:b].tolist() for a, b in zip(first, first[1:])]
    assert [x for x, a, b in zip(texts, got, want) if a != b] == []


def test_copies_are_told_apart(spark):
    rows = [(1, "a b c", "", "", 0)] * 3 + [(2, "word " * 300, "", "", 0)] * 2 + [(3, "a b c", "", "", 0)]
    got = P.sequences(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.copy, r.start) for r in got) == [(1, 0, 0), (1, 1, 0), (1, 2, 0), (2, 0, 0), (2, 1, 0), (3, 0, 0)]
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)


def test_very_long_text_and_clashing_columns(spark):
    rows = [(1, "ab " * 10_000, 7, 8, "x")]
    got = P.query(spark.createDataFrame(rows, "doc_id long, text string, length int, offset int, copy string")).orderBy("start").collect()
    assert [r.length for r in got] == [4096, 4096, got[0].doc_tokens - 8192] and got[0].doc_tokens == 10_001


def test_pack_text_with_dotted_capital_i(spark):
    rows = [(1, "Old İstanbul, İzmir and plain words", "tr", "", 0), (2, "plain words", "en", "", 0)]
    assert {r.doc_id for r in P.query(frame(spark, rows)).collect()} == {1, 2}


def test_edges(spark, empty):
    assert P.query(empty).count() == 0
    rows = [(1, "a b", "", "", 0), (1, "a b", "", "", 0), (None, None, None, None, None)]
    got = P.query(frame(spark, rows)).collect()
    assert len(got) == 3 and sorted(r.doc_tokens for r in got) == [1, 3, 3]
    assert sorted(r.offset for r in got)[0] == 0
