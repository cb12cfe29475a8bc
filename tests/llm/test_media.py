import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citeloom.llm import matroska as M
from tests.llm.conftest import frame


@given(st.integers(0, 2**40))
def test_vint_round_trip(n):
    assert M.vint(M.put_vint(n), 0) == (n, len(M.put_vint(n)))


@pytest.mark.parametrize("kind", ["xiph", "ebml"])
@settings(max_examples=50)
@given(sizes=st.lists(st.integers(0, 70_000), min_size=2, max_size=9))
def test_lacing_round_trip(kind, sizes):
    data = M.lace([bytes(n) for n in sizes], kind)
    assert [e - s for s, e in M.unlace(data, 0, len(data), kind)] == sizes


@pytest.mark.parametrize("kind", M.LACINGS)
@pytest.mark.parametrize("frames", [1, 7, 8, 9, 64, 65, 200])
def test_files_round_trip(kind, frames):
    payload = random.Random(frames).randbytes(frames * M.FRAME)
    media = M.mux(payload, kind)
    got = M.parse(media)
    assert got["error"] is None and got["tracks"] == {1: "A_PCM/INT/LIT"}
    assert b"".join(media[p[2] : p[3]] for p in got["packets"]) == payload
    assert [p[1] for p in got["packets"]] == [i * M.FRAME_MS for i in range(frames)]
    for ms, track, at in got["cues"]:
        assert M.vint(media, at, keep_marker=True)[0] == M.CLUSTER and track == 1
        assert ms in [p[1] for p in got["packets"]]


def test_block_groups_and_unknown_sizes():
    block = b"\x81\x00\x05\x00" + b"abc"
    cluster = M.number(M.TIMESTAMP, 100) + M.element(M.BLOCK_GROUP, M.element(M.BLOCK, block) + M.number(0x9B, 7))
    data = M._HEAD + M.SEGMENT.to_bytes(4, "big") + b"\xff" + M._INFO + M._TRACKS + M.element(M.CLUSTER, cluster)
    got = M.parse(data)
    assert got["error"] is None
    ((track, ms, s, e, *_),) = got["packets"]
    assert (track, ms, data[s:e]) == (1, 105, b"abc")


def blocks(*payloads, key=0x80):
    return b"".join(M.element(M.SIMPLE_BLOCK, b"\x81\x00\x00" + bytes([key]) + p) for p in payloads)


def test_clusters_of_unknown_size_end_where_the_next_begins():
    opened = M.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7
    clusters = b"".join(opened + M.number(M.TIMESTAMP, 100 * i) + blocks(b"p%d" % i) for i in range(3))
    data = M._HEAD + M.SEGMENT.to_bytes(4, "big") + b"\xff" + M._INFO + M._TRACKS + clusters + M.element(M.CUES, b"")
    got = M.parse(data)
    assert got["error"] is None and len(got["clusters"]) == 3
    assert [(p[1], data[p[2] : p[3]], p[6]) for p in got["packets"]] == [(0, b"p0", 0), (100, b"p1", 1), (200, b"p2", 2)]


@pytest.mark.parametrize("kind", M.LACINGS)
def test_a_file_cut_off_keeps_its_whole_packets(kind):
    payload = random.Random(3).randbytes(20 * M.FRAME)
    media = M.mux(payload, kind)
    whole = [(p[2], p[3]) for p in M.parse(media)["packets"]]
    for end in (*range(60, len(media), 997), len(media) - 1, whole[0][1] - 100, whole[9][1] - 1, whole[9][1]):
        got = M.parse(media[:end])
        assert got["error"] is not None
        found = [(p[2], p[3]) for p in got["packets"]]
        assert found == whole[: len(found)] and all(e <= end and e - s == M.FRAME for s, e in found)


def test_keyframes_of_block_groups():
    block = M.element(M.BLOCK, b"\x81\x00\x00\x00abc")
    groups = M.element(M.BLOCK_GROUP, block) + M.element(M.BLOCK_GROUP, block + M.number(M.REFERENCE_BLOCK, 1))
    data = M._HEAD + M.element(M.SEGMENT, M._TRACKS + M.element(M.CLUSTER, M.number(M.TIMESTAMP, 0) + groups + blocks(b"x", key=0)))
    assert [p[4] for p in M.parse(data)["packets"]] == [True, False, False]


def test_tracks_have_a_uid():
    assert M.number(M.TRACK_UID, 1) in M._TRACKS


def test_odd_rows(spark):
    long = "é" * 400_000
    rows = [(1, long, "en"), (1, long, "en"), (None, None, None), (2, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = M.query(df).orderBy("n_bytes").collect()
    assert [r.n_bytes for r in got] == [0, 0, 800_000, 800_000] and got[2][1:] == got[3][1:]
    assert got[3].payload_bytes == -(-800_000 // 576) * 576 and got[3].payload_sha256 == hashlib.sha256(M.padded(long.encode())).hexdigest()


def test_query(spark, docs, empty):
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in M.query(docs).collect():
        raw = (rows[r.doc_id] or "").encode()
        pad = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:]))
        assert r.media_sha256 == hashlib.sha256(M.mux(pad)).hexdigest() and r.media_bytes == len(M.mux(pad))
    assert M.query(empty).count() == 0


def test_packet_table(spark, docs):
    media = M.stored(docs.filter("doc_id < 20"))
    table = M.packets(media)
    assert table.filter("error IS NOT NULL").count() == 0
    total = table.selectExpr("sum(byte_end - byte_start) AS n").collect()[0].n
    assert total == M.query(docs.filter("doc_id < 20")).selectExpr("sum(payload_bytes) AS n").collect()[0].n
    bad = spark.createDataFrame([(1, b"not media"), (2, None), (3, M.mux(bytes(576))[:-600])], "id int, media binary")
    assert M.packets(bad).filter("error IS NOT NULL").count() == 3
    with pytest.raises(ValueError):
        M.packets(bad.withColumnRenamed("id", "track"))
