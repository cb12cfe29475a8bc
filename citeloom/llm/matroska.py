"""Operator 10: media columns in Matroska.

Reading: variable-length EBML elements, clusters, SimpleBlocks and BlockGroups, the three kinds of
lacing and the cues become a packet table with timestamps, tracks and byte ranges. Writing: any bytes
become one 8-bit PCM track, 576 samples a frame and up to eight frames a laced block, so that a
payload can be stored without loss and read back from the packet table.

Defined results: a null text is stored like an empty one; a very long text is one file, parsed packet by
packet, whose packets travel in batches of a few megabytes; equal texts and repeated rows give equal
files; an empty table gives no packets. Bytes that are not Matroska give one row with an `error`. A
segment or cluster of unknown size ends where an element begins that cannot be its child. An element
cut off by the end of the file ends the parse at the last whole packet, with an `error`. Extra columns
repeat beside the packets; names that clash with the packet columns are refused by `packets` and
dropped by `query`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from citeloom.llm.common import tidy, utf8

FRAME = 576
LACED = 8
RATE = 8000
FRAME_MS = FRAME * 1000 // RATE
CLUSTER_BLOCKS = 8
BATCH_BYTES = 4_000_000

# Element ids of EBML and Matroska.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x2AD7B1, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION, MUXING_APP, WRITING_APP = 0x4282, 0x4287, 0x4285, 0x4D80, 0x5741
VOID, CRC_32 = 0xEC, 0xBF
#: What may stand in an element of unknown size: a cluster's children, and for a segment all but what begins a file.
CLUSTER_CHILDREN = {TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, 0xA7, 0xAB, 0x5854, 0xAF, VOID, CRC_32}
LACINGS = ("none", "xiph", "fixed", "ebml")


def vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """A variable-length integer and where it ends; -1 for an unknown size."""
    first = data[at]
    if not first:
        raise ValueError(f"no vint at {at}")
    n = 9 - first.bit_length()
    if at + n > len(data):
        raise ValueError(f"vint cut off at {at}")
    value = int.from_bytes(data[at : at + n], "big")
    if keep_marker:
        return value, at + n
    value &= (1 << 7 * n) - 1
    return (-1 if value == (1 << 7 * n) - 1 else value), at + n


def put_vint(value: int, n: int = 0) -> bytes:
    if not n:
        n = 1
        while value >= (1 << 7 * n) - 1:
            n += 1
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + put_vint(len(body)) + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """(id, head, start, end, whole) of the elements in a range; whole is false where the range ends before the element does."""
    while at < end:
        head = at
        ident, at = vint(data, at, keep_marker=True)
        size, at = vint(data, at)
        stop = _open_end(data, ident, at, end) if size < 0 else at + size
        yield ident, head, at, min(stop, end), stop <= end
        at = stop


def _open_end(data: bytes, ident: int, at: int, end: int) -> int:
    """Where an element of unknown size ends: before the first id that cannot be its child."""
    if ident not in (SEGMENT, CLUSTER):
        raise ValueError(f"element {ident:#x} of unknown size")
    while at < end:
        kind, body = vint(data, at, keep_marker=True)
        if kind in (EBML, SEGMENT) or ident == CLUSTER and kind not in CLUSTER_CHILDREN:
            return at
        size, body = vint(data, body)
        at = _open_end(data, kind, body, end) if size < 0 else body + size
    return max(at, end)


def unlace(data: bytes, at: int, end: int, kind: str) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block, whose header ends at `at`."""
    if kind == "none":
        return [(at, end)]
    frames = data[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == "fixed":
        if (end - at) % frames:
            raise ValueError("fixed lacing does not divide the block")
        sizes = [(end - at) // frames] * (frames - 1)
    elif kind == "xiph":
        for _ in range(frames - 1):
            n = 0
            while True:
                byte = data[at]
                at += 1
                n += byte
                if byte != 255:
                    break
            sizes.append(n)
    else:
        for i in range(frames - 1):
            start = at
            value, at = vint(data, at)
            if i == 0:
                sizes.append(value)
            else:  # signed difference to the frame before
                width = at - start
                sizes.append(sizes[-1] + value - ((1 << 7 * width - 1) - 1) if value >= 0 else sizes[-1] + (1 << 7 * width - 1))
    out = []
    for n in sizes:
        if n < 0:
            raise ValueError("a laced frame of negative size")
        out.append((at, at + n))
        at += n
    if at > end:
        raise ValueError("laced frames exceed the block")
    return [*out, (at, end)]


def lace(frames: list[bytes], kind: str) -> bytes:
    """Frames with their lacing header."""
    if kind == "none":
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == "ebml":
        head += put_vint(sizes[0]) if len(sizes) > 1 else b""
        for a, b in zip(sizes, sizes[1:-1]):
            n = 1
            while abs(b - a) >= (1 << 7 * n - 1) - 1:
                n += 1
            head += put_vint(b - a + (1 << 7 * n - 1) - 1, n)
    return head + b"".join(frames)


_HEAD = element(EBML, element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ_VERSION, 2))
_INFO = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"citeloom") + element(WRITING_APP, b"citeloom"))
_TRACKS = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(DEFAULT_DURATION, FRAME_MS * 1_000_000) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))))


def mux(payload: bytes, lacing: str = "ebml") -> bytes:
    """A Matroska file with the payload, a positive multiple of FRAME bytes, as 8-bit samples."""
    flags = LACINGS.index(lacing) << 1 | 0x80
    body, cues = _INFO + _TRACKS, b""
    per_block = FRAME * LACED if lacing != "none" else FRAME
    per_cluster = per_block * CLUSTER_BLOCKS
    parts, size = [body], len(body)
    for c in range(0, len(payload), per_cluster):
        ms = c // FRAME * FRAME_MS
        inner = [number(TIMESTAMP, ms)]
        for b in range(c, min(c + per_cluster, len(payload)), per_block):
            frames = [payload[i : i + FRAME] for i in range(b, min(b + per_block, len(payload)), FRAME)]
            kind, mark = (lacing, flags) if len(frames) > 1 else ("none", 0x80)
            inner.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b // FRAME * FRAME_MS - ms, mark) + lace(frames, kind)))
        cues += element(CUE_POINT, number(CUE_TIME, ms) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, size)))
        part = element(CLUSTER, b"".join(inner))
        parts.append(part)
        size += len(part)
    parts.append(element(CUES, cues))
    return _HEAD + element(SEGMENT, b"".join(parts))


def _number(data: bytes, start: int, end: int) -> int:
    return int.from_bytes(data[start:end], "big")


def _need(whole: bool, what: str) -> None:
    if not whole:
        raise ValueError(f"{what} cut off by the end of the file")


def parse(data: bytes) -> dict:
    """Packets [(track, ms, start, end, keyframe, lacing, cluster)], cues [(ms, track, cluster offset)], tracks {number: codec}, clusters [offset]."""
    out: dict = {"packets": [], "cues": [], "tracks": {}, "durations": {}, "clusters": [], "error": None}
    try:
        ident, _, _, end, whole = next(elements(data, 0, len(data)), (0, 0, 0, 0, True))
        if ident != EBML:
            raise ValueError("no EBML header")
        for ident, _, at, stop, whole in elements(data, end, len(data)):
            if ident == SEGMENT:
                _segment(data, at, stop, out)
            _need(whole, "a top element")
    except (ValueError, IndexError, struct.error) as e:
        out["error"] = str(e)
    return out


def _segment(data: bytes, base: int, end: int, out: dict) -> None:
    scale = 1_000_000
    for kind, head, a, z, whole in elements(data, base, end):
        if kind == INFO:
            for k, _, i, j, ok in elements(data, a, z):
                if k == TIMESTAMP_SCALE and ok:
                    scale = _number(data, i, j)
        elif kind == TRACKS:
            for k, _, i, j, _ in elements(data, a, z):
                if k == TRACK_ENTRY:
                    got = {q: data[x:y] for q, _, x, y, _ in elements(data, i, j)}
                    n = int.from_bytes(got.get(TRACK_NUMBER, b""), "big")
                    out["tracks"][n] = got.get(CODEC_ID, b"").decode("ascii", "replace")
                    out["durations"][n] = int.from_bytes(got.get(DEFAULT_DURATION, b""), "big")
        elif kind == CLUSTER:
            out["clusters"].append(head)
            _cluster(data, a, z, scale, out)
        elif kind == CUES:
            for k, _, i, j, _ in elements(data, a, z):
                if k == CUE_POINT:
                    when, where = 0, []
                    for q, _, x, y, _ in elements(data, i, j):
                        if q == CUE_TIME:
                            when = _number(data, x, y)
                        elif q == CUE_POSITIONS:
                            where.append({r: _number(data, s, t) for r, _, s, t, _ in elements(data, x, y)})
                    out["cues"] += [(when * scale // 1_000_000, w.get(CUE_TRACK, 0), base + w.get(CUE_CLUSTER, 0)) for w in where]
        _need(whole, f"element {kind:#x}")


def _cluster(data: bytes, at: int, end: int, scale: int, out: dict) -> None:
    clock = 0
    for kind, _, a, z, whole in elements(data, at, end):
        if kind == BLOCK_GROUP:
            inner = list(elements(data, a, z))
            key = all(k != REFERENCE_BLOCK for k, *_ in inner)
            for k, _, i, j, ok in inner:
                if k == BLOCK:
                    _need(ok and whole, "a block group")
                    _block(data, i, j, clock, scale, key, out)
        _need(whole, f"element {kind:#x}")
        if kind == TIMESTAMP:
            clock = _number(data, a, z)
        elif kind == SIMPLE_BLOCK:
            _block(data, a, z, clock, scale, bool(data[vint(data, a)[1] + 2] & 0x80), out)


def _block(data: bytes, a: int, z: int, clock: int, scale: int, key: bool, out: dict) -> None:
    track, at = vint(data, a)
    shift, flags = struct.unpack_from(">hB", data, at)
    kind = LACINGS[flags >> 1 & 3]
    each = out["durations"].get(track, 0)
    for i, (s, e) in enumerate(unlace(data, at + 3, z, kind)):
        ms = ((clock + shift) * scale + i * each) // 1_000_000
        out["packets"].append((track, ms, s, e, key, kind, len(out["clusters"]) - 1))


def padded(text: bytes) -> bytes:
    """The payload: text and bytes 255 up to a positive multiple of FRAME."""
    return text + b"\xff" * (max(1, -(-len(text) // FRAME)) * FRAME - len(text))


PACKETS = "packet_no integer, track long, timestamp_ms long, byte_start long, byte_end long, keyframe boolean, lacing string, cluster integer, cue_ms long, error string"


def packets(media: DataFrame, column: str = "media", with_data: bool = False) -> DataFrame:
    """The packet table: a row for each packet of each file, in order, or one row with an error; other columns repeat.

    cue_ms is the time of the cue that points to the packet's cluster. The bytes of a packet come as
    `data` on request.
    """
    kinds = {"integer": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    added = dict(x.split() for x in PACKETS.split(", ")) | ({"data": "binary"} if with_data else {})
    keep = [c for c in media.columns if c != column]
    if clash := set(keep) & set(added):
        raise ValueError(f"columns clash with the packet table: {sorted(clash)}")
    schema = T.StructType([media.schema[c] for c in keep])
    for name, kind in added.items():
        schema = schema.add(name, kind)

    def run(batches):
        for batch in batches:
            rows, origin, size = [], [], 0

            def taken() -> pa.RecordBatch:
                cols = list(zip(*rows)) if rows else [()] * len(added)
                of = pa.array(origin, pa.int64())  # not of the file, which would be copied for each packet
                return pa.RecordBatch.from_arrays([*[batch.column(c).take(of) for c in keep], *[pa.array(c, kinds[k]) for c, k in zip(cols, added.values())]], names=[*keep, *added])

            for i, blob in enumerate(batch.column(column)):
                data = blob.as_py() or b""
                got = parse(data)
                cues = {offset: ms for ms, _, offset in reversed(got["cues"])}
                at = [cues.get(c) for c in got["clusters"]]
                found = got["packets"] or [None]
                for n, p in enumerate(found):
                    error = got["error"] if n == len(found) - 1 else None
                    row = (n, *p, at[p[6]], error) if p else (*(None,) * 9, error)
                    rows.append((*row, data[p[2] : p[3]] if p else None) if with_data else row)
                    origin.append(i)
                    size += p[3] - p[2] if p else 0
                    if size >= BATCH_BYTES:
                        yield taken()
                        rows, origin, size = [], [], 0
            yield taken()

    return media.select(*keep, column).mapInArrow(tidy(run), schema)


STORED = "media binary, n_bytes long, media_bytes long, media_sha256 string"


def stored(docs: DataFrame, lacing: str = "ebml") -> DataFrame:
    """doc_id and the Matroska file of every text, as a binary column `media`, with the file's size and digest."""

    def run(batches):
        for batch in batches:
            texts = [x or b"" for x in utf8(batch.column("text"))]
            files = [mux(padded(x), lacing) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(files, pa.binary()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, files), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in files], pa.string())], names=["doc_id", *[x.split()[0] for x in STORED.split(", ")]])

    schema = T.StructType([docs.schema["doc_id"]])
    for x in STORED.split(", "):
        schema = schema.add(*x.split())
    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


class _Digest:
    """What is known of one file from its packets, taken in order."""

    def __init__(self, own: tuple):
        self.own, self.sha, self.size, self.tail = own, hashlib.sha256(), 0, b""
        self.tracks, self.clusters, self.cued, self.steps = set(), set(), set(), set()
        self.n = self.laced = 0
        self.last: int | None = None

    def add(self, track: int, ms: int, lacing: str, cluster: int, cue: int | None, data: bytes) -> None:
        self.sha.update(data)
        self.size += len(data)
        self.tail = (self.tail + data)[-32:]
        self.tracks.add(track)
        self.clusters.add(cluster)
        if cue is not None:
            self.cued.add(cluster)
        if self.last is not None:
            self.steps.add(ms - self.last)
        self.last = ms
        self.n += 1
        self.laced += lacing != "none"

    def row(self) -> tuple:
        doc_id, n_bytes, media_bytes, media_sha256 = self.own
        feature = f"tracks={len(self.tracks)};clusters={len(self.clusters)};cues={len(self.cued)};packets={self.n};last_ms={self.last};step_ms={'/'.join(map(str, sorted(self.steps))) or 0};laced={self.laced}"
        return doc_id, n_bytes, self.size, self.sha.hexdigest(), zlib.crc32(self.tail), media_bytes, media_sha256, feature


def query(docs: DataFrame) -> DataFrame:
    """Every whole text stored as a Matroska file, read back from the packet table of that file, and digested.

    A file's packets come one after the other in one partition, so the digest is a running one: no
    shuffle, and no more than a batch of packets in memory.
    """
    kinds = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
    own = ("doc_id", "n_bytes", "media_bytes", "media_sha256")
    read = ("packet_no", "error", "track", "timestamp_ms", "lacing", "cluster", "cue_ms", "data")

    def run(batches):
        now = None

        def table(rows: list[tuple], like: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * (1 + len(kinds))
            arrow = [like, *[pa.int64() if k == "long" else pa.string() for k in kinds.values()]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, arrow)], names=["doc_id", *kinds])

        like = None
        for batch in batches:
            done, like = [], batch.column("doc_id").type
            head = zip(*(batch.column(c).to_pylist() for c in own))
            for of, (n, error, *packet) in zip(head, zip(*(batch.column(c).to_pylist() for c in read))):
                if error is not None:
                    raise ValueError(f"a stored file cannot be read back: {error}")
                if n == 0:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(of)
                now.add(*packet)
            yield table(done, like)
        if now is not None:
            yield table([now.row()], like)

    schema = T.StructType([docs.schema["doc_id"]])
    for name, kind in kinds.items():
        schema = schema.add(name, kind)
    return packets(stored(docs), with_data=True).mapInArrow(run, schema)
