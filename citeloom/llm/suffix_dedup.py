"""Operator 9: repeated passages by sparse suffix arrays.

A passage is repeated where at least `least` words in a row (50 by default, A-Z lower case, white space
aside) stand elsewhere too; all but its first occurrence, by document id and place, are cut out.

1. Suffixes are retained at minimiser positions: in every window of `least` words, the run of GRAM words
   with the least hash. Two equal windows retain the same position, whatever stands around them. Only
   suffixes whose run is found twice or more are looked at again (counts by hash; a collision only adds
   work).
2. The retained suffixes are sorted by their words, neighbours are compared word by word, and likewise
   their texts to the left. From the lengths of these common runs follows, for each suffix, how far its
   match with the others extends to both sides, and so which of the windows that retained it are equal.
   The first of equal windows stays, the others are repeats.
3. That is done within each block of documents first. First windows that another block holds too (by
   counts of their hashes) go on, with the words around their suffix, to nodes of a tree: FAN blocks
   meet in a node, are sorted and compared there, and the firsts of a node go on to the next level.

So exactly the windows that occurred before are cut out, as if all pairs of places had been compared by
their words, but only about 2 in 32 suffixes are sorted. A passage that very many documents share comes
once from each block, and no node holds more than FAN blocks' worth of it.

Defined results: null and empty texts stay as they are; very long texts are read whole, as a block of
their own if need be; ties of ids go to the row that stands first; rows without an id come last;
repeated rows are repeats of the first of them; a document cut out whole keeps an empty text; an empty
table gives no rows; extra columns pass through, but for those named like the columns of ADDED, which
are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import Words, forget_shuffles, materialize, mix64, pieces_of, tidy, utf8
from citeloom.llm.exchange import ANSWER, FAN, QUESTION, Tree, ask, exchange, messages, opened, packed, unpacked, with_answers

LEAST = 50
GRAM = 20
BLOCK_BYTES = 4_000_000
PART_KEYS = 2_000_000
NODE_RECORDS = 20_000
SUFFIXES, WINDOWS, LOCAL, SORTED = 1, 2, 3, 4
ADDED = "n_words long, n_cut long, spans array<struct<start:long,end:long>>"

_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_WORD = re.compile(rb"[^ \t-\r]+")


def blocks(docs: DataFrame) -> DataFrame:
    """Rows of docs in blocks of about BLOCK_BYTES of text: block, data (compressed Arrow stream)."""

    def pack(number: int, found: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        table = pa.Table.from_batches(found).combine_chunks()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "data"])

    def run(batches):
        first = TaskContext.get().partitionId() << 24
        found, size, n = [], 0, 0
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                found.append(batch)
                size += sum(map(len, filter(None, utf8(batch.column("text")))))
                if size >= BLOCK_BYTES:
                    yield pack(first + n, found)
                    found, size, n = [], 0, n + 1
        if found:
            yield pack(first + n, found)

    return docs.mapInArrow(tidy(run), "block long, data binary")


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each place on (meaningless for the last n - 1 places)."""
    powers = np.full(len(h), _FACTOR, np.uint64)
    inverse = np.full(len(h), _INVERSE, np.uint64)
    if len(h):
        powers[0] = inverse[0] = 1
    powers, inverse = np.cumprod(powers, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers, dtype=np.uint64)])
    end = np.minimum(np.arange(len(h)) + n, len(h))
    return mix64((total[end] - total[:-1]) * inverse + np.uint64(n))


def minimisers(h: np.ndarray, span: int) -> np.ndarray:
    """The first place of the least of h[i], ..., h[i + span - 1] for each i (cut off at the end)."""
    at = np.arange(len(h))
    width = 1
    while width < span:
        step = min(width, span - width)
        other = at[np.minimum(np.arange(len(h)) + step, len(h) - 1)]
        at = np.where(h[other] < h[at], other, at)
        width += step
    return at


def _sorted_runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of word numbers, and how many leading words each has in common with the one before it."""
    n, width = words.shape
    if not width:
        return np.arange(n), np.zeros(n, np.int64)
    order = np.argsort(np.ascontiguousarray(words.astype(">i4") + np.int32(1)).view(f"V{4 * width}").ravel(), kind="stable")
    rows = words[order]
    same = np.ones((n, width + 1), bool)
    same[1:, :width] = rows[1:] == rows[:-1]
    same[:, width] = False
    common = np.argmin(same, axis=1)
    common[0] = 0
    return order, common


def repeated(right: np.ndarray, left: np.ndarray, has: np.ndarray, rank: np.ndarray, least: int) -> np.ndarray:
    """Of the windows of suffixes, those that an earlier suffix has too.

    right and left: word numbers from a suffix's place on and from there backwards, -1 beyond the text;
    has[i, o]: whether the window that begins o words before suffix i is in question; rank: the order of
    the suffixes' documents and places.
    """
    n, span = has.shape
    out = np.zeros((n, span), bool)
    if n < 2:
        return out
    by_right, run_right = _sorted_runs(right)
    by_left, run_left = _sorted_runs(left)
    group_right, group_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(span):
        rows = np.flatnonzero(has[:, o])
        if len(rows) < 2:
            continue
        # equal from here on by least - o words at least, and backwards by o
        group_right[by_right] = np.cumsum(run_right < least - o)
        group_left[by_left] = np.cumsum(run_left < o) if o else 0
        key = group_right[rows] * (n + 1) + group_left[rows]
        order = np.lexsort((rank[rows], key))
        again = np.zeros(len(rows), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        out[rows[again], o] = True
    return out


class Block:
    """Words of a block's documents, and its windows: `start` of each among all words and the suffix `at` that it retains."""

    def __init__(self, number: int, data: bytes, least: int):
        self.number, self.least, self.table = number, least, pa.ipc.open_stream(data).read_all()
        self.texts = [x for x in utf8(self.table.column("text"))]
        found = [Words(self.texts[a:b]) for a, b in pieces_of(self.texts)]
        none = np.empty(0, np.int64)
        self.lengths = np.concatenate([np.diff(w.first) for w in found]) if found else none
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.hashes = np.concatenate([w.hash for w in found]) if found else np.empty(0, np.uint64)
        base = np.concatenate([[0], np.cumsum([len(w.buffer) for w in found])])
        self.buffer = b"".join([w.buffer for w in found])
        self.begin = np.concatenate([w.start + b for w, b in zip(found, base)]) if found else none
        self.end = np.concatenate([w.end + b for w, b in zip(found, base)]) if found else none
        del found
        self.document = np.repeat(np.arange(len(self.texts)), self.lengths)
        room = np.repeat(self.first + self.lengths, self.lengths) - np.arange(len(self.hashes))
        self.gram = min(GRAM, least)
        self.suffix = grams(self.hashes, self.gram)
        self.start = np.flatnonzero(room >= least)
        self.at = minimisers(self.suffix, least - self.gram + 1)[self.start] if len(self.hashes) else self.start
        ids = self.table.column("doc_id").to_pylist()
        self.ids = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)

    def retained(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes of the retained suffixes, ascending, and how often each stands."""
        return np.unique(self.suffix[np.unique(self.at)], return_counts=True)

    def keep(self, hot: np.ndarray) -> None:
        """Only windows whose suffix is repeated, as the bits of `hot` tell for the retained hashes."""
        keys, _ = self.retained()
        kept = np.isin(self.suffix[self.at], keys[hot.astype(bool)])
        self.start, self.at = self.start[kept], self.at[kept]

    def context(self, places: np.ndarray, back: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact word numbers from each place on and backwards, as far as `ahead` and `back` tell; -1 beyond."""
        marks = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(marks, places - back, 1)
        np.add.at(marks, places + ahead, -1)
        used = np.flatnonzero(np.cumsum(marks[:-1]))
        number, known = np.full(len(self.hashes) + 1, -1, np.int32), {}
        number[used] = [known.setdefault(self.buffer[a:b], len(known)) for a, b in zip(self.begin[used].tolist(), self.end[used].tolist())]
        j = np.arange(self.least)
        right = np.where(j < ahead[:, None], number[np.minimum(places[:, None] + j, len(self.hashes))], -1)
        j = np.arange(self.least - self.gram)
        left = np.where(j < back[:, None], number[np.maximum(places[:, None] - 1 - j, 0)], -1)
        return right, left

    def local(self) -> np.ndarray:
        """Starts of the windows that an earlier place of the block has too."""
        if not len(self.start):
            return self.start
        places, of = np.unique(self.at, return_inverse=True)
        has = np.zeros((len(places), self.least - self.gram + 1), bool)
        has[of, self.at - self.start] = True
        back, ahead = self._reach(has)
        right, left = self.context(places, back, ahead)
        order = np.lexsort((places, places - self.first[self.document[places]], self.ids[self.document[places]]))
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        again = repeated(right, left, has, rank, self.least)
        return np.sort(self.start[again[of, self.at - self.start]])

    def _reach(self, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words before and from each suffix on its windows take."""
        span = has.shape[1]
        return span - 1 - np.argmax(has[:, ::-1], axis=1), self.least - np.argmax(has, axis=1)

    def firsts(self, local: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes (ascending), starts and suffixes of the windows that stand first in the block."""
        new = ~np.isin(self.start, local)
        start, at = self.start[new], self.at[new]
        keys = grams(self.hashes, self.least)[start]
        order = np.argsort(keys, kind="stable")
        return keys[order], start[order], at[order]

    def records(self, start: np.ndarray, at: np.ndarray) -> list[tuple]:
        """A record for each suffix of these windows: its run's hash, where it stands, its windows and the words around it."""
        places, of = np.unique(at, return_inverse=True)
        has = np.zeros((len(places), self.least - self.gram + 1), bool)
        has[of, at - start] = True
        back, ahead = self._reach(has)
        out = []
        for k, (p, l, r) in enumerate(zip(places.tolist(), back.tolist(), ahead.tolist())):
            d = int(self.document[p])
            words = [self.buffer[a:b] for a, b in zip(self.begin[p - l : p + r].tolist(), self.end[p - l : p + r].tolist())]
            out.append((int(self.suffix[p].view(np.int64)), self.number, p, int(self.ids[d]), p - int(self.first[d]), packed(np.flatnonzero(has[k])), l, b" ".join(words)))
        return out

    def spans(self, starts: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Word spans to cut, by document, from the ascending starts of repeated windows."""
        out: dict[int, list[tuple[int, int]]] = {}
        if not len(starts):
            return out
        document = self.document[starts]
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (np.diff(starts) > self.least) | (np.diff(document) > 0)
        last = np.append(np.flatnonzero(fresh)[1:] - 1, len(starts) - 1)
        for a, b in zip(np.flatnonzero(fresh), last):
            d = int(document[a])
            out.setdefault(d, []).append((int(starts[a] - self.first[d]), int(starts[b] + self.least - self.first[d])))
        return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without its words [start, end) of each span and the white space after them."""
    places = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a]])
        at = places[b]
    out.append(text[at:])
    return b"".join(out).strip(b" \t\n\x0b\x0c\r") if spans else text


def _suffix_questions(table: DataFrame, tree: Tree, least: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield messages(QUESTION, ask(SUFFIXES, row["block"], tree.first, *Block(row["block"], row["data"], least).retained()))

    return table.mapInArrow(tidy(run), QUESTION)


def _block(rows: pa.Table, least: int) -> tuple[Block, dict[int, list[np.ndarray]]]:
    row, told = opened(rows)
    b = Block(row["block"], row["data"], least)
    b.keep(told[SUFFIXES][0] if SUFFIXES in told else np.zeros(len(b.retained()[0]), bool))
    return b, told


def _window_questions(table: DataFrame, suffixes: DataFrame, tree: Tree, least: int) -> DataFrame:
    """What each block finds within itself (part -1), and its question after the windows that stand first in it."""

    def run(rows: pa.Table) -> pa.Table:
        b, _ = _block(rows, least)
        local = b.local()
        keys, _, _ = b.firsts(local)
        distinct = np.unique(keys)
        out = ask(WINDOWS, b.number, tree.first, distinct, np.ones(len(distinct), np.int64))
        return pa.Table.from_batches([messages(QUESTION, [*out, (-1, LOCAL, b.number, b"", [packed(local)])])])

    return with_answers(table, suffixes).applyInArrow(run, QUESTION)


RECORD = "key long, block long, place long, doc long, offset long, windows binary, back int, words binary"


def _records(table: DataFrame, suffixes: DataFrame, local: DataFrame, shared: DataFrame, least: int) -> DataFrame:
    """Records of the windows that stand first in their block and in another block too."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in RECORD.split(", ")]

    def run(rows: pa.Table) -> pa.Table:
        b, told = _block(rows, least)
        keys, start, at = b.firsts(told[LOCAL][0])
        hot = told[WINDOWS][0].astype(bool) if WINDOWS in told else np.zeros(len(np.unique(keys)), bool)
        wanted = hot[np.unique(keys, return_inverse=True)[1]]
        out = b.records(start[wanted], at[wanted])
        cols = list(zip(*out)) or [()] * len(fields)
        return pa.table({n: pa.array(c, kinds[k]) for c, (n, k) in zip(cols, fields)})

    return with_answers(table, suffixes, local, shared).applyInArrow(run, RECORD)


def _compare(records: DataFrame, least: int) -> DataFrame:
    """Nodes of records sorted and compared: of each record the windows that the node has before (again) and those it has first."""
    schema = T._parse_datatype_string(RECORD + ", again binary")
    span = least - min(GRAM, least) + 1

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        known: dict[bytes, int] = {}
        n = len(rows)
        right, left = np.full((n, least), -1, np.int32), np.full((n, span - 1), -1, np.int32)
        has = np.zeros((n, span), bool)
        for i, r in enumerate(rows):
            words = [known.setdefault(w, len(known)) for w in r["words"].split(b" ")]
            right[i, : len(words) - r["back"]] = words[r["back"] :]
            left[i, : r["back"]] = words[: r["back"]][::-1]
            has[i, unpacked(r["windows"])] = True
        order = sorted(range(n), key=lambda i: (rows[i]["doc"], rows[i]["offset"], rows[i]["block"], rows[i]["place"]))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        again = repeated(right, left, has, rank, least)
        keep = table.select([f.name for f in schema.fields[:5]])
        return keep.append_column("windows", pa.array([packed(np.flatnonzero(h & ~a)) if (h & ~a).any() else None for h, a in zip(has, again)], pa.binary())).append_column("back", table.column("back")).append_column("words", table.column("words")).append_column("again", pa.array([packed(np.flatnonzero(a)) if a.any() else None for a in again], pa.binary()))

    return records.groupBy("_part", "_group").applyInArrow(run, schema)


def _verdicts(records: DataFrame, blocks: int, least: int, fan: int) -> DataFrame:
    """Starts of repeated windows, as answers to their blocks, from all levels of the tree."""
    n = records.count()
    parts = max(1, -(-n // NODE_RECORDS))
    out, live, groups, level = None, records, blocks, 0
    while True:
        groups = max(1, -(-groups // fan))
        at = F.pmod(F.xxhash64(F.lit(level), "block"), F.lit(groups))
        dealt = live.withColumn("_part", F.pmod(F.xxhash64("key"), F.lit(parts))).withColumn("_group", at)
        done = materialize(_compare(dealt, least), "compared")
        found = done.filter("again IS NOT NULL").select(F.col("block").alias("asker"), F.lit(SORTED).alias("kind"), "place", "again")
        out = found if out is None else out.unionByName(found)
        if groups == 1:
            return out
        live, level = done.filter("windows IS NOT NULL").drop("again"), level + 1


def _starts(found: DataFrame) -> DataFrame:
    """Verdicts as one answer for each block."""

    def run(table: pa.Table) -> pa.Table:
        starts = np.concatenate([p - unpacked(a) for p, a in zip(table.column("place").to_pylist(), table.column("again").to_pylist())])
        return pa.Table.from_batches([messages(ANSWER, [(table.column("asker")[0].as_py(), SORTED, 0, [packed(np.unique(starts))])])])

    return found.groupBy("asker").applyInArrow(run, ANSWER)


def repeats(docs: DataFrame, least: int = LEAST, with_text: bool = True, fan: int | None = None) -> DataFrame:
    """docs with n_words, n_cut and spans (of words), and its text cut, or dropped if not wanted."""
    names = [x.split()[0] for x in ("n_words", "n_cut", "spans")]
    keep = [c for c in docs.columns if c not in names]
    table = materialize(blocks(docs.select(*keep)), "blocks")
    n = table.count()
    tree = Tree(max(1, n * BLOCK_BYTES // 6 // PART_KEYS), fan)
    solve = lambda kind, sums: [(sums[0] > 1).astype(np.int64)]
    suffixes = exchange(_suffix_questions(table, tree, least), tree, solve, n, name="suffixes")
    asked = materialize(_window_questions(table, suffixes, tree, least), "windows")
    local = asked.filter(F.col("kind") == LOCAL).select("asker", "kind", "part", F.col("said").alias("told"))
    shared = exchange(asked.filter(F.col("kind") == WINDOWS), tree, solve, n, name="shared")
    records = materialize(_records(table, suffixes, local, shared, least), "records", done=(suffixes, shared))
    forget_shuffles(docs.sparkSession)
    verdicts = materialize(_starts(_verdicts(records, n, least, fan or FAN)), "verdicts", done=(records,))
    forget_shuffles(docs.sparkSession)
    kept = [c for c in keep if with_text or c != "text"]
    schema = T.StructType([docs.schema[c] for c in kept] + T._parse_datatype_string(ADDED).fields)

    def run(rows: pa.Table) -> pa.Table:
        row, told = opened(rows)
        b = Block(row["block"], row["data"], least)
        starts = np.unique(np.concatenate([told[k][0] for k in (LOCAL, SORTED) if k in told]))
        spans = b.spans(starts)
        cols = []
        for c in kept:
            if c == "text":
                cols.append(pa.array([cut(x, spans[i]).decode("utf-8", "replace") if i in spans else None if x is None else x.decode("utf-8", "replace") for i, x in enumerate(b.texts)], pa.string()))
            else:
                cols.append(b.table.column(c).combine_chunks())
        every = [[{"start": s, "end": e} for s, e in spans.get(i, [])] for i in range(len(b.texts))]
        cols += [pa.array(b.lengths), pa.array([sum(e - s for s, e in spans.get(i, [])) for i in range(len(b.texts))], pa.int64()), pa.array(every, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
        return pa.Table.from_arrays(cols, names=[*kept, *names])

    return with_answers(table, local, verdicts).applyInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    """What is cut from every document: word counts and spans."""
    return repeats(docs.select("doc_id", "text"), with_text=False)


def cut_documents(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs without repeated passages; documents of which nothing is left go."""
    out = repeats(docs, least).filter("n_cut = 0 OR n_cut < n_words")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_cut") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
