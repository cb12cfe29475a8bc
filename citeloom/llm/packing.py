"""Operator 2: packing token sequences by shortest-pack-first over the length histogram.

Documents are tokenised once; what exceeds a sequence is cut into full sequences. Only the histogram
of piece lengths, at most `size` rows however many documents there are, reaches the driver. There
lengths are placed longest first into the pack that is shortest so far, as counts of packing patterns;
the patterns are then joined back to the pieces by their rank within their length.

Defined results: a null text packs like an empty one, as the end token alone; a very long text is cut
into full sequences and a rest; an empty table gives no rows; repeated rows are packed as often as they
stand, as copies told apart by number; pieces of one length are ranked by id, place and checksum, so
ties are between like pieces only; extra columns, of whatever name, are dropped.
"""

from __future__ import annotations

import unicodedata
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import Words, materialize, pieces_of, ranked, tidy, utf8

SIZE = 4096
CHUNK = 1_000_000
END = 2


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ASCII punctuation.
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _letters(core: bytes) -> bool:
    """Whether the tokeniser's normal form is letters only; U+0130 becomes i and a dot that joins the punctuation behind."""
    t = core.decode("utf-8", "replace")
    return t.isalpha() and unicodedata.normalize("NFC", t).lower().isalpha()


class WordIds(dict):
    """word -> its token ids as little-endian 32-bit integers.

    The tokeniser drops white space and never joins across it, so a text's ids are its words' ids in
    order. A word of letters with punctuation behind is two such runs, so most words are put together
    from the ids of their letters and of their punctuation. A text that holds the string of a special
    token (in any case, white space within included) is encoded as a whole, since such strings are told
    apart before words are. At most `most` words and as many runs of letters are remembered.
    """

    def __init__(self, path: str, most: int = 450_000):
        super().__init__()
        from tokenizers import Tokenizer

        self.most = most
        self.runs: dict[bytes, bytes] = {b"": b""}
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a run
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def ids(self, texts: list[bytes | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts, each followed by `end`, and where each text begins (and the last one ends)."""
        low = b"\0".join([t or b"" for t in texts]).lower()
        if any(x in low for x in self.special):
            odd = [i for i, t in enumerate(texts) if t and any(x in t.lower() for x in self.special)]
            return self._with_special(texts, odd, end)
        w = Words(texts)
        _, lead, at = np.unique(w.hash, return_index=True, return_inverse=True)
        distinct = [w.buffer[s:e] for s, e in zip(w.start[lead].tolist(), w.end[lead].tolist())]
        self.learn(set(distinct))
        found = [self[x] for x in distinct]
        table = np.frombuffer(b"".join(found), "<u4")
        counts = np.array([len(x) // 4 for x in found], np.int64)
        begin = np.cumsum(counts) - counts
        n = counts[at]  # ids of each word
        to = np.cumsum(n)
        before = np.concatenate([[0], to])
        text = np.repeat(np.arange(len(texts)), np.diff(w.first))  # of each word
        place = np.arange(before[-1])
        out = np.full(before[-1] + len(texts), end, "<u4")
        out[place + np.repeat(text, n)] = table[place + np.repeat(begin[at] - to + n, n)]
        return out, before[w.first] + np.arange(len(texts) + 1)

    def _with_special(self, texts: list[bytes | None], odd: list[int], end: int) -> tuple[np.ndarray, np.ndarray]:
        """ids(), where the texts of `odd` hold special tokens and are encoded as they are."""
        whole = dict(zip(odd, self._encode([texts[i].decode("utf-8", "replace") for i in odd])))
        flat, first = self.ids([None if i in whole else t for i, t in enumerate(texts)], end)
        parts = [flat[a:b] for a, b in zip(first, first[1:])]
        for i, ids in whole.items():
            parts[i] = np.append(ids, np.uint32(end)).astype("<u4")
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_runs(self, runs: list[bytes]) -> None:
        """Runs of letters are encoded many at a time, as one text, and told apart by their last tokens."""
        if len(self.runs) + len(runs) > self.most:
            self.runs = {b"": b""}
        for i in range(0, len(runs), 50_000):
            lines = [runs[j : j + 500] for j in range(i, min(i + 50_000, len(runs)), 500)]
            for line, ids in zip(lines, self._encode([b" ".join(x).decode() for x in lines])):
                cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
                if len(cuts) != len(line):  # each run ends at least once; some fall apart
                    self.runs.update(zip(line, [x.tobytes() for x in self._encode([x.decode() for x in line])]))
                    continue
                flat, at = ids.tobytes(), 0
                for run, to in zip(line, cuts.tolist()):
                    self.runs[run] = flat[at:to]
                    at = to

    def learn(self, tokens: set[bytes]) -> None:
        if len(self) + len(tokens) > self.most:
            self.clear()  # a single chunk may hold more, and then does for a while
        new = tokens.difference(self)
        plain, other, need, tails = [], [], set(), set()
        for w in new:
            low = w.lower()
            core = low.rstrip(_MARKS)
            if core.isalpha() or not core or not core.isascii() and _letters(core):
                tail = low[len(core) :]
                plain.append((w, core, tail))
                need.add(core)
                tails.add(tail)
            else:
                other.append(w)
        runs = need.difference(self.runs)
        if len(self.runs) + len(runs) > self.most:
            self.runs, runs = {b"": b""}, need - {b""}
        self._learn_runs(list(runs))
        tails = list(tails.difference(self.runs))
        self.runs.update(zip(tails, [x.tobytes() for x in self._encode([t.decode() for t in tails])]))
        runs = self.runs
        for w, core, tail in plain:
            self[w] = runs[core] + runs[tail]
        self.update(zip(other, [x.tobytes() for x in self._encode([w.decode("utf-8", "replace") for w in other])]))


_ids: dict[str, WordIds] = {}


def _words(path: str) -> WordIds:
    if path not in _ids:
        _ids[path] = WordIds(path)
    return _ids[path]


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and the ids themselves) of pieces of at most `size` tokens."""
    path = tokenizer or default_tokenizer()
    step = 4 * size

    def run(batches):
        known = _words(path)
        for batch in batches:
            ids = batch.column("doc_id")
            texts = utf8(batch.column("text"))
            for at, stop in pieces_of(texts, CHUNK):
                flat, first = known.ids(texts[at:stop], end)
                origin, cols, blobs = [], ([], [], [], []), []
                for i in range(at, stop):
                    own = flat[first[i - at] : first[i - at + 1]].tobytes()
                    for a in range(0, len(own), step):
                        part = own[a : a + step]
                        origin.append(i)
                        for c, v in zip(cols, (a // 4, len(part) // 4, zlib.crc32(part), len(own) // 4)):
                            c.append(v)
                        if with_ids:
                            blobs.append(part)
                arrays = [ids.take(pa.array(origin, pa.int64())), *[pa.array(c, pa.int64()) for c in cols]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    arrays.append(pa.array(blobs, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = T.StructType([docs.schema["doc_id"]])
    for name in ("start", "length", "ids_crc32", "doc_tokens"):
        schema = schema.add(name, "long")
    if with_ids:
        schema = schema.add("ids", "binary")
    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


@dataclass
class Plan:
    """For each length: from which rank on, which first sequence, offset and repeats within a sequence hold."""

    rank: dict[int, list[int]] = field(default_factory=dict)
    place: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)
    sequences: int = 0


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> Plan:
    """Place all lengths; a pattern is a list of (length, repeats) with a count of sequences."""
    room: list[list[tuple[int, tuple]]] = [[] for _ in range(size + 1)]  # by free space: (count, pattern)
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left = histogram[length]
        free = size
        while left:
            while free >= length and not room[free]:
                free -= 1
            if free < length:  # no pack has room: open packs and fill each with repeats
                fit = size // length
                whole, rest = divmod(left, fit)
                if whole:
                    room[size - fit * length].append((whole, ((length, fit),)))
                if rest:
                    room[size - rest * length].append((1, ((length, rest),)))
                break
            count, pattern = room[free].pop()
            used = min(count, left)
            if used < count:
                room[free].append((count - used, pattern))
            last = pattern[-1]
            grown = (*pattern[:-1], (length, last[1] + 1)) if last[0] == length else (*pattern, (length, 1))
            room[free - length].append((used, grown))
            left -= used
            free = size if free - length > free else free
    plan, placed = Plan(), {}
    for packs in room:
        for count, pattern in packs:
            offset = 0
            for length, repeats in pattern:
                rank = placed.get(length, 0)
                plan.rank.setdefault(length, []).append(rank)
                plan.place.setdefault(length, []).append((plan.sequences, offset, repeats))
                placed[length] = rank + count * repeats
                offset += length * repeats
            plan.sequences += count
    return plan


def assign(ranked_pieces: DataFrame, plan: Plan) -> DataFrame:
    """Give ranked pieces (length, rank) their sequence and offset; the plan is bounded by the histogram."""
    tables = {n: (np.array(r, np.int64), np.array(plan.place[n], np.int64).reshape(-1, 3)) for n, r in plan.rank.items()}
    keep = [c for c in ranked_pieces.columns if c != "rank"]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for part in np.split(order, cuts) if len(order) else ():
                n = int(length[part[0]])
                starts, place = tables[n]
                k = np.searchsorted(starts, rank[part], "right") - 1
                inner = rank[part] - starts[k]
                seq[part] = place[k, 0] + inner // place[k, 2]
                off[part] = place[k, 1] + inner % place[k, 2] * n
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(seq), pa.array(off)], names=[*keep, "sequence_id", "offset"])

    schema = T.StructType([ranked_pieces.schema[c] for c in keep]).add("sequence_id", "long").add("offset", "long")
    return ranked_pieces.mapInArrow(tidy(run), schema)


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row for each piece with its copy number, its sequence and its offset there.

    Rows equal in id and text are copies of one document, numbered from 0; their pieces are alike, so it
    does not matter which copy a piece belongs to, only that each copy has all of its pieces.
    """
    cut = materialize(pieces(docs, tokenizer, size, end, with_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = shortest_pack_first(histogram, size)
    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    return assign(ranked(cut, ["length"], order, "rank", sum(histogram.values()), ties="copy"), plan)


def query(docs: DataFrame) -> DataFrame:
    out = pack(docs)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "copy")


def sequences(docs: DataFrame) -> DataFrame:
    """The packed corpus: the digest's columns and the token ids of every piece, little-endian 32-bit."""
    out = pack(docs, with_ids=True)
    return out.select("doc_id", "copy", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")
