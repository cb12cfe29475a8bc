"""Questions and answers between blocks of documents and parts of a hashed key space.

A block asks, once for each distinct 64-bit key it holds, and tells numbers with each key; whoever holds
the key's part adds up what all say and answers each in the order of its question. Keys travel as sorted
arrays, so the traffic is a few bytes for each distinct key of a block, however hot the key.

Parts are reached by a tree of a fixed fan: a block only ever asks FAN ranges of keys. Where more parts
are needed, the askers of a range are dealt to nodes, FAN to each; a node adds up its askers' keys, asks
FAN ranges within its own, and hands the answers down. So messages grow in proportion to the blocks (FAN
for each level), not to blocks times parts, and neither a node nor a part holds more than a bounded
number of keys.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import distinct, forget_shuffles, materialize, materialize_dealt

FAN = 4096


def put(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def get(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def put_sorted(x: np.ndarray) -> bytes:
    """Ascending 64-bit integers as byte planes of their differences."""
    d = np.diff(x, prepend=np.uint64(0))
    return put(d.view(np.uint8).reshape(-1, 8).T)


def get_sorted(b: bytes) -> np.ndarray:
    planes = get(b, np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def put_planes(x: np.ndarray) -> bytes:
    """Numbers below 2**32, small ones mostly, as byte planes."""
    return put(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def get_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(get(b, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    """An array of numbers: floats as byte planes, to 36 binary digits (ten decimal ones), others (not negative) in as few bytes as the largest needs."""
    if x.dtype.kind == "f":
        bits = np.ascontiguousarray(x, "<f8").view(np.uint64) & np.uint64(0xFFFFFFFFFFFF0000)
        return b"f" + put(bits.view(np.uint8).reshape(-1, 8).T)
    most = int(x.max()) if len(x) else 0
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max)
    return b"u" + np.dtype(kind).itemsize.to_bytes(1, "big") + put(x.astype(kind))


def unpacked(b: bytes) -> np.ndarray:
    if b[:1] == b"f":
        return np.ascontiguousarray(get(b[1:], np.uint8).reshape(8, -1).T).view("<f8").ravel()
    return get(b[2:], f"<u{b[1]}").astype(np.int64)


QUESTION = "part long, kind int, asker long, keys binary, said array<binary>"
ANSWER = "asker long, kind int, part long, told array<binary>"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}


def messages(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])


class Tree:
    """How many ranges each level has: the first at most `fan`, each further one `fan` times as many."""

    def __init__(self, parts: int, fan: int | None = None):
        self.fan, self.levels = fan or FAN, 1
        while self.fan**self.levels < parts:
            self.levels += 1
        self.first = max(1, -(-parts // self.fan ** (self.levels - 1)))

    def ranges(self, level: int) -> int:
        return self.first * self.fan**level


def ask(kind: int, asker: int, ranges: int, keys: np.ndarray, *values: np.ndarray) -> list[tuple]:
    """A question to each range that has one of the ascending keys, with a number or more for each key."""
    part = (keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(part)) + 1
    edges = [0, *cuts.tolist(), len(keys)] if len(keys) else [0]
    return [(int(part[i]), kind, asker, put_sorted(keys[i:j]), [packed(v[i:j]) for v in values]) for i, j in zip(edges, edges[1:])]


class Gathered:
    """The questions that a part or node got, by asker: its distinct keys and the sums of what was said."""

    def __init__(self, rows: list[dict]):
        self.rows = sorted(rows, key=lambda r: r["asker"])
        keys = [get_sorted(r["keys"]) for r in self.rows]
        self.starts = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        self.keys, self.at, self.order, _ = distinct(np.concatenate(keys))
        said = [np.concatenate(x) for x in zip(*[[unpacked(v) for v in r["said"]] for r in self.rows])]
        self.first = said[0]
        self.sums = [self._sum(x) for x in said]

    def _sum(self, x: np.ndarray) -> np.ndarray:
        total = np.bincount(self.at, weights=x, minlength=len(self.keys))
        return total if x.dtype.kind == "f" else np.rint(total).astype(np.int64)

    def answers(self, part: int, told: list[np.ndarray], own: np.ndarray | None) -> list[tuple]:
        """A row for each asker; of the keys that this part or node owns, the first asker that said more than 0 owns them."""
        out = []
        owner = np.zeros(len(self.at), np.uint8)
        if own is not None:
            seen = self.order[self.first[self.order] != 0]
            lead = seen[np.diff(self.at[seen], prepend=-1) != 0]
            owner[lead[own[self.at[lead]]]] = 1
        for r, i, j in zip(self.rows, self.starts, self.starts[1:]):
            mine = [packed(t[self.at[i:j]]) for t in told] + ([packed(owner[i:j])] if own is not None else [])
            out.append((r["asker"], r["kind"], part, mine))
        return out


def _merge(ranges: int):
    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        g = Gathered(rows)
        return pa.Table.from_batches([messages(QUESTION, ask(rows[0]["kind"], rows[0]["node"], ranges, g.keys, *g.sums))])

    return merge


def exchange(questions: DataFrame, tree: Tree, solve: Callable[[int, list[np.ndarray]], list[np.ndarray]], askers: int, owners: bool = False, stats: Callable[[list[np.ndarray]], list[int]] | None = None, name: str = "answers", buckets: int | None = None) -> DataFrame:
    """Answers (asker, kind, part, told) to questions asked of the tree's first level, in the order of each question.

    solve(kind, sums) gives one number or more for each key from the sums of what was said. With owners,
    a last array tells which of the keys that were said more than 0 the asker owns: each key has one
    owner. With stats, rows of askers below 0 hold numbers that each part made of its sums. With buckets,
    the answers lie dealt to as many by a hash of the asker.
    """
    levels = [questions]
    for level in range(tree.levels - 1):  # nodes merge the questions of up to `fan` askers and ask on
        groups = max(1, -(-askers // tree.fan))
        dealt = levels[-1].withColumn("node", F.col("part") * groups + F.pmod(F.xxhash64("asker"), F.lit(groups)))
        dealt = materialize(dealt, f"{name}_asked{level}")
        levels[-1] = dealt
        levels.append(dealt.groupBy("kind", "node").applyInArrow(_merge(tree.ranges(level + 1)), QUESTION))
        askers = groups * tree.ranges(level)

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        g = Gathered(rows)
        out = g.answers(rows[0]["part"], solve(rows[0]["kind"], g.sums), np.ones(len(g.keys), bool) if owners else None)
        if stats:
            out.append((-1 - rows[0]["part"], rows[0]["kind"], rows[0]["part"], [np.array(stats(g.sums), ">i8").tobytes()]))
        return pa.Table.from_batches([messages(ANSWER, out)])

    def written(table: DataFrame, level: int, name: str) -> DataFrame:
        out = materialize(table, name)
        if not buckets or level:
            return out
        forget_shuffles(out.sparkSession)  # the questions go before the answers are dealt
        return materialize_dealt(out, "asker", buckets, name, done=(out,))

    answers = written(levels[-1].groupBy("kind", "part").applyInArrow(answer, ANSWER), tree.levels - 1, name)
    numbers = answers.filter("asker < 0") if stats else None
    for level in reversed(range(tree.levels - 1)):  # answers go down: a node's own, told on to its askers
        dealt = levels[level]

        def hand_down(asked: pa.Table, told: pa.Table) -> pa.Table:
            if not asked.num_rows:
                return pa.Table.from_batches([messages(ANSWER, [])])
            g = Gathered(asked.to_pylist())
            back = sorted(told.to_pylist(), key=lambda r: r["part"])
            arrays = [np.concatenate(x) for x in zip(*[[unpacked(v) for v in r["told"]] for r in back])]
            own = arrays.pop().astype(bool) if owners else None
            return pa.Table.from_batches([messages(ANSWER, g.answers(asked.column("part")[0].as_py(), arrays, own))])

        mine = answers.filter("asker >= 0").withColumnRenamed("asker", "node")
        down = dealt.groupBy("kind", "node").cogroup(mine.groupBy("kind", "node")).applyInArrow(hand_down, ANSWER)
        if numbers is not None and level == 0:
            down = down.unionByName(numbers)
        answers = written(down, level, f"{name}_told{level}")
    forget_shuffles(questions.sparkSession)
    return answers


def counts_of(answers: DataFrame, n: int) -> dict[int, list[int]]:
    """By kind, the sums over all parts of the n numbers that stats made; the driver gets one row a kind."""
    at = [F.sum(F.conv(F.hex(F.expr(f"substring(told[0], {8 * i + 1}, 8)")), 16, 10).cast("long")).alias(f"s{i}") for i in range(n)]
    return {r["kind"]: list(r)[1:] for r in answers.filter("asker < 0").groupBy("kind").agg(*at).collect()}


def with_answers(table: DataFrame, *answers: DataFrame):
    """Rows of a table of blocks (block, ...) as `kind` 0, with the answers to them, grouped by block."""
    out = table.withColumn("kind", F.lit(0))
    for a in answers:
        out = out.unionByName(a.filter("asker >= 0").withColumnRenamed("asker", "block"), allowMissingColumns=True)
    return out.groupBy("block")


def opened(rows: pa.Table) -> tuple[dict, dict[int, list[np.ndarray]]]:
    """The row of a block, and by kind its answers, in the order of its question."""
    found = rows.to_pylist()
    by_kind: dict[int, list[dict]] = {}
    for r in sorted((r for r in found if r["kind"]), key=lambda r: r["part"]):
        by_kind.setdefault(r["kind"], []).append(r)
    told = {k: [np.concatenate(x) for x in zip(*[[unpacked(v) for v in r["told"]] for r in rs])] for k, rs in by_kind.items()}
    return next(r for r in found if r["kind"] == 0), told
