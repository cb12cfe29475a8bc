"""Operator 4: scores of a Katz backoff n-gram model, learned from all training documents.

Katz: P(w|h) = d * c(hw) / c(h) for n-grams seen in training, else a(h) * P(w|h'), where h' is h without
its first word; P(w) = d * c(w) / N for words seen, and what the discounts leave for all others. The
discounts d are Good-Turing's, of each order's own counts of counts, for counts up to 5; a(h) makes the
probabilities after h sum to one exactly. A text is scored from start symbols to its end token.

Documents are dealt to blocks of about a million tokens. A block asks for what it needs, once for each
distinct n-gram it holds, as arrays of 64-bit hashes (`exchange`): so counts and weights are partitioned
tables of compact arrays, every n-gram travels once for each block that holds it rather than once for
each token, and hot words cost no more than rare ones. Rounds: counts of words; counts of pairs; weights
of words as histories, with the counts of triples; weights of pairs; scores. Where a word or pair stands once
in all documents, in training, so does every longer n-gram with it, and as a history it has one successor:
its block knows all there is to know of them and asks nothing. Blocks and answers lie in buckets of
blocks, so that an answer moves once, to its block, and the tokens move once in all.

Defined results: a null or empty text is its end token alone; without training rows every text's score
is that of unknown words, 0; rows without an id are training rows; repeated rows are learned and scored
as often as they stand; a very long text is scored whole, as a block of its own if need be; scores are
sums, so there are no ties to break; extra columns, of whatever name, are dropped. The counts of counts
may not give discounts between 0 and 1 on tiny corpora; then 1/2 is taken off every count up to 5. A
history whose counts are all undiscounted keeps 1 / (c(h) + 1) for the rest.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import Words, distinct, forget_shuffles, materialize, materialize_dealt, mix64, pieces_of, tidy, utf8
from citeloom.llm.exchange import ANSWER, QUESTION, Tree, ask, counts_of, exchange, get, get_planes, get_sorted, messages, opened, put, put_planes, put_sorted

END = np.uint64(0x2545F4914F6CDD1D)
START = np.uint64(0x9E6C63D0876A9A47)
HELD_OUT_OF, HELD_OUT = 7, 2
ORDER = 3
BLOCK_TOKENS = 1_000_000
PART_KEYS = 3_000_000
#: As many as Spark allows a table.
MOST_BUCKETS = 100_000
K = 5
#: Kinds of questions: counts of order m, its weights, and how many n-grams blocks know without asking.
COUNT, WEIGHT, ALONE = 0, 100, 200

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % HELD_OUT_OF == HELD_OUT


def blocks(docs: DataFrame) -> DataFrame:
    """One row for each block, in the form of an answer of kind 0.

    It is told ids, which of them are known, token counts, its distinct word hashes, their places by
    frequency and each token's rank.
    """

    def block(number, ids, hashed):
        words, at, order, starts = distinct(np.concatenate(hashed))
        frequent = np.argsort(-np.diff(starts, append=len(order)), kind="stable")  # tokens as ranks: small numbers pack well
        rank = np.empty_like(frequent)
        rank[frequent] = np.arange(len(frequent))
        own, known = np.array([i or 0 for i in ids], np.int64), np.array([i is not None for i in ids])
        told = [put(own), put(known), put(np.array([len(h) for h in hashed], np.int64)), put_sorted(words), put_planes(frequent), put_planes(rank[at])]
        return messages(ANSWER, [(number, 0, 0, told)])

    def run(batches):
        first = TaskContext.get().partitionId() << 24
        ids, hashed, size, n = [], [], 0, 0
        for batch in batches:
            texts, own = utf8(batch.column("text")), batch.column("doc_id").to_pylist()
            for a, b in pieces_of(texts):
                w = Words(texts[a:b])
                for i, s, e in zip(own[a:b], w.first, w.first[1:]):
                    ids.append(i)
                    hashed.append(np.append(w.hash[s:e], END))
                    size += e - s + 1
                    if size >= BLOCK_TOKENS:
                        yield block(first + n, ids, hashed)
                        ids, hashed, size, n = [], [], 0, n + 1
        if ids:
            yield block(first + n, ids, hashed)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), ANSWER)


class Order:
    """A block's distinct n-grams of one order, by hash, and what is known of each.

    token is each token's place among them, history the place of its history among those of the order
    below (one more for the start), lower the place of the n-gram without its first word.
    """

    def __init__(self, hashes: np.ndarray, token: np.ndarray, history: np.ndarray | None = None, lower: np.ndarray | None = None):
        self.hashes, self.token, self.history, self.lower = hashes, token, history, lower
        self.total = self.elsewhere = self.owner = self.alone = None


class Block:
    """A block's tokens and their n-grams."""

    def __init__(self, row: dict):
        self.number = row["asker"]
        ids, known, lengths, words, frequent, tokens = row["told"]
        ids, known = get(ids, np.int64), get(known, np.bool_)
        self.ids = [int(i) if k else None for i, k in zip(ids, known)]
        self.lengths = get(lengths, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        words, tokens = get_sorted(words), get_planes(frequent)[get_planes(tokens)]
        self.held = np.array([held_out(i) for i in self.ids])
        self.train = np.repeat(~self.held, self.lengths)
        self.orders = [Order(words, tokens)]
        self.word = words[tokens]
        self.gram, self.begin = self.word, [START]

    def grow(self) -> Order:
        """The n-grams of the next order."""
        low = self.orders[-1]
        context = np.empty_like(self.gram)
        context[1:] = self.gram[:-1]
        context[self.starts] = self.begin[-1]
        place = np.empty_like(low.token)
        place[1:] = low.token[:-1]
        place[self.starts] = len(low.hashes)
        self.gram = mix64(context * _FACTOR + self.word)
        self.begin.append(mix64(np.array([self.begin[-1]]) * _FACTOR + START)[0])
        hashes, token, order, starts = distinct(self.gram)
        first = order[starts]
        self.orders.append(Order(hashes, token, place[first], low.token[first]))
        return self.orders[-1]

    def histories(self, m: int) -> np.ndarray:
        """Hashes of the histories of order m: the n-grams below, and the start."""
        return np.append(self.orders[m - 2].hashes, self.begin[m - 2])

    def count_of_histories(self, m: int) -> np.ndarray:
        """c(h): a history is followed as often as it stands; the start as often as there are documents."""
        return np.append(self.orders[m - 2].total, self.documents)

    def alone_histories(self, m: int) -> np.ndarray:
        """Histories that stand once in all documents: here."""
        low = self.orders[m - 2]
        return np.append((low.total == 1) & ~low.elsewhere, False)

    def asked(self, m: int) -> np.ndarray:
        """Which n-grams of order m are asked for."""
        o = self.orders[m - 1]
        if m > 1 and o.alone is None:
            alone = self.alone_histories(m)  # an n-gram of which a part stands once stands once
            o.alone = alone[o.history] | alone[o.lower]
        elif m == 1:
            o.alone = np.zeros(len(o.hashes), bool)
        return ~o.alone

    def counted(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """How often each n-gram of order m stands here in training and in other documents."""
        o = self.orders[m - 1]
        n = len(o.hashes)
        return np.bincount(o.token[self.train], minlength=n), np.bincount(o.token[~self.train], minlength=n)

    def told(self, m: int, answer: list[np.ndarray] | None) -> None:
        """Take the answer on order m: counts in training, whether it stands in other documents, and what this block owns."""
        o, asked = self.orders[m - 1], self.asked(m)
        o.total, o.elsewhere, o.owner = np.ones(len(o.hashes), np.int64), np.zeros(len(o.hashes), bool), np.ones(len(o.hashes), bool)
        if answer:
            o.total[asked], o.elsewhere[asked], o.owner[asked] = answer[0] >> 1, (answer[0] & 1).astype(bool), answer[1].astype(bool)
        if m == 1:
            self.documents = int(o.total[np.searchsorted(o.hashes, END)])


def _count_question(b: Block, m: int, tree: Tree) -> list[tuple]:
    asked, (train, other) = b.asked(m), b.counted(m)
    out = ask(COUNT + m, b.number, tree.first, b.orders[m - 1].hashes[asked], train[asked], other[asked])
    alone = int((~asked).sum())
    return out + ask(ALONE + m, b.number, tree.first, np.zeros(1, np.uint64), np.array([alone])) if alone else out


def _stats(sums: list[np.ndarray]) -> list[int]:
    total = sums[0]
    if total.dtype.kind == "f":
        return [0] * (K + 3)
    return [int(total.sum()), int((total > 0).sum()), *[int((total == r).sum()) for r in range(1, K + 2)]]


def discounts(n: list[int]) -> np.ndarray:
    """Factors for counts 0..k (1 beyond) from the counts of counts n[0] of 1, n[1] of 2 and so on."""
    for k in range(min(K, len(n) - 1), 0, -1):
        if min(n[: k + 1]) <= 0:
            continue
        a = (k + 1) * n[k] / n[0]
        if a >= 1:
            continue
        d = [((r + 1) * n[r] / (r * n[r - 1]) - a) / (1 - a) for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            return np.array([0.0, *d])
    return np.array([0.0, *[(r - 0.5) / r for r in range(1, K + 1)]])


class Model:
    """What the counts of counts determine: the discounts of each order and the level of words."""

    def __init__(self):
        self.discount: list[np.ndarray] = []
        self.n = self.v = 0

    def add(self, stats: list[int], alone: int = 0) -> None:
        """The numbers of the next order, and how many of its n-grams were never asked for, each of count 1."""
        each = [stats[2] + alone, *stats[3:]]
        self.discount.append(discounts(each))
        if len(self.discount) > 1:
            return
        self.n, self.v = stats[0], stats[1]
        left = sum(c * r * (1 - self.discount[0][r]) for r, c in enumerate(each, 1) if r < len(self.discount[0]))
        self.scale = 1.0
        if self.n == 0:
            self.unknown = 1.0
        elif left <= 0:
            self.scale, self.unknown = self.n / (self.n + 1), 1 / (self.n + 1)
        else:
            self.unknown = left / self.n

    def discounted(self, count: np.ndarray, m: int) -> np.ndarray:
        d = self.discount[m - 1]
        return np.append(d, 1.0)[np.minimum(count, len(d))] * count

    def word(self, count: np.ndarray) -> np.ndarray:
        p = self.discounted(count, 1) * self.scale / max(self.n, 1)
        return np.where(count > 0, p, self.unknown)


def shares(missing: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For each history what the discounts took, over what its successors leave of the lower probability; negative, as if 1, where nothing was taken."""
    return np.where(missing > 0, missing, -1.0) / np.maximum(1 - p, 1e-12)


def weights(count: np.ndarray, share: np.ndarray) -> np.ndarray:
    """a(h) from c(h) and its share; negative where nothing was taken, 1 for histories not seen."""
    return np.where(count > 0, share / np.where(share < 0, count + 1, np.maximum(count, 1)), 1.0)


def probabilities(b: Block, model: Model, m: int, found: dict[int, list[np.ndarray]]) -> np.ndarray:
    """P of each n-gram of order m that the block holds, by the recursion of Katz."""
    p = model.word(b.orders[0].total)
    for k in range(2, m + 1):
        o = b.orders[k - 1]
        a = _all_weights(b, model, k, p, found[WEIGHT + k][0] if WEIGHT + k in found else None)
        safe = np.maximum(b.count_of_histories(k), 1)
        factor = np.where(a < 0, safe / (safe + 1), 1.0) / safe
        p = np.where(o.total > 0, model.discounted(o.total, k) * factor[o.history], np.abs(a)[o.history] * p[o.lower])
    return p


def _sums(b: Block, model: Model, m: int, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each history of order m what the discounts took of the n-grams that this block owns, and their lower probability."""
    o = b.orders[m - 1]
    own = np.flatnonzero(o.owner & (o.total > 0))
    n = len(b.orders[m - 2].hashes) + 1
    missing = o.total[own] - model.discounted(o.total[own], m)
    return np.bincount(o.history[own], weights=missing, minlength=n), np.bincount(o.history[own], weights=lower[o.lower[own]], minlength=n)


def _asked_histories(b: Block, m: int) -> np.ndarray:
    """Places of the histories that stand here, are known to training and not to this block alone, in the order of their hashes."""
    used = np.bincount(b.orders[m - 1].history, minlength=len(b.orders[m - 2].hashes) + 1) > 0
    at = np.flatnonzero(used & (b.count_of_histories(m) > 0) & ~b.alone_histories(m))
    return at[np.argsort(b.histories(m)[at], kind="stable")]


def _all_weights(b: Block, model: Model, m: int, lower: np.ndarray, told: np.ndarray | None) -> np.ndarray:
    missing, p = _sums(b, model, m, lower)
    count, share = np.where(b.alone_histories(m), b.count_of_histories(m), 0), shares(missing, p)
    if told is not None:
        at = _asked_histories(b, m)
        count[at], share[at] = b.count_of_histories(m)[at], told
    return weights(count, share)


def _weight_question(b: Block, model: Model, m: int, lower: np.ndarray, tree: Tree) -> list[tuple]:
    missing, p = _sums(b, model, m, lower)
    at = _asked_histories(b, m)
    return ask(WEIGHT + m, b.number, tree.first, b.histories(m)[at], missing[at], p[at])


def _solve(kind: int, sums: list[np.ndarray]) -> list[np.ndarray]:
    if kind >= ALONE:
        return [sums[0]]
    if kind >= WEIGHT:
        return [shares(sums[0], sums[1])]
    return [sums[0] << 1 | (sums[1] > 0)]


def _learn(b: Block, found: dict[int, list[np.ndarray]], most: int, answered: int) -> None:
    """Grow the block to order `most` and take the answers on counts, which are there up to order `answered`."""
    for m in range(1, most + 1):
        if m > 1:
            b.grow()
        if m <= answered:
            b.told(m, found.get(COUNT + m))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(table: DataFrame, answers: list[DataFrame], model: Model, order: int) -> DataFrame:
    def run(rows: pa.Table) -> pa.Table:
        row, found = opened(rows)
        b = Block(row)
        _learn(b, found, order, order)
        score = np.log10(probabilities(b, model, order, found))[b.orders[order - 1].token]
        count, token = b.orders[0].total, b.orders[0].token
        base = np.log10((count + 1) / (model.n + model.v + 1))[token]
        sums = [np.add.reduceat(x, b.starts) for x in ((count > 0).astype(np.int64)[token], base, score)]
        n = len(b.ids)
        cols = [pa.array(b.ids, pa.int64()), pa.array(b.held), pa.array(b.lengths), pa.array(sums[0]), pa.array(np.full(n, model.n)), pa.array(sums[1]), pa.array(sums[2])]
        return pa.Table.from_arrays(cols, names=[x.split()[0] for x in SCORES.split(", ")])

    return _with_answers(table, answers).applyInArrow(run, SCORES)


def _questions(table: DataFrame, answers: list[DataFrame], model: Model, tree: Tree, order: int, m: int) -> DataFrame:
    """Round m: the counts of order m (if it is one) and the weights of order m - 1 (from the third round on)."""

    def run(rows: pa.Table) -> pa.Table:
        row, found = opened(rows)
        b = Block(row)
        _learn(b, found, min(m, order), m - 1)
        out = _count_question(b, m, tree) if m <= order else []
        if m > 2:
            out += _weight_question(b, model, m - 1, probabilities(b, model, m - 2, found), tree)
        return pa.Table.from_batches([messages(QUESTION, out)])

    return _with_answers(table, answers).applyInArrow(run, QUESTION)


def _first_questions(table: DataFrame, tree: Tree) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield messages(QUESTION, _count_question(Block(row), 1, tree))

    return table.mapInArrow(tidy(run), QUESTION)


def _with_answers(table: DataFrame, answers: list[DataFrame]):
    """Blocks with the answers to them: all lie in the same buckets and have the same columns, so no row moves."""
    return reduce(DataFrame.union, [a.filter("asker >= 0") for a in answers], table).groupBy("asker")


def _dealt(table: DataFrame, buckets: int) -> DataFrame:
    """The blocks in buckets; their first table goes, and what wrote the second."""
    out = materialize_dealt(table, "asker", buckets, "dealt", done=(table,))
    forget_shuffles(table.sparkSession)
    return out


def score(docs: DataFrame, order: int = ORDER, fan: int | None = None) -> DataFrame:
    """Scores of all documents by the model of those that are not held out."""
    table = materialize(blocks(docs), "blocks")
    n = table.count()
    buckets = min(max(n, 1), MOST_BUCKETS)
    table = _dealt(table, buckets)
    tree = Tree(max(1, -(-n * BLOCK_TOKENS // PART_KEYS)), fan)
    model, answers = Model(), []
    for m in range(1, order + (2 if order > 1 else 1)):
        asked = _first_questions(table, tree) if m == 1 else _questions(table, answers, model, tree, order, m)
        answers.append(exchange(asked, tree, _solve, n, owners=True, stats=_stats, name=f"round{m}", buckets=buckets))
        if m <= order:
            said = counts_of(answers[-1], K + 3)
            model.add(said.get(COUNT + m, [0] * (K + 3)), said.get(ALONE + m, [0])[0])
        del asked
        forget_shuffles(docs.sparkSession)
    return _scores(table, answers, model, order)


def query(docs: DataFrame) -> DataFrame:
    return score(docs)
