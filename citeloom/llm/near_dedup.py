"""Operator 1: near-duplicate documents by bottom-k sketches of one hash function.

1. Each document becomes its set of word shingles, as 64-bit hashes; documents with equal sets form a
   class, and the least id stands for it. The k smallest hashes are the class's sketch.
2. Inverted lists of retained values generate overlaps. A pair whose union sketch shows at least the
   required share must have a value in common among the rarest values of each side, so only those
   are listed (for small sets the sketch is the whole set and this is exact; for others the required
   share lies five standard deviations below the threshold).
3. Short lists give all their pairs. In a long list every member is paired with the list's hub, the
   class whose values are the most frequent, which is the original of a family of copies.
4. Sizes and the estimate from the union sketch filter the pairs; exact Jaccard similarity of the full
   sets verifies them; components join what is linked.
5. Exact way for the rest: in families (members of a hub's lists) that are still split, those outside
   the largest component are compared exactly with all members, in blocks of bounded size.

No step emits all pairs of a long list, and no task gathers a list: hubs are maxima, texts are dealt
to blocks.

Defined results: texts without words have the empty set and are linked with nothing, as are rows
without an id; a text of fewer words than a shingle has its whole sequence as its one shingle; rows
that share an id are one document; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import Words, materialize, mix64, pieces_of, shingle_hashes, tidy, utf8
from citeloom.llm.graph import components

K = 64
#: Share of a sketch that pairs at the threshold have in common at least, but for about one in 10**6.
MARGIN = 0.25
ALL_PAIRS = 3
CHUNK = 64
BLOCK = 256
COLUMNS = 4_000

def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Distinct shingle hashes of a text in ascending (signed) order."""
    return np.unique(shingle_hashes(Words([text]).hash, n).view(np.int64))


def shingle_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    out = []
    for a, b in pieces_of(texts):
        w = Words(texts[a:b])
        out += [np.unique(shingle_hashes(w.hash[i:j], n).view(np.int64)) for i, j in zip(w.first, w.first[1:])]
    return out


def sketches(docs: DataFrame, n: int, k: int = K) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets, null for empty ones) and the k least hashes."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            sets = shingle_sets(utf8(batch.column("text")), n)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) and i is not None else None for s, i in zip(sets, ids)]
            kept = [s[:k] for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in kept])]).astype(np.int32)
            values = np.concatenate(kept) if kept else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "n_shingles", "set_key", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, set_key binary, sketch array<long>")


def lists(classes: DataFrame, percent: int, k: int) -> DataFrame:
    """(v, rep, n, centrality): the retained values under which each class is listed."""
    loose = percent - round(100 * MARGIN)
    every = classes.select("rep", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("v"))
    often = every.groupBy("v").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").withColumnRenamed("v", "_v")
    shared = every.join(often, F.expr("v = _v")).groupBy("rep").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.sort_array(F.collect_list(F.struct("c", "v"))).alias("found"))
    # a set with all partners' sets inside their sketches needs no margin
    need = F.when(F.col("m") * 100 < percent * k, F.ceil(F.col("m") * percent / 100)).otherwise(F.ceil(F.col("m") * loose / 100))
    take = F.greatest(F.lit(0), F.col("m") - need + 1 - (F.col("m") - F.size("found"))).cast("int")
    central = F.aggregate("found", F.lit(0.0), lambda a, x: a + x["c"]) / F.col("m")
    return shared.select("rep", "n", central.alias("centrality"), F.explode(F.slice("found", F.lit(1), take)).alias("f")).select("f.v", "rep", "n", "centrality")


def candidates(listed: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of fitting sizes, and the families (hub, rep) of the long lists."""
    stats = listed.groupBy("v").agg(F.count(F.lit(1)).alias("len"), F.max(F.struct("centrality", (-F.col("rep")).alias("r"), "n")).alias("h")).filter("len > 1").select(F.col("v").alias("_v"), "len", (-F.col("h.r")).alias("hub"), F.col("h.n").alias("hub_n"))
    joined = listed.join(stats, F.expr("v = _v"))
    short = joined.filter(F.col("len") <= ALL_PAIRS).groupBy("v").agg(F.sort_array(F.collect_list(F.struct("rep", "n"))).alias("x"))
    left = short.select("x", F.posexplode("x").alias("i", "p"))
    pairs = left.select("p", F.explode(F.expr(f"slice(x, i + 2, {ALL_PAIRS})")).alias("q")).select(F.col("p.rep").alias("a"), F.col("p.n").alias("na"), F.col("q.rep").alias("b"), F.col("q.n").alias("nb"))
    long = joined.filter(F.col("len") > ALL_PAIRS).select("hub", "hub_n", "rep", "n").distinct()
    pairs = pairs.unionByName(long.filter("hub <> rep").select(F.col("hub").alias("a"), F.col("hub_n").alias("na"), F.col("rep").alias("b"), F.col("n").alias("nb")))
    fit = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return pairs.filter(fit).select("a", "b").distinct(), long.select("hub", "rep", "n")


def estimated(pairs: DataFrame, classes: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs whose union sketch, the k least of both sketches, shows enough values of both."""
    one = classes.select(F.col("rep").alias("_a"), F.col("sketch").alias("sa"))
    two = classes.select(F.col("rep").alias("_b"), F.col("sketch").alias("sb"))
    both = pairs.join(one, F.expr("a = _a")).join(two, F.expr("b = _b"))
    union = F.expr(f"slice(array_sort(array_union(sa, sb)), 1, {k})")
    loose = percent - round(100 * MARGIN)
    rest = both.withColumn("u", union).withColumn("hits", F.expr("size(filter(array_intersect(sa, sb), x -> x <= element_at(u, -1)))"))
    return rest.filter(F.col("hits") * 100 >= F.size("u") * loose).select("a", "b")


FILTER_BITS = 1 << 28
SLICE = 1 << 16


def _positions(ids: np.ndarray, bits: int) -> np.ndarray:
    h = mix64(ids.astype(np.int64).view(np.uint64))
    return np.stack([h & np.uint64(bits - 1), h >> np.uint64(20) & np.uint64(bits - 1), h >> np.uint64(36) & np.uint64(bits - 1)])


def with_ids(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts whose doc_id is among ids, and a few others, without a shuffle of texts.

    A Bloom filter of the ids is broadcast: twelve bits an id, FILTER_BITS at most (32 MB), beyond
    which more texts pass in vain. Slices of it are put together on the executors.
    """
    n = ids.count()
    bits = min(FILTER_BITS, 1 << max(16, (12 * n).bit_length()))

    def mark(batches):
        field = np.zeros(bits, bool)
        for batch in batches:
            field[_positions(batch.column(0).to_numpy(zero_copy_only=False), bits)] = True
        for i in range(0, bits, 8 * SLICE):
            part = np.packbits(field[i : i + 8 * SLICE])
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["at", "part"])

    def merge(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint8) for x in table.column("part").to_pylist()]
        return pa.table({"at": table.column("at")[:1], "part": pa.array([np.bitwise_or.reduce(parts).tobytes()], pa.binary())})

    rows = ids.coalesce(16).mapInArrow(tidy(mark), "at long, part binary").groupBy("at").applyInArrow(merge, "at long, part binary").collect()
    field = np.zeros(bits // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(r["part"], np.uint8)
        field[r["at"] // 8 : r["at"] // 8 + len(part)] = part

    def keep(batches):
        for batch in batches:
            known = batch.filter(batch.column("doc_id").is_valid())
            at = _positions(known.column("doc_id").to_numpy(zero_copy_only=False), bits).astype(np.int64)
            hit = (field[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=0)
            yield known.filter(pa.array(hit))

    return texts.mapInArrow(tidy(keep), texts.schema)


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        cols = [utf8(batch.column(c)) if c == "text" else batch.column(c).to_pylist() for c in names]
        yield from zip(*cols)


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union of the full sets.

    Texts are dealt by the pair's first side, in chunks: a hub's text goes to each of its chunks once,
    a member's to one; rows stream in order, so a task holds one set at a time.
    """
    chunk = F.pmod(F.xxhash64("b"), F.ceil(F.col("deg") / CHUNK).cast("long"))
    degree = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("deg")).withColumnRenamed("a", "_a")
    dealt = materialize(pairs.join(degree, F.expr("a = _a")).select("a", "b", chunk.alias("chunk")), "pairs")
    hubs = dealt.select("a", "chunk").distinct().select(F.col("a").alias("rep"), "a", "chunk", F.lit(0).alias("role"))
    need = hubs.unionByName(dealt.select(F.col("b").alias("rep"), "a", "chunk", F.lit(1).alias("role")))
    rows = need.join(texts, F.expr("rep = doc_id")).select("a", "chunk", "role", "rep", "text")
    rows = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role")

    def run(batches):
        at, own, found = None, None, []
        for a, c, role, rep, text in _rows(batches, ["a", "chunk", "role", "rep", "text"]):
            s = shingle_set(text, n)
            if not role:
                at, own = (a, c), s
            elif at == (a, c):
                both = len(np.intersect1d(own, s, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(s) - both):
                    found.append((a, rep))
            if len(found) >= 10_000:
                yield _edges(found)
                found = []
        yield _edges(found)

    return rows.mapInArrow(tidy(run), "a long, b long")


def _linked(sets: list[np.ndarray], outside: list[int], percent: int) -> np.ndarray:
    """Rows: the sets listed in `outside`; columns: all sets; true where similar enough."""
    sizes = np.array([len(s) for s in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(at) > 1
    number = np.cumsum(shared) - 1
    keep = shared[at]
    owner, at = owner[keep], number[at[keep]]
    both = np.zeros((len(outside), len(sets)), np.float32)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for c in range(0, int(shared.sum()), COLUMNS):
        i, j = np.searchsorted(at, [c, c + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[owner[i:j], at[i:j] - c] = 1
        both += m[outside] @ m.T
    return 100 * both >= percent * (sizes[outside][:, None] + sizes[None, :] - both)


def split_families(families: DataFrame, labels: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links between members of one family that are in different components, by exact comparison in blocks."""
    label = labels.withColumnRenamed("node", "_n")
    members = materialize(families.join(label, F.expr("rep = _n"), "left").select("hub", "rep", F.coalesce("component", "rep").alias("comp")), "families")
    parts = members.groupBy("hub", "comp").agg(F.count(F.lit(1)).alias("c"))
    split = parts.groupBy("hub").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("comps"), F.max(F.struct("c", "comp")).alias("big")).filter("comps > 1 AND total > 2").select(F.col("hub").alias("_h"), F.ceil(F.col("total") / BLOCK).cast("long").alias("nb"), F.ceil((F.col("total") - F.col("big.c")) / BLOCK).cast("long").alias("no"), F.col("big.comp").alias("main"))
    at = members.join(split, F.expr("hub = _h"))
    own = F.xxhash64("rep")
    every = at.select("hub", "rep", "comp", F.pmod(own, F.col("nb")).alias("bx"), F.explode(F.expr("sequence(0L, no - 1)")).alias("bo"), F.lit(False).alias("outside"))
    out = at.filter("comp <> main").select("hub", "rep", "comp", F.explode(F.expr("sequence(0L, nb - 1)")).alias("bx"), F.pmod(own, F.col("no")).alias("bo"), F.lit(True).alias("outside"))
    rows = every.select("hub", "bo", "bx", "outside", "rep", "comp").unionByName(out.select("hub", "bo", "bx", "outside", "rep", "comp"))
    dealt = rows.join(texts, F.expr("rep = doc_id")).select("hub", "bo", "bx", "outside", "rep", "comp", "text").repartition("hub", "bo", "bx").sortWithinPartitions("hub", "bo", "bx")

    def block(group: list[tuple]) -> list[tuple[int, int]]:
        sets = [shingle_set(t, n) for *_, t in group]
        outside = [i for i, x in enumerate(group) if x[3]]
        if not outside or len(outside) == len(group):
            return []
        inside = [i for i, x in enumerate(group) if not x[3]]
        hit = _linked(sets, outside, percent)
        found = {}
        for i, o in enumerate(outside):
            for j in inside:
                if hit[i, j] and group[j][5] != group[o][5]:  # one link to each other component
                    found.setdefault((group[o][4], group[j][5]), group[j][4])
        return [(o, x) for (o, _), x in found.items()]

    def run(batches):
        key, group = None, []
        for x in _rows(batches, ["hub", "bo", "bx", "outside", "rep", "comp", "text"]):
            if x[:3] != key:
                if group:
                    yield _edges(block(group))
                key, group = x[:3], []
            group.append(x)
        if group:
            yield _edges(block(group))

    return dealt.mapInArrow(tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable by links) for every row of docs."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = materialize(sketches(texts, n, k), "sketches")
    least = sketched.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("x"))
    classes = materialize(least.select("set_key", F.col("x.doc_id").alias("rep"), F.col("x.n_shingles").alias("n"), F.col("x.sketch").alias("sketch")), "classes")
    pairs, families = candidates(materialize(lists(classes, percent, k), "lists"), percent)
    families = materialize(families, "families")
    pairs = materialize(estimated(pairs, classes, percent, k), "estimated")
    involved = materialize(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(families.select(F.col("rep").alias("id"))).distinct(), "involved")
    texts = materialize(with_ids(texts, involved), "texts")
    links = materialize(verified(pairs, texts, n, percent), "links")
    labels = components(links)
    more = materialize(split_families(families, labels, texts, n, percent), "links")
    if not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    of_class = classes.select(F.col("set_key").alias("_key"), "rep").join(labels, F.expr("rep = node"), "left").select("_key", F.coalesce("component", "rep").alias("_component"))
    out = sketched.select("doc_id", "n_shingles", "set_key").join(of_class, F.expr("set_key = _key"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("_component", "doc_id").alias("component_id"))


def query(docs: DataFrame) -> DataFrame:
    """Four-word shingles, links from 80 percent on; kept: the least id of each component."""
    out = near_duplicates(docs, n=4, percent=80)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def kept_documents(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near duplicates, the one with the least id."""
    gone = near_duplicates(docs, n, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.expr("doc_id = _gone"), "left_anti")
