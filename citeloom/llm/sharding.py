"""Operator 5: sharding by k-d tree partitioning, in DataFrame functions only.

Every document is a point of metadata coordinates (source, language, length, id), each scaled to 31
bits. A node is split along its widest coordinate at the median weighted by bytes, until as many
leaves stand as there are shards, or leaves reach the target bytes. Medians are distributed: the sums
of at most 4096 equal cells of each node's range are gathered, then those of the one cell that holds
the median, until that cell holds next to nothing. What reaches the driver is bounded by
nodes * 4096 rows. Ties of a coordinate, such as one source with a third of all rows, are split by the
hash of the id below it.

Defined results: a null text weighs 1 byte and has the checksum of an empty one; null source, language
or id stand at the lower end of their coordinate; an empty table gives no rows; rows equal in all
coordinates and id fall into one shard; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import materialize, ranked

CELLS = 4096
DIMENSIONS = ("source", "lang", "size", "doc_id")
TOP = (1 << 31) - 1


def points(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the coordinates x0.. as 62-bit keys: 31 of the coordinate, 31 of the id's hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.shiftright(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), 1).alias("_source"), F.shiftright(F.crc32(F.coalesce("lang", F.lit("")).cast("binary")), 1).alias("_lang"))
    base = materialize(base, "meta")
    ends = base.agg(F.min(F.log2("size")), F.max(F.log2("size")), F.min(F.col("doc_id").cast("double")), F.max(F.col("doc_id").cast("double"))).collect()[0]
    ends = [0.0 if x is None else x for x in ends]

    def scaled(x: Column, lo: float, hi: float) -> Column:
        return F.coalesce(F.floor((x - F.lit(lo)) / F.lit((hi - lo) or 1.0) * F.lit(float(TOP))).cast("long"), F.lit(0).cast("long"))

    low = F.shiftright(F.xxhash64("doc_id"), 33).bitwiseAND(F.lit(TOP))
    coords = [F.col("_source"), F.col("_lang"), scaled(F.log2("size"), ends[0], ends[1]), scaled(F.col("doc_id").cast("double"), ends[2], ends[3])]
    return materialize(base.select("doc_id", "size", "text_crc32", *[F.shiftleft(c, 31).bitwiseOR(low).alias(f"x{i}") for i, c in enumerate(coords)]), "points")


def _table(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    """A constant table of a few integers for each open node, to be broadcast: its size is bounded by the shards."""
    values = ", ".join("(" + ", ".join(f"{v}L" for v in r) + ")" for r in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS t({names})"))


KEY = "CASE d " + " ".join(f"WHEN {i} THEN x{i}" for i in range(len(DIMENSIONS))) + " END"


def weighted_medians(nodes: DataFrame, along: dict[int, int], ends: dict[int, tuple[int, int]], mass: dict[int, int]) -> dict[int, int]:
    """For each node the largest key of its lower half, by bytes."""
    at = {n: (lo, hi, 0) for n, (lo, hi) in ends.items()}  # range of keys, bytes below it
    found: dict[int, int] = {}
    while at:
        ranges = _table(nodes.sparkSession, "_node, d, lo, hi, width", [(n, along[n], lo, hi, (hi - lo) // CELLS + 1) for n, (lo, hi, _) in at.items()])
        keyed = nodes.join(ranges, F.expr("node = _node")).withColumn("k", F.expr(KEY)).filter("k BETWEEN lo AND hi")
        sums = keyed.groupBy("node", F.expr("(k - lo) div width").alias("cell")).agg(F.sum("size").alias("bytes")).collect()
        after = {}
        for n, (lo, hi, below) in at.items():
            width, half = (hi - lo) // CELLS + 1, mass[n] / 2
            for r in sorted((r for r in sums if r["node"] == n), key=lambda r: r["cell"]):
                if below + r["bytes"] >= half:
                    a, b = lo + r["cell"] * width, min(hi, lo + (r["cell"] + 1) * width - 1)
                    if width == 1 or r["bytes"] * 8192 <= mass[n]:
                        found[n] = b if below + r["bytes"] - half <= half - below else a - 1
                    else:
                        after[n] = (a, b, below)
                    break
                below += r["bytes"]
        at = after
    return found


def tree(pts: DataFrame, shards: int | None = 16, target_bytes: int | None = None) -> DataFrame:
    """pts with `shard`: the leaves in order, `shards` (a power of two) of them or as many as reach target_bytes."""
    spark = pts.sparkSession
    nodes = pts.withColumn("node", F.lit(1).cast("long"))
    leaves: list[int] = []
    fresh = [1]
    while fresh:
        stats = nodes.join(_table(spark, "_node", [(n,) for n in fresh]), F.expr("node = _node")).groupBy("node").agg(F.sum("size").alias("bytes"), *[f(f"x{i}").alias(f"{k}{i}") for i in range(len(DIMENSIONS)) for k, f in (("lo", F.min), ("hi", F.max))]).collect()
        along, ends, mass = {}, {}, {}
        for r in stats:
            n = r["node"]
            done = n >= shards if shards else r["bytes"] <= target_bytes
            spans = [(r[f"hi{i}"] >> 31) - (r[f"lo{i}"] >> 31) for i in range(len(DIMENSIONS))]
            d = max(range(len(spans)), key=lambda i: (spans[i], -i))
            if done or r[f"hi{d}"] == r[f"lo{d}"]:
                leaves.append(n)
            else:
                along[n], ends[n], mass[n] = d, (r[f"lo{d}"], r[f"hi{d}"]), r["bytes"]
        if not along:
            break
        split = weighted_medians(nodes, along, ends, mass)
        cuts = _table(spark, "_node, d, cut", [(n, along[n], k) for n, k in split.items()])
        nodes = nodes.join(cuts, F.expr("node = _node"), "left").withColumn("node", F.expr(f"CASE WHEN cut IS NULL THEN node WHEN {KEY} > cut THEN node * 2 + 1 ELSE node * 2 END")).select(*pts.columns, "node")
        nodes = materialize(nodes, "nodes")
        fresh = [2 * n + i for n in split for i in (0, 1)]
    # leaves in tree order: compare paths as binary fractions
    order = sorted(leaves, key=lambda n: n / (1 << n.bit_length() - 1))
    if not order:
        return pts.withColumn("shard", F.lit(0))
    named = _table(spark, "_node, _shard", [(n, i) for i, n in enumerate(order)])
    return nodes.join(named, F.expr("node = _node")).select(*pts.columns, F.col("_shard").cast("int").alias("shard"))


def shard(docs: DataFrame, shards: int | None = 16, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document; slots of a shard have no gap from 0."""
    pts = points(docs)
    placed = tree(pts, shards, target_bytes).select("doc_id", "size", "text_crc32", "shard")
    return ranked(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot", pts.count())


def query(docs: DataFrame) -> DataFrame:
    out = shard(docs, 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
