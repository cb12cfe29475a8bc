"""Operator 8: mixing sources to target weights by pivotal dependent rounding, in SQL functions only.

Each source gets a target (by weight, capped at `cap` times its size, the excess shared again), so
each of its documents a fractional number of copies. The whole part is taken; the fractions are paired
within blocks of documents, largest first, and mass is moved between two of them, at random and
without bias, until one is integral. The move keeps the sum of fraction times size, so words are
balanced, not just documents. The fraction left in each block goes on to the next level of a reduction
tree until every source has at most one, which is rounded at random.

Randomness is a hash of ids, so reruns agree.

Defined results: a null source is a source of its own, the last one; a null text has size 0; a very long
text weighs its words like any other; rows equal in id, source and size share one decision and are
weighed together; ties of size are ordered by id; documents of size 0 take no words and are left out of
the mix; an empty table gives no rows. Extra columns are kept by `mix`, and none of its own clash with
them but for names that begin with an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import WORD, materialize

CAP = 3
BLOCK = 256
TREE = 64
_SCALE = float(1 << 53)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cap: int = CAP, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size -> with weight and target; one row for each source.

    Target = min(cap * size, level * weight) at the level where all targets add up to all sizes: with
    sources ordered by cap * size / weight, those up to some place are at their cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    index = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (index + 1).cast("int")))
    full = F.col("source_size") * F.lit(cap)
    by_level = Window.orderBy((full / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(full).over(before), F.lit(0))) / F.sum("weight").over(after)
    leveled = weighted.withColumn("_level", level).withColumn("_at", F.row_number().over(by_level))
    first = F.min(F.when(F.col("_level") * F.col("weight") <= full, F.struct("_at", "_level"))).over(every)
    return leveled.withColumn("_open", first).select("source", "source_size", "weight", F.least(full.cast("double"), F.coalesce(F.col("_open._level") * F.col("weight"), full)).cast("double").alias("target"))


def _fold(items: str, salt: int) -> Column:
    """Pivotal rounding of an array of struct(id, size, p), in its order: struct(carry, done)."""
    u = f"(pmod(xxhash64(a.carry.id, x.id, a.carry.size, x.size, {salt}L), {1 << 53}L) / {_SCALE}D)"
    # mass p * size: `give` is what x can take from the carry, `take` the reverse
    step = f"""
      aggregate({items}, named_struct('carry', cast(null as struct<id:string,size:bigint,p:double>), 'done', cast(array() as array<struct<id:string,size:bigint,p:double>>)),
        (a, x) -> CASE
          WHEN x.p <= 1e-9D OR x.p >= 1D - 1e-9D THEN named_struct('carry', a.carry, 'done', array_append(a.done, named_struct('id', x.id, 'size', x.size, 'p', round(x.p))))
          WHEN a.carry IS NULL THEN named_struct('carry', x, 'done', a.done)
          ELSE transform(array(named_struct(
              'give', least(a.carry.p * a.carry.size, (1D - x.p) * x.size),
              'take', least((1D - a.carry.p) * a.carry.size, x.p * x.size))),
            m -> transform(array(CASE WHEN {u} * (m.give + m.take) < m.take THEN -m.give ELSE m.take END),
              d -> transform(array(named_struct(
                  'c', named_struct('id', a.carry.id, 'size', a.carry.size, 'p', a.carry.p + d / a.carry.size),
                  'x', named_struct('id', x.id, 'size', x.size, 'p', x.p - d / x.size))),
                s -> CASE
                  WHEN s.x.p <= 1e-9D OR s.x.p >= 1D - 1e-9D THEN
                    CASE WHEN s.c.p <= 1e-9D OR s.c.p >= 1D - 1e-9D
                      THEN named_struct('carry', cast(null as struct<id:string,size:bigint,p:double>), 'done', concat(a.done, array(named_struct('id', s.x.id, 'size', s.x.size, 'p', round(s.x.p)), named_struct('id', s.c.id, 'size', s.c.size, 'p', round(s.c.p)))))
                      ELSE named_struct('carry', s.c, 'done', array_append(a.done, named_struct('id', s.x.id, 'size', s.x.size, 'p', round(s.x.p)))) END
                  ELSE named_struct('carry', s.x, 'done', array_append(a.done, named_struct('id', s.c.id, 'size', s.c.size, 'p', round(s.c.p)))) END)[0])[0])[0]
        END)"""
    return F.expr(step)


def _blocks(units: DataFrame) -> DataFrame:
    items = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("o"), "id", "size", "p")))
    return units.groupBy("source", "block").agg(F.transform(items, lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"), x["p"].alias("p"))).alias("items"))


def size_ordered(units: DataFrame) -> DataFrame:
    """units with `block`: blocks of about BLOCK units of a source, the largest documents in the first.

    Counts by size class (1/16 of an octave, so a few hundred a source at most) tell where a class begins;
    within it the id's hash deals units to its blocks.
    """
    band = F.floor(F.log2("size") * -16).cast("int")
    banded = units.withColumn("_band", band)
    counts = banded.groupBy("source", "_band").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("source").alias("_s"), F.col("_band").alias("_b"), "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    placed = banded.join(starts, F.expr("source <=> _s AND _band = _b"))
    return placed.withColumn("block", F.floor((F.col("_from") + F.pmod(F.xxhash64("id"), F.col("_n"))) / BLOCK).cast("long")).select(*units.columns, "block")


def round_copies(units: DataFrame) -> DataFrame:
    """units (source, id string, size > 0, p in [0, 1)) -> (source, id, size, p in {0, 1}).

    Blocks are folded largest document first, and so are the carries of each further level. A move
    settles the document that has less to give, so large fractions meet their like early and what is
    left of a source in the end is mostly a small document. That one is rounded at random.
    """
    level, done = 0, []
    units = size_ordered(units)
    while True:
        folded = materialize(_blocks(units).withColumn("f", _fold("items", level)).select("source", "block", "f.carry", "f.done"), "rounding")
        done.append(folded.select("source", F.explode("done").alias("r")).select("source", "r.*"))
        most = folded.agg(F.max("block").alias("m")).collect()[0]["m"]
        carried = folded.filter("carry IS NOT NULL").select("source", F.col("carry.id").alias("id"), F.col("carry.size").alias("size"), F.col("carry.p").alias("p"), F.floor(F.col("block") / TREE).cast("long").alias("block"))
        if not most:  # one block for each source
            break
        units, level = carried, level + 1
    u = F.pmod(F.xxhash64("id", "size", F.lit(-1)), F.lit(1 << 53)) / F.lit(_SCALE)
    out = carried.select("source", "id", "size", F.when(u < F.col("p"), 1.0).otherwise(0.0).alias("p"))
    for d in done:
        out = out.unionByName(d)
    return out


def copies(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """A row for each (doc_id, source, size): how many rows have it, its source's size and target, and copies."""
    sized = materialize(docs.select("doc_id", "source", words(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n_rows")), "sizes")
    sizes = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"))
    plan = materialize(targets(sizes, cap).withColumnRenamed("source", "_s"), "targets")
    each = sized.join(plan, F.expr("source <=> _s"), "left").drop("_s")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    each = each.withColumn("_share", share).withColumn("_whole", F.floor(F.col("_share") + 1e-12))
    ident = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string"))
    units = each.filter("size > 0").select("source", ident.alias("id"), (F.col("size") * F.col("n_rows")).alias("size"), F.greatest(F.lit(0.0), F.col("_share") - F.col("_whole")).alias("p"))
    rounded = round_copies(units).select(F.col("source").alias("_source"), F.col("id").alias("_id"), F.col("p").cast("long").alias("_up"))
    decided = each.withColumn("_ident", ident).join(rounded, F.expr("source <=> _source AND _ident = _id"), "left")
    number = F.when(F.col("size") > 0, F.col("_whole") + F.coalesce(F.col("_up"), F.lit(0))).otherwise(F.lit(0)).cast("long")
    return decided.select("doc_id", "source", "size", "n_rows", F.col("source_size").cast("long").alias("source_size"), "target", number.alias("copies"))


def query(docs: DataFrame) -> DataFrame:
    """The digest of every document: sizes, its source's target and the words that the mix takes."""
    got = copies(docs)
    rows = got.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "copies")


def mix(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """The mixed corpus: documents as often as they are taken, in the columns of docs."""
    got = copies(docs, cap).filter("copies > 0").select(F.col("doc_id").alias("_d"), F.col("source").alias("_src"), F.col("size").alias("_n"), "copies")
    sized = docs.withColumn("_size", words(F.col("text")))
    joined = sized.join(got, F.expr("doc_id <=> _d AND source <=> _src AND _size = _n"))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns)
