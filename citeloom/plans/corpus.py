"""A deterministic projection of order lines into briefs, opinions and citation edges.

The driver's tables hold no citations; this makes some out of integers and text, with expressions
that Spark and DuckDB both understand, so that the same input exists in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER_KEY = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
_K = ", ".join(ORDER_KEY)

#: Reporter of authority s.
REP = "CASE s % 4 WHEN 0 THEN 'U.S.' WHEN 1 THEN 'F.3d' WHEN 2 THEN 'F. Supp. 2d' ELSE 'S. Ct.' END"

#: Text of a mention by its kind h.
CITE = f"""CASE
  WHEN h < 4 THEN concat('Supplier', s, ' v. Nation', s % 25, ', ', 100 + s, ' ', {REP}, ' ', 10 + 7 * s, ', ', pin, ' (', 1950 + s % 70, ')')
  WHEN h = 4 THEN concat(100 + s, ' ', {REP}, ' at ', pin)
  WHEN h = 5 THEN concat('Supplier', s, ', ', 100 + s, ' ', {REP}, ' at ', pin)
  WHEN h IN (6, 7) THEN concat('Id. at ', pin)
  WHEN h = 8 THEN concat('Supplier', s, ', supra, at ', pin)
  WHEN h = 9 THEN concat(1 + s % 54, ' U.S.C. § ', 100 + k % 900, '(c)(2)')
  WHEN h = 10 THEN concat(1 + s % 50, ' C.F.R. § ', 100 + k % 900, '.', s % 90)
  ELSE concat('R. at ', 1 + k % 500) END"""

SIGNAL = "CASE k % 5 WHEN 1 THEN 'See ' WHEN 2 THEN 'Cf. ' WHEN 3 THEN 'But see ' WHEN 4 THEN 'See generally ' ELSE '' END"
COURT = "CASE brief_id % 4 WHEN 0 THEN 'SCOTUS' WHEN 1 THEN 'D.C. Circuit' WHEN 2 THEN '9th Circuit' ELSE 'Other' END"
PAGE = "CAST(1 + FLOOR((ord - 1) / 2.0) AS INT)"

#: Variants: base, linked (short forms take up the brief's first case), dense (200 briefs, 10 authorities).
VARIANTS = {
    "base": ("l_orderkey", "l_suppkey", _K),
    "linked": ("l_orderkey", "l_suppkey", _K),
    "dense": ("l_orderkey % 200", "l_suppkey % 10", f"l_orderkey, {_K}"),
    "dense_linked": ("l_orderkey % 200", "l_suppkey % 10", f"l_orderkey, {_K}"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mentions(spark: SparkSession, sf_dir: str, variant: str = "base") -> DataFrame:
    """brief_id, ord, page, h, s, k, pin, cite_text of every order line."""
    brief, skey, order = VARIANTS[variant]
    lines = table(spark, sf_dir, "lineitem").select(F.expr(brief).alias("brief_id"), F.expr(skey).alias("s0"), F.col("l_partkey").alias("k"), F.expr("l_partkey % 12").alias("h"), *{"l_orderkey", *ORDER_KEY})
    by_order = Window.partitionBy("brief_id").orderBy(*[c.strip() for c in order.split(",")])
    numbered = lines.withColumn("ord", F.row_number().over(by_order))
    s = F.col("s0")
    if variant.endswith("linked"):
        first = F.first(F.when(F.col("h") < 4, F.col("s0")), ignorenulls=True).over(by_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        s = F.when(F.col("h").isin(4, 5, 8), F.coalesce(first, s)).otherwise(s)
    out = numbered.withColumn("s", s).withColumn("pin", F.expr("10 + 7 * s + l_linenumber")).withColumn("page", F.expr(PAGE))
    return out.withColumn("cite_text", F.expr(CITE)).select("brief_id", "ord", "page", "h", "s", "k", "pin", "cite_text")


def mentions_sql(variant: str = "base") -> str:
    """The same as DuckDB SQL, to stand in parentheses."""
    brief, skey, order = VARIANTS[variant]
    base = f"SELECT {brief} AS brief_id, {skey} AS s0, l_partkey AS k, l_partkey % 12 AS h, l_linenumber, row_number() OVER (PARTITION BY {brief} ORDER BY {order}) AS ord FROM lineitem"
    if variant.endswith("linked"):
        first = "SELECT brief_id AS fb, arg_min(s0, ord) AS fs FROM b WHERE h < 4 GROUP BY brief_id"
        s = f"WITH b AS ({base}), f AS ({first}) SELECT b.*, CASE WHEN h IN (4, 5, 8) THEN coalesce(fs, s0) ELSE s0 END AS s FROM b LEFT JOIN f ON brief_id = fb"
    else:
        s = f"SELECT *, s0 AS s FROM ({base})"
    return f"SELECT *, {CITE} AS cite_text FROM (SELECT brief_id, ord, {PAGE} AS page, h, s, k, 10 + 7 * s + l_linenumber AS pin FROM ({s}))"


HEAD = "TABLE OF CONTENTS\nDecoy v. Front, 1 U.S. 2, 3 (1900)\nARGUMENT\n"
TAIL = "\nCONCLUSION\nWe ask for relief.\nCERTIFICATE OF SERVICE\nDecoy v. Back, 4 U.S. 5, 6 (1901)\n"
#: What a mention adds to its brief before its citation.
LEAD = f"concat(CASE WHEN ord % 2 = 1 THEN concat(CASE WHEN ord = 1 THEN '' ELSE chr(10) END, '## PAGE ', page, chr(10)) ELSE '' END, 'Point ', ord, ' holds. ', {SIGNAL})"


def briefs(spark: SparkSession, sf_dir: str, variant: str = "base", framed: bool = False) -> DataFrame:
    """brief_id, court, text: the mentions of a brief in order, on pages of two, between decoys if framed."""
    m = mentions(spark, sf_dir, variant).withColumn("seg", F.concat(F.expr(LEAD), F.col("cite_text"), F.lit(". ")))
    body = m.groupBy("brief_id").agg(F.sort_array(F.collect_list(F.struct("ord", "seg"))).alias("x"))
    text = F.array_join(F.transform("x", lambda y: y["seg"]), "")
    if framed:
        text = F.concat(F.lit(HEAD), text, F.lit(TAIL))
    return body.select("brief_id", F.expr(COURT).alias("court"), text.alias("text"))


def briefs_sql(variant: str = "base") -> str:
    """brief_id, court, text, and per mention the place of its citation: SQL of a table `placed`."""
    return f"SELECT *, lead_end AS span_start, lead_end + length(cite_text) AS span_end FROM (SELECT *, before + length(lead) AS lead_end FROM (SELECT *, coalesce(sum(length(lead) + length(cite_text) + 2) OVER (PARTITION BY brief_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT *, {LEAD} AS lead FROM ({mentions_sql(variant)}))))"


# ---- opinions


#: What opinion src cites by a line of supplier s and part k: an older opinion, of about an eighth of its number, at times a
#: newer one, which may not exist; and pairs of opinions that cite nothing but each other.
DST = "CASE src % 97 WHEN 0 THEN src + 1 WHEN 1 THEN src - 1 ELSE CASE WHEN k % 41 = 0 THEN 8 * src + s % 8 ELSE (7 * s + k) % (1 + CAST(FLOOR(src / 8.0) AS BIGINT)) END END"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, ord, dst, no_link: every order is an opinion and each of its lines a citation."""
    by_src = Window.partitionBy("l_orderkey").orderBy(*ORDER_KEY)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *ORDER_KEY).withColumn("ord", F.row_number().over(by_src))
    named = lines.select(F.col("l_orderkey").alias("src"), "ord", F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("k"))
    return named.select("src", "ord", F.expr(DST).alias("dst"), F.expr("k % 12 >= 9").alias("no_link"))


def edges_sql() -> str:
    return f"SELECT src, ord, {DST} AS dst, k % 12 >= 9 AS no_link FROM (SELECT l_orderkey AS src, l_suppkey AS s, l_partkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_K}) AS ord FROM lineitem)"


_SEGMENT = """CASE WHEN no_link
  THEN concat('Point ', ord, '. <span class="citation no-link">', 1 + dst, ' U.S.C. 5</span> ')
  ELSE concat('*', 100 + ord, ' Point ', ord, ' holds. <span class="citation" data-id="', 9000 + dst, '"><a href="/opinion/', dst, '/op/#', 10 + ord, '">Op ', dst, '</a></span> ') END"""


def opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """opinion_id, type, html_with_citations, plain_text, html."""
    seg = edges(spark, sf_dir).withColumn("seg", F.expr(_SEGMENT))
    body = seg.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("ord", "seg"))).alias("x"))
    return body.select(F.col("src").alias("opinion_id"), F.lit("020lead").alias("type"), F.array_join(F.transform("x", lambda y: y["seg"]), "").alias("html_with_citations"), F.lit("").alias("plain_text"), F.lit("").alias("html"))


def opinions_sql() -> str:
    return f"SELECT src AS opinion_id, '020lead' AS type, string_agg(seg, '' ORDER BY ord) AS html_with_citations FROM (SELECT *, {_SEGMENT} AS seg FROM ({edges_sql()})) GROUP BY src"


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster_id, volume, reporter, page, case_name, sub_opinions; cluster ids are no opinion ids."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"))
    return s.select((F.col("s") + 500000).alias("cluster_id"), (F.col("s") + 100).alias("volume"), F.expr(REP).alias("reporter"), (F.col("s") * 7 + 10).alias("page"), F.expr("concat('Supplier', s, ' v. Nation', s % 25)").alias("case_name"), F.array(F.col("s"), F.col("s") + 1).alias("sub_opinions"))


def clusters_sql() -> str:
    return f"SELECT 500000 + s AS cluster_id, 100 + s AS volume, {REP} AS reporter, 10 + 7 * s AS page, concat('Supplier', s, ' v. Nation', s % 25) AS case_name, [s, s + 1] AS sub_opinions FROM (SELECT s_suppkey AS s FROM supplier)"
