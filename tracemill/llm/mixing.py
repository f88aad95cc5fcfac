"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words (weights, total and cap below). Its documents stand in one order (by size, ties
broken by salt and id); the prefix sum of their expected copies, begun at one random offset of the source, crosses integers, and
a document is taken once for each integer it crosses. All documents of a source expect target / source size copies, so the
prefix sum is that rate times the rank. Ranks come from counts of nested buckets, so no task ever holds a whole source. In order of
size the words taken miss a target by less than the source's largest document has, and usually by far less.

Null text: size 0, so it brings no words. Null source: a source of its own, last in order. Null ids come first among equals, and repeated
rows are separate documents. A source without words has target 0. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5  # of all words, for the whole mix
CAP = 2.0  # largest target, as a multiple of the source's size
WORD, SPACE, BLANK = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]", " \t\n\x0b\x0c\r"


def size_of(text: Column) -> Column:
    """Words of a text: each, with the white space after it, becomes one letter."""
    return F.coalesce(F.length(F.regexp_replace(F.ltrim(text, F.lit(BLANK)), rf"{WORD}{SPACE}*+", "x")), F.lit(0)).cast("long")


def _before(name: str, w) -> Column:
    return F.coalesce(F.sum(name).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes has a row per source: source, source_size. Adds target.

    A target is the source's weight times a level common to all sources, but at most its cap: this is where resharing the
    excess by weight ends. Prefix sums over the sources in order of cap / weight give the level. Only this table, of one row a
    source, is ever sorted in one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    s = sizes.withColumn("_w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(cap))).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    s = s.withColumn("_n", F.row_number().over(order))
    s = s.withColumn("_level", (F.sum("source_size").over(every) * F.lit(float(share)) - _before("_cap", order)) / (F.sum("_w").over(every) - _before("_w", order)))
    s = s.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_n", "_level"))).over(every)["_level"])
    return s.withColumn("target", F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")))).drop("_w", "_cap", "_ratio", "_n", "_level")


BUCKET = ["_k", "_b1", "_b2", "_b3"]


def _bucketed(docs: DataFrame, carry: list[Column]) -> DataFrame:
    """A row per row of docs: _k (the source's key), doc_id, source, size, _t (hash of the text), buckets, and carry.

    Buckets: bit length of the size, its first five bits, and a salt of id and text."""
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    text = F.coalesce("text", F.lit(""))
    salt = F.pmod(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(1000003)) * 7919, F.lit(16)) * 16 + F.conv(F.substring(F.md5(text.cast("binary")), 1, 1), 16, 10).cast("long")
    x = docs.select(*carry, key.alias("_k"), F.col("doc_id"), F.col("source"), size_of(F.col("text")).alias("size"), F.xxhash64(text).alias("_t"), salt.alias("_b3"))
    bits = F.length(F.bin("size"))
    return x.withColumn("_b1", bits).withColumn("_b2", F.floor(F.col("size") / F.pow(F.lit(2.0), F.greatest(bits - 5, F.lit(0)))))


def _plan(counted: DataFrame, weights, share: float, cap: float) -> DataFrame:
    """A row per bucket: where its ranks begin in its source, and the source's size, target, rate and random offset. Prefix sums run over
    at most 64, 32 and 256 counts."""
    c3 = counted.groupBy(*BUCKET).agg(F.count("*").alias("_c3"))
    c2 = c3.groupBy(*BUCKET[:3]).agg(F.sum("_c3").alias("_c2"))
    c1 = c2.groupBy(*BUCKET[:2]).agg(F.sum("_c2").alias("_c1"))
    c1 = c1.select("_k", "_b1", _before("_c1", Window.partitionBy("_k").orderBy("_b1")).alias("_o1"))
    c2 = c2.select(*BUCKET[:3], _before("_c2", Window.partitionBy(*BUCKET[:2]).orderBy("_b2")).alias("_o2"))
    c3 = c3.select(*BUCKET, _before("_c3", Window.partitionBy(*BUCKET[:3]).orderBy("_b3")).alias("_o3"))
    goals = targets(counted.groupBy("_k", "source").agg(F.sum("size").alias("source_size")), weights, share, cap).drop("source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = goals.withColumn("_rate", rate).withColumn("_u", F.conv(F.substring(F.md5("_k"), 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20)))
    offsets = c3.join(c2.join(c1, BUCKET[:2]), BUCKET[:3]).select(*BUCKET, (F.col("_o1") + F.col("_o2") + F.col("_o3")).alias("_offset"))
    return offsets.join(goals, "_k")


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (_bucketed) with source_size, target and copies. Rows are numbered within the smallest bucket; wide rows move once."""
    own = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*BUCKET).orderBy("size", "doc_id", "_t"))).join(plan, BUCKET)
    at = lambda rank: F.floor(F.col("_u") + F.col("_rate") * rank)
    rank = F.col("_rank") + F.col("_offset")
    return own.withColumn("copies", at(rank) - at(rank - 1))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """docs: doc_id, source, text. Returns doc_id, source, size, source_size, target, copies and taken; one row per row of docs."""
    rows = stored(_bucketed(docs, []))
    return _taken(rows, _plan(rows, weights, share, cap)).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the mix takes, each as often as it is taken (rows repeat), with docs' columns, whatever these
    are called. Each row is a document of its own, of null or repeated id too; null texts have no words but take their turn."""
    counted = stored(_bucketed(docs, []))
    rows = _taken(_bucketed(docs, [F.struct(*[docs[c] for c in docs.columns]).alias("_row")]), _plan(counted, WEIGHTS, SHARE, CAP)).where("copies > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*[F.col("_row")[c].alias(c) for c in docs.columns])


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END k, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT size, ('0x' || substr(md5(coalesce(text, '')), 1, 1))::BIGINT h FROM documents),
b AS (SELECT *, length(bin(size)) b1, ((doc_id % 1000003) * 7919) % 16 * 16 + h b3 FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY b1, floor(size / pow(2.0, greatest(b1 - 5, 0))), b3, size, doc_id) rank FROM b),
s AS (SELECT k, source, sum(size)::BIGINT source_size FROM d GROUP BY k, source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END w, source_size * 2.0::DOUBLE cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) n,
  (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) lv FROM w),
l AS (SELECT arg_min(lv, n) FILTER (lv <= cap / w) lv FROM o),
g AS (SELECT o.k, source, source_size, least(cap, coalesce(l.lv * w, cap)) target, ('0x' || substr(md5(k), 1, 5))::BIGINT / 1048576.0::DOUBLE u FROM o, l),
q AS (SELECT r.doc_id, r.size, r.rank, g.*, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END rate FROM r JOIN g ON r.k = g.k),
x AS (SELECT *, (floor(u + rate * rank) - floor(u + rate * (rank - 1)))::BIGINT n FROM q)
SELECT doc_id, source, size, source_size, target, n AS copies, size * n AS taken FROM x
"""
