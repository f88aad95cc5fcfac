"""Line dedup: how many distinct sites a line occurs on decides whether it is boilerplate.

A site is a value of `source` (null counts as one site), compared by a 64-bit hash. HyperLogLog sketches of sites are kept per line
hash and merged by aggregation; lines whose estimate lies near the threshold get an exact distinct count. A line on min_sites or
more sites is removed wherever it stands, but for the rows of the smallest id that has it, however short it is. Blank lines are
no lines and stay.

Null text stays null; an empty text stays empty; an empty table gives no rows. Within a row all occurrences are treated alike. Rows
of null id count, and lose boilerplate that a row with an id has; a line that only they have stays. Rows of equal id are cleaned each
by its own text; equal rows alike. Texts are split once, into a stored table of line hashes. Native functions only: keys of boilerplate
lines are broadcast if they are few (counted), else both sides of the join are salted, so copies of a hot line spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored, table

MIN_SITES = 4
LG_K = 9  # registers of a sketch: 2^LG_K
NEAR = 0.25  # estimates within this share of the threshold are counted exactly; above five standard errors at LG_K
SALTS = 16
FEW = 1 << 16  # keys of lines that are broadcast, at most (about 3 MB)
BLANK = " \t\n\x0b\x0c\r"
KEY = ["_h1", "_h2"]


def lines(docs: DataFrame, site_col: str) -> DataFrame:
    """_id, _text (hash), _site (hash), _pos, _h1, _h2: each line that isn't blank, by two 64-bit hashes of its trimmed text."""
    site = F.xxhash64(F.coalesce(F.concat(F.lit("s"), F.col(site_col)), F.lit("n")))
    x = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), site.alias("_site"), F.posexplode(F.split("text", "\n")).alias("_pos", "_line"))
    x = x.withColumn("_line", F.btrim("_line", F.lit(BLANK))).where("_line <> ''")
    return x.select("_id", "_text", "_site", "_pos", F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit(7), "_line").alias("_h2"))


def _matched(rows: DataFrame, keys: DataFrame, how: str, few: int) -> DataFrame:
    """rows joined by KEY with keys, a stored table."""
    if keys.count() <= few:
        return rows.join(F.broadcast(keys), KEY, how)
    salted = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_id", "_text", "_pos"), F.lit(SALTS))).join(salted, [*KEY, "_salt"], how).drop("_salt")


def boilerplate(own: DataFrame, min_sites: int = MIN_SITES, few: int = FEW) -> DataFrame:
    """own: a stored table of lines(). _h1, _h2, _first: the lines on min_sites or more sites, and the smallest id that has each."""
    sketch = own.groupBy(*KEY).agg(F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(LG_K))).alias("_sites"), F.min("_id").alias("_first"))
    found = stored(sketch.where(F.col("_sites") >= min_sites * (1 - NEAR)))
    sure = found.where(F.col("_sites") > min_sites * (1 + NEAR)).drop("_sites")
    near = stored(found.where(F.col("_sites") <= min_sites * (1 + NEAR)).drop("_sites"))
    exact = _matched(own, near, "inner", few).select(*KEY, "_first", "_site").distinct().groupBy(*KEY, "_first").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_sites)
    out = stored(sure.unionByName(exact.drop("_n")))
    discard(found, near)
    return out


def removed(docs: DataFrame, site_col: str = "source", min_sites: int = MIN_SITES, few: int = FEW) -> DataFrame:
    """_id, _text (hash of the row's text), _n (lines to remove), _flags (whether to, by position; shorter where the rest stays)."""
    own = stored(lines(docs, site_col))
    keys = boilerplate(own, min_sites, few)
    gone = _matched(own, keys, "inner", few).where("_first IS NOT NULL AND (_id IS NULL OR _id > _first)").groupBy("_id", "_text").agg(F.array_sort(F.collect_set("_pos")).alias("_p"))
    ones = F.transform("_p", lambda x, i: F.concat(F.repeat(F.lit("0"), x - F.coalesce(F.get("_p", i - 1), F.lit(-1)) - 1), F.lit("1")))
    out = stored(gone.select("_id", "_text", F.size("_p").cast("long").alias("_n"), F.transform(F.split(F.array_join(ones, ""), ""), lambda c: c == "1").alias("_flags")))
    discard(own, keys)
    return out


def _cleaned(docs: DataFrame, site_col: str, min_sites: int, few: int) -> tuple[list[Column], Column, DataFrame]:
    gone = removed(docs, site_col, min_sites, few)
    out = docs.join(gone.hint("merge"), docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_text"]), "left")
    kept = F.array_join(F.filter(F.split(docs["text"], "\n"), lambda x, i: ~F.coalesce(F.get(gone["_flags"], i), F.lit(False))), "\n")
    text = F.when(gone["_n"].isNull(), docs["text"]).otherwise(kept).alias("text")
    return [text if c == "text" else docs[c] for c in docs.columns], F.coalesce(gone["_n"], F.lit(0)), out


def dedup_lines(docs: DataFrame, site_col: str = "source", min_sites: int = MIN_SITES, few: int = FEW) -> DataFrame:
    """docs with its text cleaned, and n_removed: lines taken out of it (with underscores before its name if docs has such a column).
    docs: doc_id, text and the site column, at least."""
    own, n, out = _cleaned(docs, site_col, min_sites, few)
    name = "n_removed"
    while name in docs.columns:
        name = "_" + name
    return out.select(*own, n.alias(name))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "n_removed", F.length("text").cast("long").alias("n_kept_chars"), F.md5("text").alias("text_md5"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: docs with boilerplate lines gone; every document stays, with its columns, whatever these are called."""
    own, _, out = _cleaned(docs, "source", MIN_SITES, FEW)
    return out.select(*own)


ORACLE = rf"""
WITH l AS (SELECT doc_id, coalesce('s' || source, 'n') site, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) pos FROM documents),
t AS (SELECT *, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) key FROM l),
b AS (SELECT key, min(doc_id) AS head FROM t WHERE key <> '' GROUP BY key HAVING count(DISTINCT site) >= {MIN_SITES}),
m AS (SELECT t.doc_id, t.pos, t.line, (b.key IS NOT NULL AND t.doc_id > b.head) gone FROM t LEFT JOIN b ON t.key = b.key),
a AS (SELECT doc_id, count(*) FILTER (gone) n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') kept FROM m GROUP BY doc_id)
SELECT d.doc_id, d.source, coalesce(a.n_removed, 0)::BIGINT n_removed, length(a.kept)::BIGINT n_kept_chars, md5(a.kept) text_md5 FROM documents d LEFT JOIN a USING (doc_id)
"""
