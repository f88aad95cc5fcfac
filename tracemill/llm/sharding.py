"""Sharding by a k-d tree: nodes are split at weighted medians along their widest metadata dimension until leaves reach the target bytes.

A row's coordinates come from its text alone (logarithm of bytes, bytes per code point, lines per byte, all in integers), so equal
texts have equal coordinates and stay together unless a group of them is heavier than a split may be off. Each coordinate is scaled over
the whole table to 24 bits; 20 bits of the text's hash and 18 of the id's follow, so a split can fall inside any tie. A weighted
median is found digit by digit: each round sums weights per digit (2048 values a node) and descends into the digit where the
median lies, first to a group of equal texts and, if cutting beside it would be off by over GROUP_OFF, to an id within it. The driver
only ever sees those sums, whose number doesn't depend on the rows.

Null text: no bytes, size 1. Null ids and repeated rows are hashed like others; rows of equal id and text stay together and are numbered in
any order. An empty table gives no rows. Columns but doc_id and text don't matter. Texts of any length are measured in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, stored, table

SHARDS = 8
SCALE, TEXT_BITS, ID_BITS, DIGIT = 24, 20, 18, 11
GROUP = SCALE + TEXT_BITS  # bits that equal texts share
BITS = GROUP + ID_BITS
GROUP_OFF = 400  # a split beside a group of equal texts may be off by the table's weight over this
SLOTS = 1024  # buckets of a shard within which rows are numbered
DIMS = ("_x0", "_x1", "_x2")


def _hashed(text: Column) -> Column:
    """20 bits of a hash."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 5), 16, 10).cast("long")


def coordinates(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, _t (hash of the text), _i (of the id), and the raw dimensions _x0.._x2, in steps of 2^-20."""
    t = F.coalesce("text", F.lit(""))
    own = docs.select(
        "doc_id", (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), _hashed(t).alias("_t"),
        F.shiftright(_hashed(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 20 - ID_BITS).alias("_i"),
        F.char_length(t).cast("long").alias("_chars"), (F.char_length(t) - F.char_length(F.replace(t, F.lit("\n"), F.lit("")))).cast("long").alias("_lines"),
    )
    own = own.withColumn("_bits", F.length(F.bin("size")))
    return own.select(
        "doc_id", "size", "text_crc32", "_t", "_i", F.expr("(_bits - 1) * 1048576L + shiftright(shiftleft(size, 20), _bits - 1) - 1048576L").alias("_x0"),
        F.expr("shiftleft(size - 1, 20) div greatest(_chars, 1L)").alias("_x1"), F.expr("shiftleft(_lines, 20) div size").alias("_x2"),
    )


@dataclass
class Node:
    id: int
    leaves: int
    first: int  # its first leaf
    condition: Column


def _case(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda c, x: c.when(*x), pairs[1:], F.when(*pairs[0]))


def _cuts(own: DataFrame, nodes: list[Node], weights: dict[int, int], keys: dict[int, Column], whole: int, weight: str) -> dict[int, int]:
    """For each node, where its key is cut: rows below go left. own: _node, _key."""
    # prefix: the digits found so far, of `bits` bits; below: weight before them
    open_ = {n.id: {"leaves": n.leaves, "goal": weights[n.id] * (n.leaves // 2), "prefix": 0, "bits": 0, "below": 0} for n in nodes}
    cuts: dict[int, int] = {}
    while open_:
        at = []
        for i, s in open_.items():
            s["next"] = min(DIGIT, (GROUP if s["bits"] < GROUP else BITS) - s["bits"])
            inside = (F.col("_node") == i) & (F.shiftright("_key", BITS - s["bits"]) == s["prefix"])
            at.append((inside, F.shiftright("_key", BITS - s["bits"] - s["next"]).bitwiseAND((1 << s["next"]) - 1)))
        sums = own.withColumn("_digit", _case(at)).where("_digit IS NOT NULL").groupBy("_node", "_digit").agg(F.sum(weight).alias("w")).collect()
        for i, s in list(open_.items()):
            k, below = s["leaves"], s["below"]
            for digit, w in sorted((r["_digit"], r["w"]) for r in sums if r["_node"] == i):
                if (below + w) * k >= s["goal"]:
                    break
                below += w
            else:
                digit, w = (1 << s["next"]) - 1, 0
            s.update(prefix=s["prefix"] << s["next"] | digit, bits=s["bits"] + s["next"], below=below)
            before, after = s["goal"] - below * k, (below + w) * k - s["goal"]
            if s["bits"] == BITS or (s["bits"] == GROUP and min(before, after) * GROUP_OFF <= whole * k):
                cuts[i] = (s["prefix"] + (after < before)) << (BITS - s["bits"])  # it goes to the nearer side
                del open_[i]
    return cuts


def split(rows: DataFrame, leaves: int = SHARDS, weight: str = "size") -> list[tuple[int, Column]]:
    """rows: weight and a 62-bit key for each of DIMS. Returns (leaf, condition on rows) for each leaf; the conditions part the rows."""
    nodes, done, made = [Node(0, leaves, 0, F.lit(True))], [], 1
    whole = rows.agg(F.sum(weight)).first()[0] or 0
    if not whole or leaves < 2:
        return [(0, F.lit(True))]
    while nodes:
        own = rows.withColumn("_node", _case([(n.condition, F.lit(n.id)) for n in nodes])).where("_node IS NOT NULL")
        shift = BITS - SCALE
        ends = {r["_node"]: r for r in own.groupBy("_node").agg(F.sum(weight).alias("w"), *[(F.shiftright(F.max(d), shift) - F.shiftright(F.min(d), shift)).alias(d) for d in DIMS]).collect()}
        keys = {n.id: F.col(max(DIMS, key=lambda d: ends[n.id][d]) if n.id in ends else DIMS[0]) for n in nodes}
        own = own.withColumn("_key", _case([(F.col("_node") == n.id, keys[n.id]) for n in nodes]))
        cuts = _cuts(own, nodes, {n.id: ends[n.id]["w"] if n.id in ends else 0 for n in nodes}, keys, whole, weight)
        grown = []
        for n in nodes:
            left = n.leaves // 2
            for k, first, side in ((left, n.first, keys[n.id] < cuts[n.id]), (n.leaves - left, n.first + left, keys[n.id] >= cuts[n.id])):
                if k > 1:
                    grown.append(Node(made, k, first, n.condition & side))
                else:
                    done.append((first, n.condition & side))
                made += 1
        nodes = grown
    return done


def shard(docs: DataFrame, leaves: int = SHARDS) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs."""
    raw = stored(coordinates(docs))
    ends = raw.agg(*[F.min(d) for d in DIMS], *[F.max(d) for d in DIMS]).first()

    def key(d: str, lo: int, hi: int) -> Column:
        scaled = F.expr(f"least(shiftleft({d} - {lo}L, {SCALE}) div {max(hi - lo, 1)}L, {(1 << SCALE) - 1}L)")
        return (F.shiftleft(scaled, TEXT_BITS + ID_BITS) + F.shiftleft("_t", ID_BITS) + F.col("_i")).alias(d)

    if ends[0] is None:
        return raw.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    rows = stored(raw.select("doc_id", "size", "text_crc32", "_t", "_i", *[key(*x) for x in zip(DIMS, ends[:3], ends[3:], strict=True)]))
    discard(raw)
    rows = rows.withColumn("shard", _case([(c, F.lit(leaf)) for leaf, c in split(rows, leaves)])).withColumn("_bucket", (F.col("_t") + F.col("_i")) % SLOTS)
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("shard", "_bucket", before.alias("_before"))
    own = rows.withColumn("_row", F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_t", "doc_id")))
    return own.join(counts, ["shard", "_bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("_before") + F.col("_row") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


#: The crc32 of a list of bytes, by SQL: the table of its 256 remainders, and the steps.
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) crc_table)"


def crc_sql(byte_list: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {byte_list}), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"


def bytes_sql(blob: str) -> str:
    return f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda x: ('0x' || x)::BIGINT)"


def _level(n: int) -> str:
    """SQL: nodes of level n, from those of level n - 1, halved by exact medians."""
    low = 1 << ID_BITS
    return f"""
e{n} AS (SELECT node, sum(size) w, max(k0 >> {BITS - SCALE}) - min(k0 >> {BITS - SCALE}) s0, max(k1 >> {BITS - SCALE}) - min(k1 >> {BITS - SCALE}) s1, max(k2 >> {BITS - SCALE}) - min(k2 >> {BITS - SCALE}) s2 FROM n{n - 1} GROUP BY node),
h{n} AS (SELECT n.*, w, CASE WHEN s0 >= s1 AND s0 >= s2 THEN k0 WHEN s1 >= s2 THEN k1 ELSE k2 END key FROM n{n - 1} n JOIN e{n} USING (node)),
g{n} AS (SELECT node, w, key // {low} g, sum(size) gw, sum(sum(size)) OVER (PARTITION BY node ORDER BY key // {low}) upto FROM h{n} GROUP BY node, w, key // {low}),
m{n} AS (SELECT node, w, arg_min(g, g) g, arg_min(upto, g) upto, arg_min(upto - gw, g) below FROM g{n} WHERE 2 * upto >= w GROUP BY node, w),
i{n} AS (SELECT h.node, h.w, key, sum(size) kw, m.below + sum(sum(size)) OVER (PARTITION BY h.node ORDER BY key) upto FROM h{n} h JOIN m{n} m ON h.node = m.node AND h.key // {low} = m.g GROUP BY h.node, h.w, key, m.below),
j{n} AS (SELECT node, w, min(key) key, arg_min(upto, key) upto, arg_min(upto - kw, key) below FROM i{n} WHERE 2 * upto >= w GROUP BY node, w),
c{n} AS (SELECT m.node, CASE WHEN least(m.w - 2 * m.below, 2 * m.upto - m.w) * {GROUP_OFF} <= 2 * (SELECT sum(size) FROM z) THEN (m.g + (2 * m.upto - m.w < m.w - 2 * m.below)::INT) * {low}
  ELSE j.key + (2 * j.upto - j.w < j.w - 2 * j.below)::INT END cut FROM m{n} m JOIN j{n} j USING (node)),
n{n} AS (SELECT h.* EXCLUDE (w, key, node), 2 * h.node + (h.key >= c.cut)::INT node FROM h{n} h JOIN c{n} c USING (node)),"""


_KEY = ", ".join(f"least((({d} - min({d}) OVER ()) << {SCALE}) // greatest(max({d}) OVER () - min({d}) OVER (), 1), {(1 << SCALE) - 1}) * {1 << (TEXT_BITS + ID_BITS)} + th * {1 << ID_BITS} + ih k{i}" for i, d in enumerate(("x0", "x1", "x2")))
ORACLE = f"""
WITH {CRC_TABLE},
t AS (SELECT doc_id, coalesce(text, '') t FROM documents),
r AS (SELECT doc_id, strlen(t)::BIGINT + 1 size, {crc_sql(bytes_sql('encode(t)'))}::BIGINT text_crc32, length(t)::BIGINT chars, (length(t) - length(replace(t, chr(10), '')))::BIGINT nl, length(bin(strlen(t)::BIGINT + 1)) bits,
  ('0x' || substr(md5(t), 1, 5))::BIGINT th, ('0x' || substr(md5(doc_id::VARCHAR), 1, 5))::BIGINT >> {20 - ID_BITS} ih FROM t, crc),
x AS (SELECT *, (bits - 1) * 1048576 + ((size << 20) >> (bits - 1)) - 1048576 x0, ((size - 1) << 20) // greatest(chars, 1) x1, (nl << 20) // size x2 FROM r),
z AS (SELECT doc_id, size, text_crc32, th, ih, {_KEY} FROM x),
n0 AS (SELECT *, 0 node FROM z),{_level(1)}{_level(2)}{_level(3)}
s AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY (th + ih) % {SLOTS}, th, doc_id) - 1 slot FROM n3)
SELECT doc_id, size, text_crc32, 'bytes' AS law, node::INT AS shard, slot::BIGINT slot, NULL::INT grown_shard FROM s
"""
