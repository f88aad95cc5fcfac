"""Packing by non-negative least squares.

Documents are tokenized; whole windows are cut off a long document and are sequences by themselves. The lengths of what remains
(1 to window - 1 tokens, in steps of UNIT, rounded up) make a histogram. Combinations of up to DEPTH lengths that fill the
window are the columns of a matrix; non-negative least squares gives how often each should be repeated, rounding down makes it
feasible, and what is left is packed greedily, largest first. Only the histogram (window / UNIT counts) is on the driver, and
only the plan made from it, of as bounded a size, is broadcast; each document finds its place by its rank among those of its length.

Null text: just the end id. Rows of equal id, and of null id, are separate documents; where several are equal in all but place, they are
interchangeable. An empty table gives no rows. Columns but doc_id and text don't matter. A long text is held by one worker, with its
ids, and takes one row of windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, stored, table, tidied
from .tokens import Encoder, encoded, tokenizer_path

WINDOW = 2048
UNIT = 8
DEPTH = 3
SALTS = 256


def crc_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def token_pieces(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """doc_id, n (ids with the end id), crcs: of each whole window and of the rest."""
    path = path or tokenizer_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in encoded(batch, path):
                ids = [np.frombuffer(x, Encoder.of(path).kind) for x in texts]
                crcs = [[crc_ids(x[i : i + window]) for i in range(0, len(x), window)] for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(x) for x in ids], pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "n", "crcs"])
        Encoder.of(path).rest()

    lean(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, n long, crcs array<long>")


def combinations(bins: int, depth: int = DEPTH) -> np.ndarray:
    """Columns: how often each length 1..bins (row 0 is length 1) is in a combination of at most `depth` lengths that sum to bins."""
    found: list[list[int]] = []

    def extend(parts: list[int], left: int, most: int) -> None:
        if not left:
            found.append(parts)
        elif len(parts) < depth:
            for k in range(min(left, most), 0, -1):
                if k * (depth - len(parts)) >= left:
                    extend([*parts, k], left - k, k)

    extend([], bins, bins - 1)
    a = np.zeros((bins, len(found)))
    for j, parts in enumerate(found):
        for k in parts:
            a[k - 1, j] += 1
    return a


def nnls(a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |a x - b| (Lawson and Hanson's active set method)."""
    x = np.zeros(a.shape[1])
    passive = np.zeros(a.shape[1], bool)
    tiny = 1e-9 * max(1.0, np.abs(b).max(initial=0))
    for _ in range(most or 3 * a.shape[0]):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tiny:
            break
        passive[j] = True
        while True:
            own = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, own], b, rcond=None)[0]
            if s.min(initial=1) > 0:
                break
            at = s <= 0
            step = np.min(x[own][at] / np.maximum(x[own][at] - s[at], 1e-300))
            x[own] += step * (s - x[own])
            passive[own[x[own] <= tiny * 1e-3]] = False
            x[~passive] = 0
        x[:] = 0
        x[own] = s
    return x


def plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[dict[int, int], int]]:
    """histogram[k]: pieces of length k + 1 (in units; the last is the whole window). Returns ({length: how many}, repeats)."""
    bins = len(histogram)
    left = histogram.astype(np.int64).copy()
    out: list[tuple[dict[int, int], int]] = []

    def use(parts: dict[int, int], times: int) -> None:
        if times > 0:
            out.append((parts, times))
            for k, m in parts.items():
                left[k - 1] -= m * times

    if left.sum():
        a = combinations(bins, depth)
        a = a[:, (a <= left[:, None]).all(axis=0)]
        if a.shape[1]:
            x = nnls(a, left.astype(float))
            for j in np.argsort(-x):
                if x[j] < 1:
                    break
                parts = {int(k) + 1: int(a[k, j]) for k in np.flatnonzero(a[:, j])}
                use(parts, min(int(x[j]), *(int(left[k - 1]) // m for k, m in parts.items())))
    while left.sum():  # each round uses up a length, or all but less than one sequence of it
        parts, room = {}, bins
        while room and len(fits := np.flatnonzero(left[:room])):
            k = int(fits[-1]) + 1
            m = min(room // k, int(left[k - 1]) - parts.get(k, 0))
            if m <= 0:
                smaller = [int(f) + 1 for f in fits if left[f] > parts.get(int(f) + 1, 0)]
                if not smaller:
                    break
                k = smaller[-1]
                m = min(room // k, int(left[k - 1]) - parts.get(k, 0))
            parts[k] = parts.get(k, 0) + m
            room -= k * m
        use(parts, min(int(left[k - 1]) // m for k, m in parts.items()))
    return out


def places(plans: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, per sequence, first sequence, first slot): where pieces go by their rank among those of their length."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for parts, times in plans:
        slot = 0
        for k, m in sorted(parts.items(), reverse=True):
            lo = rank.get(k, 0)
            rows.append((k, lo, lo + m * times, m, sequence, slot))
            rank[k] = lo + m * times
            slot += m
        sequence += times
    return rows


def pack(docs: DataFrame, window: int = WINDOW, unit: int = UNIT, path: str | None = None) -> DataFrame:
    """docs: doc_id, text. Returns per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    sized = stored(token_pieces(docs, window, path))
    rest = F.col("n") % window
    sized = sized.withColumn("_full", F.floor(F.col("n") / window)).withColumn("_rest", rest).withColumn("_bin", F.ceil(rest / unit).cast("int")).withColumn("_salt", F.pmod(F.xxhash64("doc_id", "crcs"), F.lit(SALTS)))
    c2 = sized.groupBy("_bin", "_salt").agg(F.count("*").alias("_c"), F.sum("_full").alias("_f"))
    histogram = np.zeros(window // unit, np.int64)
    for r in c2.where("_bin > 0").groupBy("_bin").agg(F.sum("_c").alias("c")).collect():
        histogram[r["_bin"] - 1] = r["c"]
    plans = plan(histogram)
    packed = sum(times for _, times in plans)
    where = spark.createDataFrame(places(plans) or [(0, 0, 0, 1, 0, 0)], "_bin int, _lo long, _hi long, _per long, _first long, _slot long")
    c1 = c2.groupBy("_bin").agg(F.sum("_f").alias("_f"))  # a row per length, at most window / unit + 1

    def before(name: str, w) -> F.Column:
        return F.coalesce(F.sum(name).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    c1 = c1.select("_bin", before("_f", Window.orderBy("_bin")).alias("_f1"))
    salts = Window.partitionBy("_bin").orderBy("_salt")
    c2 = c2.select("_bin", "_salt", before("_c", salts).alias("_c0"), before("_f", salts).alias("_f2"))
    offsets = c2.join(F.broadcast(c1), "_bin").select("_bin", "_salt", "_c0", (F.col("_f1") + F.col("_f2")).alias("_f0"))
    order = Window.partitionBy("_bin", "_salt").orderBy("doc_id", "n", F.col("crcs")[0])
    rows = sized.withColumn("_row", F.row_number().over(order) - 1).withColumn("_fb", before("_full", order)).join(offsets, ["_bin", "_salt"])
    rows = rows.withColumn("_rank", F.col("_row") + F.col("_c0"))
    full = rows.where("_full > 0").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_full") - 1)))
    full = full.select(
        "doc_id", (F.col("_i") * window).alias("start"), F.lit(window).cast("long").alias("length"), F.get("crcs", F.col("_i").cast("int")).alias("ids_crc32"), F.col("n").alias("doc_tokens"),
        (F.lit(packed) + F.col("_f0") + F.col("_fb") + F.col("_i")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    tail = rows.where("_bin > 0").join(F.broadcast(where.withColumnRenamed("_bin", "_k")), (F.col("_bin") == F.col("_k")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    at = F.col("_rank") - F.col("_lo")
    tail = tail.select(
        "doc_id", (F.col("_full") * window).cast("long").alias("start"), F.col("_rest").alias("length"), F.element_at("crcs", -1).alias("ids_crc32"), F.col("n").alias("doc_tokens"),
        (F.col("_first") + F.floor(at / F.col("_per"))).cast("long").alias("sequence_id"), (F.col("_slot") + at % F.col("_per")).alias("_place"),
    )
    tail = tail.withColumn("offset", before("length", Window.partitionBy("sequence_id").orderBy("_place")).cast("long")).drop("_place")
    return full.unionByName(tail)


def op5_pack_nnls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: where each piece of each document goes. Null texts are just an end id; null and repeated ids are packed like others."""
    return pack(docs)
