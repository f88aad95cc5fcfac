"""Token files: ids in canonical length-limited Huffman code from global counts, in independent blocks with bit-offset checkpoints.

A file is a table in the shared folder, one row a block: its part and number, the id and token count of each document in it, the
bits, and the bit offset of every STEP-th token. A block holds whole documents, about BLOCK tokens of them (one longer document
is a block of its own), so any block can be read alone; its checkpoints let a table-driven decoder read STEP-token lanes side by
side. The code is given by its lengths alone and is kept with every block's table.

Null text: just the end id. Null ids come first. Rows of equal id stand together, ordered by a hash of their ids; equal rows are interchangeable. An
empty table: no rows. Columns but doc_id and text don't matter. A long text is one block; memory is about 40 bytes a token of it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW_GROUP, discard, lean, new_path, stored, table, tidied
from .tokens import Encoder, encoded, tokenizer_path

LONGEST = 18  # bits of a code word, at most
BLOCK = 1 << 18
COUNTED = 1 << 20  # ids counted at once
STEP = 128
SPLITS = 800_000  # distinct splits whose ids a worker keeps (about 200 MB)


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `longest` bits (package-merge); 0 for symbols that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} symbols need more than {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    own = counts[order].astype(np.float64)
    rounds = []  # for each list: which of its items are packages
    items = own
    for _ in range(longest - 1):
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([own, packages])
        rank = np.argsort(both, kind="stable")
        rounds.append(rank >= len(own))
        items = both[rank]
    take = 2 * len(own) - 2
    total = np.zeros(len(own), np.int64)
    for packaged in reversed(rounds):
        n = int(packaged[:take].sum())
        total[: take - n] += 1
        take = 2 * n
    total[:take] += 1
    lengths[order] = total
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code words: ascending by length, then by symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    code, last = 0, 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)):
        n = int(lengths[s])
        if n:
            code <<= n - last
            codes[s], last = code, n
            code += 1
    return codes


def decode_table(lengths: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """For each `longest` bits: the symbol at their start, and its length."""
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    spans = np.left_shift(1, longest - lengths[used].astype(np.int64))
    symbols, sizes = np.zeros(1 << longest, np.int32), np.ones(1 << longest, np.uint8)
    n = int(spans.sum())
    symbols[:n], sizes[:n] = np.repeat(used, spans), np.repeat(lengths[used], spans)
    return symbols, sizes


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of ids (big-endian words), and the bit offset of every STEP-th."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    word, free = starts >> 6, 64 - (starts & 63) - n
    code = codes[ids].astype(np.uint64)
    head = np.where(free >= 0, code << np.maximum(free, 0).astype(np.uint64), code >> np.maximum(-free, 0).astype(np.uint64))
    out = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
    at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[at]] = np.bitwise_or.reduceat(head, at)
    over = free < 0
    out[word[over] + 1] |= code[over] << (64 + free[over]).astype(np.uint64)  # one code at most runs into a word
    return out.astype(">u8").tobytes(), starts[::STEP]


def decode_block(data: bytes, marks: np.ndarray, n: int, symbols: np.ndarray, sizes: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    windows = np.concatenate([b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:], np.zeros(4, np.uint32)])
    at, out = marks.astype(np.int64).copy(), np.zeros((len(marks), STEP), np.int32)
    for j in range(min(STEP, n)):
        lanes = len(marks) if (len(marks) - 1) * STEP + j < n else len(marks) - 1
        own = at[:lanes]
        peek = (windows[own >> 3] >> (32 - longest - (own & 7)).astype(np.uint32)) & np.uint32((1 << longest) - 1)
        out[:lanes, j] = symbols[peek]
        own += sizes[peek]
    return out.reshape(-1)[:n]


def _tokens(docs: DataFrame, path: str) -> DataFrame:
    """Two kinds of rows: doc_id, row (its number, which tells equal documents apart), digest and ids of a document; token and n, how often a
    task has met it. So ids are counted in the pass that makes them, one row per task and id reaches the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = Encoder.of(path), TaskContext.get().partitionId() << 33
        total = np.zeros(encoder.vocabulary, np.int64)
        for batch in batches:
            for lo, hi, ids in encoded(batch, path, kept=SPLITS):
                flat = np.frombuffer(b"".join(ids), encoder.kind)
                for i in range(0, len(flat), COUNTED):
                    total += np.bincount(flat[i : i + COUNTED], minlength=len(total))
                n = hi - lo
                digest = pa.array([zlib.crc32(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(np.arange(row, row + n)), digest, pa.array(ids, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names)
                row += n
        own = np.flatnonzero(total)
        none = [pa.nulls(len(own), k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(own.astype(np.int32)), pa.array(total[own])], names)

    names = ["doc_id", "row", "digest", "ids", "token", "n"]
    lean(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, row long, digest long, ids binary, token int, n long")


def _counts(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs; one row per id reaches the driver."""
    out = np.zeros(vocabulary, np.int64)
    rows = tokens.where("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    out[np.asarray(rows.column(0), np.int64)] = np.asarray(rows.column(1), np.int64)
    return out


BLOCKS = "part int, block int, start long, n long, docs binary, sizes binary, nulls int, bits binary, marks binary"


def write_tokens(docs: DataFrame, path: str, to: str | None = None) -> tuple[str, np.ndarray]:
    """Writes the ids of docs (doc_id, text) in ascending order of doc_id. Returns the file's path and its code lengths.

    start of a block: tokens before it in its part."""
    spark = docs.sparkSession
    encoder = Encoder.of(path)
    tokens = stored(_tokens(docs, path))
    kind = encoder.kind
    lengths = code_lengths(_counts(tokens, encoder.vocabulary))
    code = spark.sparkContext.broadcast((lengths, canonical(lengths)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, codes = code.value
        part, block, before = TaskContext.get().partitionId(), 0, 0
        names: list = []
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            bits, marks = encode_block(ids, lengths, codes)
            nulls = sum(x is None for x in names)
            row = [part, block, before, len(ids), np.array([x or 0 for x in names], "<i8").tobytes(), np.array([len(x) for x in held], "<i8").tobytes(), nulls, bits, marks.astype("<i8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _BLOCK_TYPES, strict=True)], _BLOCK_NAMES)

        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(x.as_buffer(), kind)
                if n and n + len(ids) > BLOCK:
                    yield flush()
                    before, block, names, held, n = before + n, block + 1, [], [], 0
                names.append(doc)
                held.append(ids)
                n += len(ids)
        if n:
            yield flush()

    to = to or new_path(spark)
    order = ["doc_id", "digest", "row"]  # rows of one id, or of none, can be parted too
    own = tokens.where("token IS NULL").select(*order, "ids").repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    own.mapInArrow(tidied(run), BLOCKS).write.option("compression", "uncompressed").option("parquet.block.size", ROW_GROUP).parquet(to)
    discard(tokens)
    return to, lengths


_BLOCK_NAMES = [x.split()[0] for x in BLOCKS.split(", ")]
_BLOCK_TYPES = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in BLOCKS.split(", ")]


def read_tokens(spark: SparkSession, path: str, lengths: np.ndarray) -> DataFrame:
    """doc_id, part, start (tokens before it in its part), n_tokens, ids_crc32 of each document in a file, from its decoded bits."""
    code = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, sizes = decode_table(code.value)
        for batch in batches:
            for i in range(len(batch)):  # one block at a time, its bytes where they are
                part, before, total, nulls = (batch.column(_BLOCK_NAMES.index(c))[i].as_py() for c in ("part", "start", "n", "nulls"))
                docs, n, marks = (np.frombuffer(batch.column(_BLOCK_NAMES.index(c))[i].as_buffer(), "<i8") for c in ("docs", "sizes", "marks"))
                ids = decode_block(batch.column(_BLOCK_NAMES.index("bits"))[i].as_buffer(), marks, total, symbols, sizes).astype("<u4")
                ends = np.cumsum(n)
                starts = ends - n
                names = pa.array(docs, mask=np.arange(len(docs)) < nulls)  # null ids come first
                crc = [zlib.crc32(ids[lo:hi]) for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(n), part, np.int32)), pa.array(starts + before), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "part", "start", "n_tokens", "ids_crc32"])

    lean(spark)
    return spark.read.schema(BLOCKS).parquet(path).mapInArrow(run, "doc_id long, part int, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs written as a token file and read back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = docs.sparkSession
    to, lengths = write_tokens(docs, path or tokenizer_path())
    parts = spark.read.schema(BLOCKS).parquet(to).groupBy("part").agg(F.sum("n").alias("_n"))  # a row per file part
    before = F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("_before"))
    return read_tokens(spark, to, lengths).join(F.broadcast(parts), "part").select("doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def op10_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
