"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are its distinct five-word shingles. Two documents link when 100 * |A and B| >= 80 * |A or B|.

All tokens have one global order: rare ones first (by hash), then frequent ones (by bit length of the count, then hash), then those
outside the counted band (by hash). A document of n tokens misses at most n - ceil(0.8 n) of them in a partner, so its prefix must
survive that many losses. Rare tokens are indexed singly and survive with one token each. Frequent tokens fall into classes and are
indexed as pairs within a class, of which each loss takes one token; the prefix is extended until its classes survive the losses
too. Only where a document has too few frequent tokens for that do tokens outside the band follow, singly. Since every prefix is cut by the
same order, linked documents share a signature. The number of classes grows with the size (classes(), a step for each factor of
four), so a long text has signatures in proportion to its tokens; documents near a step index both sides of it. Below FIRST tokens, where one or
two losses leave no room for classes, the plain prefix is indexed. Frequencies are counts over all documents of all tokens of the band, where
equal sets that one task meets count once: the order they give may differ between runs, the links don't, since one run uses one order. The
frequent ones are broadcast under a size bound (MOST_FREQUENT), which raises what counts as frequent where more exist.

Documents that share a signature are candidates, unless a bound on their sets' difference (parities of hash classes, at least PARITY,
as many as tokens in longer texts) rules them out, which it does only where they can't link. First each is compared with the first
document of a signature's list; what links is joined into components. Then, ROUNDS times, each document of lists that still span components is
compared with the nearest ones of other components (by parities, one in each of SEEK lists of its own). At last all pairs that share a
signature and still lie in different components are compared. All comparisons are exact, on the whole sets (64-bit hashes of shingles). So no link between components is lost, and
groups of copies cost no pairs. Lists of signatures are made in buckets, whose number grows with the shuffle partitions. A list of over HELD
documents leaves its bucket as plain rows: Spark finds its first document by partial aggregation, and its other pairs come from
blocks of HELD documents or so, two by two, by size, each pair of blocks where it falls.

Null or empty text, or no words: no tokens, linked with nothing. Fewer than five words: the whole sequence is one token. Null ids:
component null. Rows of one id count as one document, which links to whatever one of its texts links to. Exact copies collapse into one
before any signature is compared. An empty table gives no rows. Columns but doc_id and text don't matter. A long text is held by one worker.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, discard, lean, mixed, partitions, raw, shingles, stored, table, tidied
from .graph import components

WIDTH = 5
BAND = np.uint64(int(0.4 * 2**64))  # tokens with a hash below are counted
RARE = 16  # documents that a rare token is in, at most
MOST_FREQUENT = 1 << 20  # frequent tokens that are broadcast, at most (8 MB)
FIRST, STEP = 12, 4  # tokens of the smallest document with classes; sizes from one number of classes to the next
HELD = 1024  # documents of a signature that are compared in one place
BUCKETS = 4  # parts of a shuffle partition's data, of which a task holds one at a time
FLUSH = 1 << 18  # rows that a task sorts into buckets together
MOST_ROWS = 1 << 20  # rows of a bucket that are held before long lists leave it
ROUNDS, SEEK = 1, 8
PARITY = 1024
MOST_BITS = 1 << 26  # size of a filter of candidates, at most (8 MB)


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Of sorted keys, whether each is the first of its kind."""
    return np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)


def _scatter(key: np.ndarray, columns: list[np.ndarray], buckets: int, also: list[np.ndarray] | None = None) -> pa.RecordBatch:
    """Rows (of int64) by bucket of their key, each bucket as one blob; and rows of another kind, whose first column is their key, as another."""
    parts: list[dict[int, bytes]] = []
    for k, c in ((key, columns), (also[0].view(np.uint64), also) if also else (key[:0], [key[:0]])):
        bucket = (mixed(k) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        packed = np.stack([np.ascontiguousarray(x).view(np.int64) for x in c], axis=1)[order]
        at = np.flatnonzero(_firsts(bucket)).tolist()
        parts.append({int(bucket[lo]): packed[lo:hi].tobytes() for lo, hi in itertools.pairwise([*at, len(bucket)])})
    own = sorted(parts[0].keys() | parts[1].keys())
    blobs = [pa.array([p.get(b, b"") for b in own], pa.binary()) for p in parts]
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *blobs], ["bucket", "blob", "also"])


_BLOBS = "bucket int, blob binary, also binary"


def _gathered(df: DataFrame) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), "bucket").sortWithinPartitions("bucket")


def _by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[Iterator[tuple[np.ndarray, np.ndarray]]]:
    """For each bucket, its pairs of blobs (as int64)."""
    each = (x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True))
    for _, own in itertools.groupby(each, itemgetter(0)):
        yield (tuple(np.frombuffer(x.as_buffer(), np.int64) if len(x.as_buffer()) else np.zeros(0, np.int64) for x in blobs) for _, *blobs in own)


def _sets(batch: pa.RecordBatch, skip: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(row, token set) of a batch whose column 1 has the text; rows marked in skip are left out."""
    column = batch.column(1)
    rows = np.arange(len(column)) if skip is None else np.flatnonzero(~skip)
    if skip is not None:
        column = column.take(pa.array(rows))
    data, offsets = raw(column)
    for lo, hi in chunks(offsets):
        for i, s in enumerate(shingles(data, offsets[lo : hi + 1], WIDTH)):
            yield int(rows[lo + i]), s


def set_hash(s: np.ndarray) -> tuple[int, int]:
    return int(mixed(s).sum(dtype=np.uint64).astype(np.int64)), int(mixed(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).astype(np.int64))


def frequent_tokens(docs: DataFrame, rare: int = RARE, most: int = MOST_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens of the band that are in more than `rare` documents (equal sets within a task counting once), `most` of them at most,
    and the bit length of each one's count. A task sends a token that it meets often with a count, so a hot one brings few rows."""
    buckets = BUCKETS * partitions(docs.sparkSession)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, n = set(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            once = count == 1
            yield _scatter(token[once], [token[once]], buckets, [token[~once], count[~once]])

        for batch in batches:
            for _, s in _sets(batch):
                if len(s) and (key := set_hash(s)) not in seen:
                    seen.add(key)
                    held.append(s[: np.searchsorted(s, BAND)])
                    n += len(held[-1])
                    if n > FLUSH:
                        yield from flush()
                        held, n = [], 0
        if n:
            yield from flush()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _by_bucket(batches):
            ones, many = (np.concatenate(x) for x in zip(*bucket, strict=True))
            many = many.reshape(-1, 2)
            token, at = np.unique(np.concatenate([ones, many[:, 0]]), return_inverse=True)
            n = np.bincount(at, np.concatenate([np.ones(len(ones)), many[:, 1]]), len(token)).astype(np.int64)
            own = n > rare
            yield pa.RecordBatch.from_arrays([pa.array(token[own]), pa.array(n[own])], ["token", "n"])

    counted = stored(_gathered(docs.select("doc_id", "text").mapInArrow(tidied(emit), _BLOBS)).mapInArrow(tidied(count), "token long, n long"))
    bits = {r["b"]: r["c"] for r in counted.groupBy(F.length(F.bin("n")).alias("b")).agg(F.count("*").alias("c")).collect()}
    least, total = 0, 0
    for b in sorted(bits, reverse=True):
        total += bits[b]
        if total > most:
            least = 1 << b
            break
    found = counted.where(F.col("n") >= least).select("token", F.length(F.bin("n")).alias("b")).toArrow()
    discard(counted)
    tokens = np.asarray(found.column(0), dtype=np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.asarray(found.column(1), dtype=np.uint8)[order]


_PAIR, _SHORT, _PARITY = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0x8EBC6AF09C88C6E3)


def parity(s: np.ndarray, least: int = PARITY) -> np.ndarray:
    """For each of `least` hash classes, or the next power of two above the number of tokens, whether an odd number of tokens are in it. Two sets
    differ in as many tokens as parities, at least."""
    size = max(least, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((mixed(s ^ _PARITY) % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(x: np.ndarray, words: int = PARITY // 64) -> np.ndarray:
    """Parities of fewer classes."""
    return np.bitwise_xor.reduce(x.reshape(-1, words), axis=0)


def alike(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m tokens may link, by size."""
    return 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)


def possible(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of n and m tokens with parities x and y may link: a similarity of 0.8 means a difference of at most (n + m) / 9."""
    return alike(n, m) & (9 * np.bitwise_count((x ^ y).view(np.uint64)).sum(axis=-1, dtype=np.int64) <= n + m)


def wide_possible(n: int, m: int, x: np.ndarray, y: np.ndarray) -> bool:
    """The same of two sets, by all classes that both have."""
    words = min(len(x), len(y))
    return 9 * int(np.bitwise_count((folded(x, words) ^ folded(y, words)).view(np.uint64)).sum(dtype=np.int64)) <= n + m


def steps(n: int) -> list[int]:
    """The steps of size at which a document of n tokens is indexed: its own and, if a partner may be a step smaller, that one too; -1 is the plain prefix."""
    k, size = -1, FIRST
    while n >= size:
        k, size = k + 1, size * STEP
    return [k] if k < 0 or 4 * n >= 5 * (size // STEP) else [k, k - 1]


def classes(step: int) -> int:
    """A sixth of a step's smallest size: there the pairs of a prefix of frequent tokens alone survive the losses."""
    return 2 * STEP**step


def _pairs(hot: np.ndarray, left: int, step: int) -> tuple[list[np.ndarray], int]:
    """Signatures of as many of the hot tokens as survive `left` losses, and how many losses that leaves open."""
    group = mixed(hot ^ _PAIR) % np.uint64(classes(step))
    order = np.argsort(group, kind="stable")
    start = np.searchsorted(group[order], group[order])
    nth = np.empty(len(hot), np.int64)
    nth[order] = np.arange(len(hot)) - start  # how many of its class come before it
    survive = np.cumsum(nth > 0)
    take = int(np.searchsorted(survive, left)) + 1
    hot, group = hot[:take], group[:take]
    order = np.lexsort((hot, group))
    hot, group = hot[order], group[order]
    out = []
    for d in range(1, len(hot)):
        same = group[d:] == group[:-d]
        if not same.any():
            break
        out.append(mixed(hot[:-d][same] * _PAIR + mixed(hot[d:][same] + np.uint64(step))))
    return out, left - (int(survive[min(take, len(survive)) - 1]) if len(survive) else 0)


def signatures(s: np.ndarray, frequent: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The signatures of a document whose sorted tokens are s. frequent, level: of frequent_tokens()."""
    n = len(s)
    if not n:
        return s
    need = n - (4 * n + 4) // 5 + 1
    band = s[: np.searchsorted(s, BAND)]
    rest = s[len(band) :]
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, band), len(frequent) - 1)
        hot = frequent[at] == band
        rare, at = band[~hot], at[hot]
        hot = frequent[at[np.argsort(level[at], kind="stable")]]
    else:
        rare, hot = band, band[:0]
    out = [rare[:need] if n >= FIRST else rare[:0]]
    for step in steps(n):
        if step < 0:
            out.append(mixed(np.concatenate([rare, hot, rest])[:need] ^ _SHORT))
        elif len(rare) < need:
            own, left = _pairs(hot, need - len(rare), step)
            out += own
            if left > 0:
                out.append(rest[:left])
    return np.unique(np.concatenate(out))


def _signed(docs: DataFrame, frequent) -> DataFrame:
    """doc_id, n, h1, h2 (hash of the set), sigs and parities (both null where the task has seen the set before, or the id is null)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (tokens, level), seen = frequent.value, set()
        for batch in batches:
            ids = batch.column(0)
            null = np.asarray(ids.is_null())
            n, h1, h2 = (np.zeros(len(ids), np.int64) for _ in range(3))
            sigs: list = [None] * len(ids)
            parities: list = [None] * len(ids)
            for row, s in _sets(batch):
                n[row] = len(s)
                if len(s):
                    h1[row], h2[row] = key = set_hash(s)
                    if not null[row] and key not in seen:
                        seen.add(key)
                        sigs[row] = signatures(s, tokens, level).tobytes()
                        parities[row] = parity(s).tobytes()
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(h1), pa.array(h2), pa.array(sigs, pa.binary()), pa.array(parities, pa.binary())], ["doc_id", "n", "h1", "h2", "sigs", "parities"])

    return docs.mapInArrow(tidied(run), "doc_id long, n long, h1 long, h2 long, sigs binary, parities binary")


def _lists(sets: DataFrame, held: int) -> DataFrame:
    """sets: rep, n, sigs. kind 0: blob, the lists of a bucket, of 3 to `held` documents each (rows of signature, id, n, in order); kind 1: a, b, the first id
    of a list and another, if they may link by size; kind 2: a, b, c, the signature, id and n of each document in a longer list."""
    buckets = BUCKETS * partitions(sets.sparkSession)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, total = [], 0

        def flush() -> pa.RecordBatch:
            sig, rep, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            return _scatter(sig.view(np.uint64), [sig, rep, n], buckets)

        for batch in batches:
            reps, sizes = (np.asarray(batch.column(k), dtype=np.int64) for k in (0, 1))
            for i, blob in enumerate(batch.column(2)):
                sig = np.frombuffer(blob.as_buffer(), np.int64)
                parts.append((sig, np.full(len(sig), reps[i]), np.full(len(sig), sizes[i])))
                total += len(sig)
                if total > FLUSH:
                    yield flush()
                    parts, total = [], 0
        if total:
            yield flush()

    def rows(kind: int, x: np.ndarray, blob: bytes | None = None) -> pa.RecordBatch:
        n = 1 if blob is not None else len(x)
        columns = [pa.array(np.ascontiguousarray(x[:, k])) if blob is None and k < x.shape[1] else pa.nulls(n, pa.int64()) for k in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *columns, pa.array([blob] * n, pa.binary())], ["kind", "a", "b", "c", "blob"])

    def split(x: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of short lists, of long ones, and the signatures that are known to be long."""
        sig, n = np.unique(x[:, 0], return_counts=True)
        long = np.union1d(long, sig[n > held])
        own = np.isin(x[:, 0], long)
        return x[~own], x[own], long

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _by_bucket(batches):
            parts, total, most, long = [], 0, MOST_ROWS, np.zeros(0, np.int64)
            for blob, _ in bucket:
                parts.append(blob.reshape(-1, 3))
                total += len(parts[-1])
                if total > most:
                    x, away, long = split(np.concatenate(parts), long)
                    yield rows(2, away)
                    parts, total = [x], len(x)
                    most = max(most, 2 * total)
            x, away, _ = split(np.concatenate(parts), long)
            if len(away):
                yield rows(2, away)
            x = x[np.lexsort((x[:, 1], x[:, 0]))]
            x = x[_firsts(x[:, 0]) | _firsts(x[:, 1])]
            first = _firsts(x[:, 0])
            at = np.flatnonzero(first)
            size = np.diff([*at, len(x)])
            pivot = x[np.repeat(at, size)]
            pairs = np.stack([pivot[:, 1], x[:, 1]], axis=1)[~first & alike(pivot[:, 2], x[:, 2])]
            yield rows(1, np.unique(pairs, axis=0))
            x = x[np.repeat(size > 2, size)]
            if len(x):
                yield rows(0, x, x.tobytes())

    return _gathered(sets.select("rep", "n", "sigs").mapInArrow(tidied(emit), _BLOBS)).mapInArrow(tidied(meet), "kind int, a long, b long, c long, blob binary")


def _hot(lists: DataFrame) -> DataFrame:
    return lists.where("kind = 2").select(F.col("a").alias("sig"), F.col("b").alias("rep"), F.col("c").alias("n"))


def _hot_sizes(lists: DataFrame, held: int) -> DataFrame:
    """sig, blocks: a power of two, of about `held` documents each."""
    n = _hot(lists).groupBy("sig").agg(F.count("*").alias("m"))
    return stored(n.select("sig", F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(F.col("m") / held)), F.lit(0))).cast("long").alias("blocks")))


def _hot_pairs(lists: DataFrame) -> DataFrame:
    """a, b: of each long list its first id and another."""
    hot = _hot(lists)
    return hot.join(stored(hot.groupBy("sig").agg(F.min("rep").alias("a"))), "sig").where("a < rep").select("a", F.col("rep").alias("b"))


def _bounded(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (a, b) that may link. marks: rep, n, parities."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, x, m, y = batch.columns
            n, m = (np.asarray(c, dtype=np.int64) for c in (n, m))
            ok = alike(n, m)
            for i in np.flatnonzero(ok).tolist():
                ok[i] = wide_possible(n[i], m[i], *(np.frombuffer(c[i].as_buffer(), np.int64) for c in (x, y)))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in (a, b)], ["a", "b"])

    left, right = (marks.select(F.col("rep").alias(k), F.col("n").alias(f"n{k}"), F.col("parities").alias(f"p{k}")) for k in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "pa", "nb", "pb").mapInArrow(tidied(run), "a long, b long").distinct()


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a.view(np.uint64) * _PAIR + mixed(b.view(np.uint64)))


def _filter(keys: DataFrame, hashed) -> np.ndarray:
    """A bit per hash of a row of keys (a stored table), 16 bits for each row as far as MOST_BITS goes; what has no bit is not among them."""
    size = 1 << min(max(16, (16 * keys.count() - 1).bit_length()), MOST_BITS.bit_length() - 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(hashed(*[np.asarray(c, dtype=np.int64) for c in batch.columns]) % np.uint64(size)).astype(np.int64)
            word, at = np.unique(bit >> 6, return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (bit & 63).astype(np.uint64), at) if len(bit) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], ["word", "bits"])

    out = np.zeros(size >> 6, np.int64)
    rows = keys.mapInArrow(tidied(run), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[np.asarray(rows.column(0), dtype=np.int64)] = np.asarray(rows.column(1), dtype=np.int64)
    return out


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = (hashes % np.uint64(len(bits) << 6)).astype(np.int64)
    return (bits[bit >> 6] >> (bit & 63)) & 1 == 1


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows (a, b) of pairs, a stored table, whose documents link. Their sets are made once and stored."""
    spark = docs.sparkSession
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    wanted = spark.sparkContext.broadcast(_filter(ids, lambda x: mixed(x.view(np.uint64))))

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0), dtype=np.int64)
            rows, blobs, held = [], [], 0
            for row, s in _sets(batch, ~_has(wanted.value, mixed(ids.view(np.uint64)))):
                rows.append(row)
                blobs.append(s.tobytes())
                held += len(blobs[-1])
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(blobs, pa.binary())], ["id", "tokens"])
                    rows, blobs, held = [], [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(blobs, pa.binary())], ["id", "tokens"])

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = batch.columns
            ok = np.zeros(len(a), bool)
            for i in range(len(a)):
                s, t = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (x, y))
                if 5 * min(len(s), len(t)) >= 4 * max(len(s), len(t)) > 0:
                    both = int(np.count_nonzero(t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s))
                    ok[i] = 100 * both >= 80 * (len(s) + len(t) - both)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in (a, b)], ["a", "b"])

    own = stored(docs.where("doc_id IS NOT NULL").mapInArrow(tidied(sets), "id long, tokens binary"), "uncompressed")
    x = own.select(F.col("id").alias("a"), F.col("tokens").alias("x"))
    y = own.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    out = stored(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(tidied(check), "a long, b long").distinct())
    discard(own)
    return out


def _broken(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components. found: node, component."""
    left, right = (found.select(F.col("node").alias(k), F.col("component").alias(f"c{k}")) for k in "ab")
    x = pairs.join(left, "a", "left").join(right, "b", "left")
    return stored(x.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"))


def _unsettled(lists: DataFrame, broken: DataFrame | None) -> DataFrame:
    """sig, rep, n of the lists (kind 0) of which a document may lie in another component than the first; of all lists, if broken is None."""
    bits = lists.sparkSession.sparkContext.broadcast(None if broken is None else _filter(broken, _pair_hash))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                x = np.frombuffer(blob.as_buffer(), np.int64).reshape(-1, 3)
                at = np.flatnonzero(_firsts(x[:, 0]))
                size = np.diff([*at, len(x)])
                if bits.value is not None:
                    pivot = x[np.repeat(at, size)]
                    other = _has(bits.value, _pair_hash(pivot[:, 1], x[:, 1])) | ~alike(pivot[:, 2], x[:, 2])
                    other[at] = False
                    x = x[np.repeat(np.logical_or.reduceat(other, at), size)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, k])) for k in range(3)], ["sig", "rep", "n"])

    return lists.where("kind = 0").select("blob").mapInArrow(tidied(run), "sig long, rep long, n long")


def _in_components(members: DataFrame, found: DataFrame | None) -> DataFrame:
    """members with the component of rep."""
    if found is None:
        return members.withColumn("component", F.col("rep"))
    return members.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _apart(flat: DataFrame) -> DataFrame:
    """The rows of flat, a stored table, whose lists span components."""
    spread = stored(flat.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("sig"))
    return flat.join(spread, "sig", "left_semi")


def _hot_units(hot: DataFrame, sizes: DataFrame) -> DataFrame:
    """hot: sig, rep, n, component, seek of long lists. unit, side, rep, n, component, seek: each document of long lists in all units where it is to be compared. A unit is two blocks of a list, of one class of
    sizes or of two neighbouring ones; in a unit of two blocks, side 0 is compared with side 1; in one of a single block (side 2), all with all."""
    x = hot.join(sizes, "sig").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    x = x.withColumn("class", F.floor(F.log("n") / F.log(F.lit(1.26)))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    unit = lambda c, kind, a, b: F.xxhash64("sig", c, F.lit(kind), a, b)
    b, o, c = F.col("block"), F.col("other"), F.col("class")
    ways = F.array(
        F.struct(unit(c, 0, F.least(b, o), F.greatest(b, o)).alias("unit"), F.when(b == o, 2).when(b < o, 0).otherwise(1).cast("long").alias("side")),
        F.struct(unit(c, 1, b, o).alias("unit"), F.lit(0).cast("long").alias("side")), F.struct(unit(c - 1, 1, o, b).alias("unit"), F.lit(1).cast("long").alias("side")),
    )
    return x.select("rep", "n", "component", "seek", F.inline(ways)).select(*MEMBER)


MEMBER = ["unit", "side", "rep", "n", "component", "seek"]


def _members(flat: DataFrame, sizes: DataFrame | None) -> DataFrame:
    """flat: sig, rep, n, component, hot, a stored table. MEMBER for each document of a list; seek: whether the list is one of SEEK of the document's."""
    nth = F.row_number().over(Window.partitionBy("rep").orderBy(F.xxhash64("sig")))
    x = stored(flat.withColumn("seek", (nth <= SEEK).cast("long")))
    out = x.where("NOT hot").select(F.col("sig").alias("unit"), F.lit(2).cast("long").alias("side"), *MEMBER[2:])
    return out if sizes is None else out.unionByName(_hot_units(x.where("hot"), sizes))


def _across(members: DataFrame, nearest: bool) -> DataFrame:
    """members: MEMBER, parities. Distinct pairs (a < b) of a unit that lie in different components and may link: all, or, for each document that
    seeks, the one whose other end differs least from it."""
    buckets = BUCKETS // 2 * partitions(members.sparkSession)
    width = len(MEMBER) + PARITY // 64

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, total = [], 0

        def flush() -> pa.RecordBatch:
            columns = np.concatenate(parts).T
            return _scatter(np.ascontiguousarray(columns[0]).view(np.uint64), list(columns), buckets)

        for batch in batches:
            if len(batch):
                words = np.stack([folded(np.frombuffer(x.as_buffer(), np.int64)) for x in batch.column(len(MEMBER))])
                parts.append(np.concatenate([np.stack([np.asarray(c, dtype=np.int64) for c in batch.columns[:-1]], axis=1), words], axis=1))
                total += len(batch)
                if total > FLUSH // 4:
                    yield flush()
                    parts, total = [], 0
        if total:
            yield flush()

    def candidates(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs of rows of one unit, some at a time. Units of equal size go together."""
        at = np.flatnonzero(_firsts(x[:, 0]))
        size = np.diff([*at, len(x)])
        for m in np.unique(size[size > 1]).tolist():
            own = at[size == m]
            if m > 64:
                for first in own.tolist():
                    for i in range(first, first + m - 1):
                        yield np.full(first + m - 1 - i, i), np.arange(i + 1, first + m)
                continue
            i, j = np.triu_indices(m, 1)
            some = max(1, (1 << 15) // len(i))
            for k in range(0, len(own), some):
                part = own[k : k + some, None]
                yield (part + i).ravel(), (part + j).ravel()

    def allowed(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of those, the pairs that may link, and their differences in parities."""
        side, n, component, words = x[:, 1], x[:, 3], x[:, 4], x[:, len(MEMBER) :]
        for i, j in candidates(x):
            ok = (component[i] != component[j]) & ((side[i] == 2) | (side[i] != side[j])) & alike(n[i], n[j])
            i, j = i[ok], j[ok]
            d = np.bitwise_count((words[i] ^ words[j]).view(np.uint64)).sum(axis=1, dtype=np.int64)
            ok = 9 * d <= n[i] + n[j]
            yield i[ok], j[ok], d[ok]

    def best(found: list[np.ndarray]) -> np.ndarray:
        """Of rows (seeker, other, difference), the nearest of each seeker."""
        x = np.concatenate(found)
        x = x[np.lexsort((x[:, 1], x[:, 2], x[:, 0]))]
        return x[_firsts(x[:, 0])]

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, total = [np.zeros((0, 2), np.int64)], 0
        for bucket in _by_bucket(batches):
            x = np.concatenate([blob.reshape(-1, width) for blob, _ in bucket])
            x = x[np.lexsort((x[:, 2], x[:, 0]))]
            rep, seek, found, n = x[:, 2], x[:, 5], [np.zeros((0, 3), np.int64)], 0
            for i, j, d in allowed(x):
                if not nearest:
                    pairs.append(np.stack([rep[i], rep[j]], axis=1))
                    total += len(i)
                else:
                    for p, q in ((i, j), (j, i)):
                        own = seek[p] == 1
                        found.append(np.stack([p[own], q[own], d[own]], axis=1))
                        n += len(found[-1])
                    if n > FLUSH:
                        found = [best(found)]
                        n = 0
                if total > FLUSH:
                    pairs = [np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)]
                    total = 0
            if nearest:
                near = best(found)
                pairs.append(np.stack([rep[near[:, 0]], rep[near[:, 1]]], axis=1))
            if sum(map(len, pairs)) > FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(c.copy()) for c in np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0).T], ["a", "b"])
                pairs, total = [pairs[0][:0]], 0
        out = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(c.copy()) for c in out.T], ["a", "b"])

    blobs = members.select(*MEMBER, "parities").mapInArrow(tidied(emit), _BLOBS)
    return _gathered(blobs).mapInArrow(tidied(meet), "a long, b long").distinct()


def _twins(sets: DataFrame, own: DataFrame) -> DataFrame:
    """a, b: the ids that stand for different texts of one id."""
    x = sets.select("doc_id", "h1", "h2").join(own, ["h1", "h2"]).select("doc_id", "rep")
    several = x.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("_hi")).where("a < _hi").select("doc_id", "a")
    return stored(x.join(several, "doc_id").where("a < rep").select("a", F.col("rep").alias("b")).distinct())


def near_components(docs: DataFrame, rare: int = RARE, every_link: bool = False, held: int = HELD) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_shingles, component_id for each row of docs.

    every_link: compare all candidates, not only those between components, and add n_links: the different texts it links to."""
    spark = docs.sparkSession
    lean(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent = spark.sparkContext.broadcast(frequent_tokens(docs, rare))
    signed = stored(_signed(docs, frequent))
    sets = signed.where("n > 0 AND doc_id IS NOT NULL")
    # each set has an id that stands for it everywhere, and one whose row has its signatures
    own = stored(sets.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.min(F.when(F.col("sigs").isNotNull(), F.col("doc_id"))).alias("bearer"), F.max("n").alias("size")))

    def of_sets(column: str) -> DataFrame:
        x = sets.where("sigs IS NOT NULL").select("doc_id", "h1", "h2", column).join(own, ["h1", "h2"])
        return x.where("doc_id = bearer").select("rep", F.col("size").alias("n"), column)

    twins = _twins(sets, own)
    marks = stored(of_sets("parities"))
    lists = stored(_lists(of_sets("sigs"), held))
    pairs = lists.where("kind = 1").select("a", "b")
    sizes = None if _hot(lists).isEmpty() else _hot_sizes(lists, held)
    pairs = stored((pairs if sizes is None else pairs.unionByName(_hot_pairs(lists))).distinct())
    first = stored(_bounded(pairs, marks))
    links = verified(docs, first)
    found = stored(components(links.unionByName(twins)))
    flat = _unsettled(lists, None if every_link else _broken(pairs, found)).withColumn("hot", F.lit(False))
    if sizes is not None:
        flat = flat.unionByName(_hot(lists).withColumn("hot", F.lit(True)))
    flat = stored(flat)
    for nearest in [False] if every_link else [True] * ROUNDS + [False]:
        open_ = _in_components(flat, None) if every_link else _apart(stored(_in_components(flat, found)))
        more = _across(stored(_members(stored(open_), sizes)).join(marks.select("rep", "parities"), "rep"), nearest).join(first, ["a", "b"], "left_anti")
        more = stored(_bounded(stored(more), marks))
        if more.isEmpty():
            continue
        first, new = stored(first.unionByName(more)), verified(docs, more)
        links = stored(links.unionByName(new))
        if not every_link:
            found = stored(components(found.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(new)))
    if every_link:
        found = components(links.unionByName(twins))
    joined = own.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component_id"), "rep")
    extra = ["n_links"] if every_link else []
    if every_link:
        n = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
        joined = joined.join(n, "rep", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    joined = stored(joined)
    discard(own, twins, marks, lists, pairs, flat, first, links, found)
    full = sets.select("doc_id", "n", "h1", "h2").join(joined, ["h1", "h2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", *extra)
    empty = signed.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *[F.lit(0).cast("long").alias(c) for c in extra])
    return full.unionByName(empty)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of linked documents, the one of smallest id stays, with docs' columns, whatever these are called. Rows of
    null id have no links: all stay. Rows of one id go or stay together. Documents without words stay."""
    near = near_components(docs)
    keep = near.where("doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
    own = docs.where("doc_id IS NOT NULL")
    return own.join(keep, own["doc_id"].cast("long") == keep["_id"], "left_semi").unionByName(docs.where("doc_id IS NULL"))


ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) s FROM t),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
links AS (SELECT a.doc_id a, b.doc_id b FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id WHERE 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM t UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT n_shingles, min(r.other) component_id FROM reach r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id
"""
