"""Counts of call-chains, made of whole traces in Arrow batches: what stats.counted() of spans.with_paths() gives, without a row per span.

Spans of a trace come together (one shuffle by trace_id). A batch of traces is resolved by array operations: parents by a search among sorted keys,
depths by pointer doubling, chains by a walk down the levels in a trie of calls that the task keeps. Only distinct chains leave the task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..llm.common import ARROW_BYTES, lean
from .spans import flagged

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors needn't have this package

UNKNOWN_ROOT = S.UNKNOWN_ROOT.encode()
CALL = ("service", "operation", "call_direction")
OWN = ("trace_id", "span_idx", "span_id", "parent_id", *CALL)
#: What is said of a span's trace, as with_paths(of_trace=True) does.
OF_TRACE = {"root_call": "string", "endpoint": "string", "num_roots": "long", "num_missing": "long"}
AT_ONCE = 1 << 15  # spans that are resolved together, at least; more where a trace is larger
HELD = 1 << 18  # rows and nodes of the trie that a task holds before it counts or emits them
EMITTED = 10_000  # rows of an emitted batch, at most
#: Chains leave a task as texts: bytes between calls, between parts of a call, of null, and the one that begins an escape of these four.
CALLS, PARTS, NULL, ESCAPE = "\x01", "\x02", "\x03", "\x04"
ESCAPES = ((ESCAPE, ESCAPE + "d"), (CALLS, ESCAPE + "a"), (PARTS, ESCAPE + "b"), (NULL, ESCAPE + "c"))


def _part(x: bytes | None) -> bytes:
    if x is None:
        return NULL.encode()
    for a, b in ESCAPES:
        x = x.replace(a.encode(), b.encode())
    return x


def _chain(text: Column) -> Column:
    """The call_chain of a text."""

    def part(x: Column) -> Column:
        out = x
        for a, b in reversed(ESCAPES):
            out = F.replace(out, F.lit(b), F.lit(a))
        return F.when(x != NULL, F.when(F.contains(x, F.lit(ESCAPE)), out).otherwise(x))

    return F.transform(F.transform(F.split(text, CALLS), lambda c: F.split(c, PARTS)), lambda c: F.struct(*[part(F.get(c, F.lit(i))).alias(n) for i, n in enumerate(CALL)]))


def _begins(ids: pa.Array) -> np.ndarray:
    """Where another trace begins; the first row is one."""
    a, b = ids[1:], ids[:-1]
    differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
    return np.concatenate([[True], differ.to_numpy(zero_copy_only=False)])


def _whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole traces; the last trace of a batch waits for the next."""
    ready: list[pa.RecordBatch] = []
    last: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column("trace_id")
        at = int(np.flatnonzero(_begins(ids))[-1])
        if at:
            ready += [*last, b.slice(0, at)]
            last = [b.slice(at)]
        elif last and last[0].column("trace_id")[0].as_py() != ids[0].as_py():
            ready, last = [*ready, *last], [b]
        else:
            last.append(b)
        if sum(x.num_rows for x in ready) >= AT_ONCE:
            yield pa.Table.from_batches(ready).combine_chunks()
            ready = []
    if ready or last:
        yield pa.Table.from_batches([*ready, *last]).combine_chunks()


def _array(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks)


def _encoded(x: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes (-1: null) and what they stand for."""
    d = x.dictionary_encode()
    return pc.fill_null(d.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def _in_order(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """t with each trace's spans in order of span_idx (null first), ties by the rest, and the number of each row's trace."""
    begins = _begins(_array(t, "trace_id"))
    trace = np.cumsum(begins) - 1
    at = _array(t, "span_idx")
    known = np.asarray(at.is_valid())
    v = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not known.all() or not (begins[1:] | (v[1:] > v[:-1])).all():
        order = np.lexsort((v, known, trace))
        a, b = order[1:], order[:-1]
        if ((trace[a] == trace[b]) & (v[a] == v[b]) & (known[a] == known[b])).any():
            rest = [c for c in OWN if c != "trace_id"]
            keys = pa.table({"_t": trace, **{c: t.column(c) for c in rest}})
            order = pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in ["_t", *rest]], null_placement="at_start")
        t = t.take(pa.array(order)).combine_chunks()
    return t, trace


class _Counter:
    """What a task has counted: rows of trie nodes and other keys, with their sums."""

    def __init__(self, keys: list[str], sums: list[str], most: dict[str, int], of_trace: str | None, first: bool, names: list[str]) -> None:
        self.keys, self.sums, self.most, self.of_trace, self.first, self.names = keys, sums, most, of_trace, first, names
        self.by = ["_node", "is_leaf", "rooted", *(["_root"] if {"root_call", "endpoint"} & set(keys) else []), *[k for k in keys if k not in ("root_call", "endpoint")]]
        self.alone = [c for c in (of_trace, "num_missing") if of_trace and c not in keys]  # in rows of traces only
        self.seen = 0
        self.clear()

    def clear(self) -> None:
        self.calls: dict[tuple, int] = {}
        self.nodes: dict[int, int] = {}  # parent's node << 32 | call: node, from 1
        self.rows: list[pa.Table] = []
        self.fresh = 0

    def call_codes(self, t: pa.Table) -> np.ndarray:
        parts = [_encoded(_array(t, c)) for c in CALL]
        both = np.zeros(t.num_rows, np.int64)
        for codes, values in parts:
            both = np.unique(both, return_inverse=True)[1] * (len(values) + 1) + codes + 1
        _, at, back = np.unique(both, return_index=True, return_inverse=True)
        texts = [[*values.cast(pa.binary()).to_pylist(), None] for _, values in parts]
        found = zip(*[[text[c] for c in codes[at].tolist()] for (codes, _), text in zip(parts, texts)])
        return np.array([self.calls.setdefault(x, len(self.calls)) for x in found], np.int64)[back]

    def below(self, parents: np.ndarray, calls: np.ndarray) -> np.ndarray:
        """The nodes of these calls under these nodes."""
        u, back = np.unique(parents << 32 | calls, return_inverse=True)
        nodes = self.nodes
        return np.array([nodes.setdefault(k, len(nodes) + 1) for k in u.tolist()], np.int64)[back]

    def add(self, t: pa.Table) -> None:
        t, trace = _in_order(t)
        n, traces = t.num_rows, int(trace[-1]) + 1
        sizes = np.bincount(trace)
        if (_array(t, "_n").to_numpy()[np.cumsum(sizes) - 1] != sizes).any():
            raise ValueError("spans of a trace don't lie together")
        both, ids = _encoded(pa.concat_arrays([_array(t, "span_id"), _array(t, "parent_id")]))
        key, ref = both[:n], both[n:]
        root = (ref < 0) | (key == ref)
        has, want = np.flatnonzero(key >= 0), np.flatnonzero(~root)
        keys, at = np.unique(trace[has] * len(ids) + key[has], return_index=True)  # of equal keys the first
        sought = trace[want] * len(ids) + ref[want]
        place = np.minimum(np.searchsorted(keys, sought), max(len(keys) - 1, 0))
        hit = keys[place] == sought if len(keys) else np.zeros(len(want), bool)
        up = np.full(n, -1)
        up[want[hit]] = has[at[place[hit]]]
        leaf = np.ones(n, bool)
        leaf[up[up >= 0]] = False
        roots, lost = np.bincount(trace[root], minlength=traces), np.bincount(trace[want[~hit]], minlength=traces)
        call = self.call_codes(t)

        far, depth = up.copy(), (up >= 0).astype(np.int64)
        live = np.flatnonzero(far >= 0)
        for _ in range(int(np.ceil(np.log2(sizes.max() + 1))) + 1):
            q = far[live]
            depth[live] += depth[q]
            far[live] = far[q]
            live = live[far[live] >= 0]  # in the end those whose parents go round
        node, ended = np.zeros(n, np.int64), np.zeros(n, bool)
        flags = {f: _array(t, f).to_numpy(zero_copy_only=False).copy() for f in ("_bad", "_err") if f in t.column_names}
        depth[live] = -1
        order = np.argsort(depth, kind="stable")[len(live) :]
        ends = np.cumsum(np.bincount(depth[order])) if len(order) else []
        self._rounds(live, trace, sizes, up, call, node, flags)
        for level, end in enumerate(ends):
            own = order[ends[level - 1] if level else 0 : end]
            p = up[own]
            node[own] = self.below(node[p] if level else np.zeros(len(own), np.int64), call[own])
            ended[own] = ended[p] if level else root[own]
            for f in flags.values():
                if level:
                    f[own] |= f[p]

        one = roots == 1
        of = {"num_roots": roots, "num_missing": lost}
        of = {k: np.minimum(v, self.most[k]) if k in self.most else v for k, v in of.items()}
        firsts = np.full(traces, -1)
        at = np.flatnonzero(root)[::-1]
        firsts[trace[at]] = at
        of["_root"] = np.where(one, call[firsts], -1)
        given = {"_node": node, "is_leaf": leaf, "rooted": ended & one[trace]}
        cols = {k: given[k] if k in given else of[k][trace] if k in of else t.column(k) for k in self.by}
        cols["count"] = np.ones(n, np.int64)
        cols |= {"path_bad": flags["_bad"].astype(np.int64), "path_err": flags["_err"].astype(np.int64)} if flags else {}
        cols |= {k: t.column(k) for k in self.sums if k not in cols}
        if self.first:
            cols |= {"_seq": np.arange(self.seen, self.seen + n), "trace_id": t.column("trace_id"), "span_idx": t.column("span_idx")}
        own = pa.table(cols)
        if self.of_trace:  # a row per trace, of node 0
            least = pa.table({"_t": trace, self.of_trace: t.column(self.of_trace)}).group_by("_t", use_threads=False).aggregate([(self.of_trace, "min")]).sort_by("_t")[self.of_trace + "_min"]
            for c in self.alone:
                own = own.append_column(c, pa.nulls(n, pa.int64() if c in of else least.type))
            more = {"_node": np.zeros(traces, np.int64), "count": np.ones(traces, np.int64), self.of_trace: least, **of}
            own = pa.concat_tables([own, pa.table({c: more[c] if c in more else pa.nulls(traces, own.schema.field(c).type) for c in own.column_names})])
        self.rows.append(own)
        self.seen += n
        self.fresh += own.num_rows

    def _rounds(self, live: np.ndarray, trace: np.ndarray, sizes: np.ndarray, up: np.ndarray, call: np.ndarray, node: np.ndarray, flags: dict) -> None:
        """Nodes and flags of spans whose parents go round: of as many calls as doubling() has made of them."""
        first = {k: f.copy() for k, f in flags.items()}
        for own in np.split(live, np.flatnonzero(np.diff(trace[live])) + 1) if len(live) else []:
            most = 2 << int(np.ceil(np.log2(sizes[trace[own[0]]] + 1)))
            block = max(1, (1 << 22) // most)
            for i in range(0, len(own), block):
                cur = own[i : i + block]
                way = np.empty((most, len(cur)), np.int64)
                for j in range(most):
                    way[j], cur = cur, up[cur]
                nodes = np.zeros(len(cur), np.int64)
                for j in reversed(range(most)):
                    nodes = self.below(nodes, call[way[j]])
                node[way[0]] = nodes
                for k, f in flags.items():
                    f[way[0]] |= first[k][way].any(axis=0)

    def count(self) -> None:
        """Adds up rows of equal keys."""
        t = pa.concat_tables(self.rows)
        by = [*self.by, *self.alone]
        sums = ["count", *self.sums]
        g = t.group_by(by, use_threads=False).aggregate([*[(c, "sum") for c in sums], *([("_seq", "min")] if self.first else [])])
        g = g.rename_columns([c if c in by else c[:-4] for c in g.column_names])
        if self.first:
            seq = _array(t, "_seq").to_numpy()
            order = np.argsort(seq)
            at = pa.array(order[np.searchsorted(seq, _array(g, "_seq").to_numpy(), sorter=order)])
            g = g.append_column("trace_id", t.column("trace_id").take(at)).append_column("span_idx", t.column("span_idx").take(at))
        self.rows, self.fresh = [g.select(t.column_names).combine_chunks()], 0

    def emitted(self) -> Iterator[pa.RecordBatch]:
        """All rows, with chains as texts, and nothing is held any more."""
        if not self.rows:
            return
        self.count()
        t = self.rows[0]
        above = np.zeros((2, len(self.nodes) + 1), np.int64)
        for k, v in self.nodes.items():
            above[:, v] = k >> 32, k & 0xFFFFFFFF
        up, call = above[0].tolist(), above[1].tolist()
        texts = [PARTS.encode().join(map(_part, c)) for c in self.calls]
        plain = [None if c[0] is None or c[1] is None else c[0] + b"/" + c[1] for c in self.calls] + [UNKNOWN_ROOT]
        turned = bytes.maketrans(b"/\\;:", b"____")
        nodes, first, size = _array(t, "_node").to_numpy().tolist(), 0, 0
        out: list[bytes | None] = []
        for i, start in enumerate(nodes):
            node, way = start, []
            while node:
                way.append(texts[call[node]])
                node = up[node]
            out.append(CALLS.encode().join(reversed(way)) if way else None)
            size += len(out[-1] or b"")
            if len(out) == EMITTED or size > ARROW_BYTES or i + 1 == len(nodes):
                part = t.slice(first, len(out))
                cols = {"_chain": pa.array(out, pa.binary()).view(pa.string())}
                if "_root" in part.column_names:
                    root = _array(part, "_root").to_numpy().tolist()
                    cols["root_call"] = pa.array([plain[r] for r in root], pa.binary()).view(pa.string())
                    cols["endpoint"] = pa.array([None if plain[r] is None else plain[r].translate(turned) for r in root], pa.binary()).view(pa.string())
                if self.first:
                    cols["seen"] = pa.StructArray.from_arrays([_array(part, "trace_id"), _array(part, "span_idx")], ["trace_id", "span_idx"])
                yield pa.RecordBatch.from_arrays([cols[c] if c in cols else _array(part, c) for c in self.names], self.names)
                first, size, out = i + 1, 0, []
        self.clear()


def counted(spans: DataFrame, *by: str, first: bool = False, errors: bool = False, most: dict[str, int] | None = None, of_trace: str | None = None, **sums: Column) -> DataFrame:
    """One row per call_chain, is_leaf, rooted and `by`: count, the sums, and with `first` the least trace_id and span_idx (seen), as
    stats.counted() has them. by: columns of spans, or root_call, endpoint, num_roots and num_missing of their trace, these two no more than `most` says.

    errors: with path_bad and path_err, in how many spans' paths a status isn't 200 or an error was logged. of_trace: there are rows without a
    call_chain too, that count traces by `by` (of traces only), num_missing and the least of this column of their spans."""
    own = [b for b in by if b not in OF_TRACE]
    x = flagged(spans) if errors else spans
    x = x.select(*OWN, *[c for c in own if c not in OWN], *([of_trace] if of_trace else []), *[v.cast("long").alias(k) for k, v in sums.items()], *(["_bad", "_err"] if errors else []))
    x = x.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("trace_id")))  # brings a trace's spans together, and sorts by trace_id
    kinds = {f.name: f.dataType.simpleString() for f in x.schema}
    added = [*(["path_bad", "path_err"] if errors else []), *sums]
    keys = list(dict.fromkeys([*by, *([of_trace, "num_missing"] if of_trace else [])]))
    seen = [("seen", f"struct<trace_id:{kinds['trace_id']},span_idx:{kinds['span_idx']}>")] if first else []
    columns = [("_chain", "string"), ("is_leaf", "boolean"), ("rooted", "boolean"), *[(k, OF_TRACE.get(k) or kinds[k]) for k in keys], *[(k, "long") for k in ("count", *added)], *seen]
    names = [c for c, _ in columns]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(list(by), added, most or {}, of_trace, first, names)
        for t in _whole(batches):
            counter.add(t)
            if counter.fresh >= HELD:
                counter.count()
                if counter.rows[0].num_rows >= HELD:
                    yield from counter.emitted()
            if len(counter.nodes) >= HELD or len(counter.calls) >= HELD:
                yield from counter.emitted()
        yield from counter.emitted()
        pa.default_memory_pool().release_unused()

    lean(spans.sparkSession)
    parts = x.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in columns))
    total = [F.sum(c).alias(c) for c in ("count", *added)] + ([F.min("seen").alias("seen")] if first else [])
    g = parts.groupBy("_chain", "is_leaf", "rooted", *keys).agg(*total)
    return g.select(_chain(F.col("_chain")).alias("call_chain"), *[c for c in g.columns if c != "_chain"])
