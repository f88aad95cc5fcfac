"""Quality rules: a suffix array over each text's words, its longest-common-prefix intervals, and limits on what repeats.

The verdict of the method: a text goes if repeats of LEAST words or more cover over MAX_COVERED of its words, or if its longest
repeat is over MAX_LONGEST words or over MAX_LONGEST_SHARE of the text (and LEAST_LONGEST words). A second rule of its own, on
symbols, catches junk that doesn't repeat. rejected_by names the first rule that a text breaks: base, covered, longest, symbols.

Null or empty text: no words, so it fails the base rule (under 20 words). Repeated rows are judged alike. An empty table gives no
rows. A text of any length is one chunk of its own; memory is about 200 bytes a word of the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, lean, mixed, raw, table, tidy, words

WINDOW = 8  # words of the windows of the base rule
LEAST = 4  # words of the shortest repeat that the method counts
MAX_COVERED = 0.3  # of a kept text's words that may lie in repeats
MAX_LONGEST = 50  # words of the longest repeat that a kept text may have ...
MAX_LONGEST_SHARE = 0.15  # ... and its largest share of the text, ...
LEAST_LONGEST = 8  # ... if it has more words than these
MAX_SYMBOLS = 0.3  # symbols to a word
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by prefix doubling; only suffixes that still tie are sorted again.

    ids: a sequence of integers. Also returns, for k = 0, 1, ..., the classes of equal prefixes of 2^k items."""
    n = len(ids)
    sa = np.argsort(ids, kind="stable")
    ordered = ids[sa]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if n else np.zeros(0, bool)
    rank = np.zeros(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else 0
    levels, k = [rank.copy()], 1
    tied = np.flatnonzero(~(first & np.concatenate([first[1:], [True]]))) if n else np.zeros(0, np.int64)
    while len(tied):
        own = sa[tied]
        after = rank[np.minimum(own + k, n)]
        order = np.lexsort((after, rank[own]))
        own, after, group = own[order], after[order], rank[own[order]]
        first = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        sa[tied] = own
        rank[own] = np.maximum.accumulate(np.where(first, tied, 0))
        levels.append(rank.copy())
        tied = tied[~(first & np.concatenate([first[1:], [True]]))]
        k *= 2
    return sa, levels


def lcp_array(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """lcp[t]: items that suffixes sa[t-1] and sa[t] share at their start; lcp[0] = 0."""
    n = len(sa)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    at = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    i, j = sa[at - 1].copy(), sa[at].copy()
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(i, n)] == levels[k][np.minimum(j, n)]
        step = same.astype(np.int64) << k
        lcp[at] += step
        i += step
        j += step
    return lcp


def lcp_intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, left, right): each maximal run of the suffix array whose suffixes share exactly `length` >= least items."""
    out, stack = [], []
    hot = np.flatnonzero(lcp >= least)
    last = -2
    for t, value in zip(hot.tolist(), lcp[hot].tolist(), strict=True):
        if t != last + 1:
            while stack:
                out.append((*stack.pop(), last))
        left = t - 1
        while stack and stack[-1][0] > value:
            length, left = stack.pop()
            out.append((length, left, t - 1))
        if not stack or stack[-1][0] < value:
            stack.append((value, left))
        last = t
    while stack:
        out.append((*stack.pop(), last))
    return out


def repeats(rows: np.ndarray, h: np.ndarray, n_rows: int, least: int = LEAST, window: int = WINDOW):
    """Per row: words covered by repeats of `window` words or more, and of `least` or more, longest repeat of `least` or more,
    and number of maximal repeats: substrings that no word before or after them follows in all their places.

    rows: the (ascending) row of each word; h: its hash. Words of different rows never match."""
    longest, count = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64)
    if not len(h):
        return longest, longest.copy(), longest.copy(), count
    ids = np.unique(h ^ mixed(rows.astype(np.uint64) + np.uint64(1)), return_inverse=True)[1]
    sa, levels = suffix_array(ids)
    lcp = lcp_array(sa, levels)
    before = np.concatenate([[-1], ids])[sa]  # the word before each suffix; of a row's first, one that its row doesn't have
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    for length, left, right in lcp_intervals(lcp, least):
        r = rows[sa[left]]
        longest[r] = max(longest[r], length)
        count[r] += changes[right] > changes[left]
    span = np.maximum(lcp, np.concatenate([lcp[1:], [0]]))  # the longest interval that a suffix lies in

    def covered(size: int) -> np.ndarray:
        hot = np.flatnonzero(span >= size)
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, sa[hot], 1)
        np.add.at(edge, sa[hot] + span[hot], -1)
        return np.bincount(rows[np.cumsum(edge[:-1]) > 0], minlength=n_rows)

    return covered(window), covered(least), longest, count


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


KINDS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(),
    "n_covered": pa.int64(), "longest_repeat": pa.int64(), "n_repeats": pa.int64(), "rejected_by": pa.string(),
}
NAMES = list(KINDS)
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered long, longest_repeat long, n_repeats long, rejected_by string"


def measure(column: pa.Array, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, max_share: float = MAX_LONGEST_SHARE, max_symbols: float = MAX_SYMBOLS) -> list[pa.Array]:
    """The columns NAMES for a column of texts."""
    data, offsets = raw(column)
    parts = []
    for lo, hi in chunks(offsets):
        own = offsets[lo : hi + 1]
        b, local = data[own[0] : own[-1]], own - own[0]
        starts, ends, rows, h = words(data, own)
        n = np.bincount(rows, minlength=hi - lo)
        chars = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80, dtype=np.int64)])
        word_chars = np.bincount(rows, chars[ends - own[0]] - chars[starts - own[0]], hi - lo).astype(np.int64)
        dup = np.zeros(hi - lo, np.int64)
        for i in range(hi - lo):
            lines = [x for x in b[local[i] : local[i + 1]].tobytes().split(b"\n") if x.strip(b" \t\r\v\f")]
            dup[i] = len(lines) - len(set(lines))
        in_windows, covered, longest, count = repeats(rows, h, hi - lo)
        symbols = _sums(SYMBOLS[b], local)
        broken = {
            "base": (n < 20) | (100 * in_windows > 30 * n), "covered": covered > max_covered * n,
            "longest": (longest > max_longest) | ((longest > LEAST_LONGEST) & (longest > max_share * n)), "symbols": symbols > max_symbols * n,
        }
        rule = np.full(hi - lo, None, object)
        for name in reversed(broken):
            rule[broken[name]] = name
        parts.append([n, word_chars, symbols, dup, in_windows, broken["base"], rule == None, covered, longest, count, rule])  # noqa: E711
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [[]] * len(NAMES)
    return [pa.array(x, k) for x, k in zip(columns, KINDS.values(), strict=True)]


def measured(text: Column, **limits) -> Column:
    """A struct of NAMES. Only the text goes to Python; the row's other columns stay in the JVM."""

    def run(column: pa.Array) -> pa.Array:
        out = pa.StructArray.from_arrays(measure(column, **limits), NAMES)
        tidy()
        return out

    return F.arrow_udf(run, f"struct<{SCHEMA}>").asNondeterministic()(text)


def quality(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, **limits) -> DataFrame:
    """The columns `keep` of df (all, if None) with the measures of each row. A measure whose name is among `keep` has underscores put
    before it until it is new. No shuffle."""
    lean(df.sparkSession)
    keep = list(df.columns if keep is None else keep)
    names = {}
    for c in NAMES:
        names[c] = c
        while names[c] in keep:
            names[c] = "_" + names[c]
    own = df.select(F.struct(*keep).alias("row"), measured(df[text_col], **limits).alias("own"))
    return own.select(*[F.col("row")[c].alias(c) for c in keep], *[F.col("own")[c].alias(names[c]) for c in NAMES])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), keep=["doc_id"])


def filter_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of docs that the rules keep, with their columns, whatever these are called. Null or empty texts go;
    null ids, sources and other columns don't matter, and equal rows go or stay together."""
    lean(spark)
    return docs.where(measured(docs["text"])["kept"])


_WORD = r"[^\x20\x09-\x0D]+"
ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - {LEAST} + 2)) i, w FROM t),
k AS (SELECT doc_id, i, array_to_string(w[i : i + {LEAST - 1}], ' ') s FROM g),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i d FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.s = b.s AND a.i < b.i),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) r FROM pairs),
maximal AS (SELECT doc_id, min(i) i, d, count(*) + {LEAST - 1} n FROM runs GROUP BY doc_id, d, r),
rep AS (SELECT doc_id, max(n) longest_repeat, count(DISTINCT array_to_string(w[i : i + n - 1], ' ')) n_repeats FROM maximal JOIN t USING (doc_id) GROUP BY doc_id),
cov AS (SELECT doc_id, p, max(n) n FROM (SELECT doc_id, n, unnest(range(i, i + n)) p FROM (SELECT doc_id, i, n FROM maximal UNION SELECT doc_id, i + d, n FROM maximal)) GROUP BY doc_id, p),
c AS (SELECT doc_id, count(*) n_covered, count(*) FILTER (n >= {WINDOW}) n_repeat_words FROM cov GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) x FROM t) WHERE regexp_matches(x, '{_WORD}') GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols, coalesce(n_dup_lines, 0)::BIGINT n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT n_repeat_words, coalesce(n_covered, 0)::BIGINT n_covered, coalesce(longest_repeat, 0)::BIGINT longest_repeat, coalesce(n_repeats, 0)::BIGINT n_repeats
  FROM t LEFT JOIN rep USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)),
v AS (SELECT *, CASE WHEN n_words < 20 OR 100 * n_repeat_words > 30 * n_words THEN 'base' WHEN n_covered > {MAX_COVERED}::DOUBLE * n_words THEN 'covered'
  WHEN longest_repeat > {MAX_LONGEST} OR (longest_repeat > {LEAST_LONGEST} AND longest_repeat > {MAX_LONGEST_SHARE}::DOUBLE * n_words) THEN 'longest' WHEN n_symbols > {MAX_SYMBOLS}::DOUBLE * n_words THEN 'symbols' END rejected_by FROM m)
SELECT *, coalesce(rejected_by = 'base', false) base_failed, rejected_by IS NULL kept FROM v
"""
