"""License scan: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard parser evaluates licence expressions.

Expressions come from identifier tags, and from notices: phrases that only an operator and filler words part are one expression ("under
the MIT license or the Apache license"). Of each expression, `permits` is what its labels allow: or takes the best side, and the worst.

Null or empty text: no words, no labels, score 0. Repeated rows are scanned alike. An empty table gives no rows. A text of any length is scanned
in one pass, in memory of a few times its size. Columns but id and text don't matter; an id column called like a result is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import lean, table

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notice phrases that the method adds.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "eclipse public license": "epl",
    "isc license": "isc",
    "artistic license": "artistic",
    "zlib license": "zlib",
    "boost software license": "bsl",
    "european union public license": "eupl",
    "gnu free documentation license": "gfdl",
    "open database license": "odbl",
    "creative commons zero": "cc0",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "public domain": "public-domain",
}
TAG = "spdx license identifier"
#: How much a licence permits, by the first part of its label; others count as UNKNOWN.
PERMITS = {"mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "0bsd": 1.0, "unlicense": 1.0, "cc0": 1.0, "public": 1.0, "mpl": 0.6, "lgpl": 0.6, "epl": 0.6, "gpl": 0.4, "agpl": 0.3, "zlib": 1.0, "bsl": 1.0, "artistic": 0.8, "eupl": 0.5, "odbl": 0.5, "gfdl": 0.4}
UNKNOWN, NONCOMMERCIAL, EXCEPTION = 0.2, 0.1, 0.2
#: Strength of one finding.
SURE, PHRASE, NOTICE, BROKEN = 0.99, 0.9, 0.6, 0.3

_WORD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_EXPRESSION = re.compile(r"(?i)spdx[^0-9a-z\x80-\U0010ffff]+license[^0-9a-z\x80-\U0010ffff]+identifier[ \t]*[:=][ \t]*([^\n\r\"'<>;*]*)")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.:+-]+|\S")
_ORDER = {"OR": 1, "AND": 2, "WITH": 3}
#: Words that may stand beside an operator between two phrases of one expression.
_FILLERS = frozenset(b"the a an either under license licence version v terms of at your option 1 2 3 4 0 1.0 2.0 3.0".split())
_BETWEEN = 6  # words between two phrases of one expression, at most


def label(identifier: str) -> str:
    """The label of an SPDX identifier; Apache-2.0, MIT and CC-BY-NC-* have those of the base phrases."""
    x = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())
    return "cc-by-nc" if x.startswith("cc-by-nc") else "apache-2" if x.startswith("apache-2") else x


def permits(name: str) -> float:
    return NONCOMMERCIAL if "-nc" in name else PERMITS.get(name.split("-")[0], 0.8 if name.startswith("cc-by") else UNKNOWN)


def rpn(expression: str) -> list[str]:
    """Shunting-yard: reverse Polish order of an and/or/with expression. Raises ValueError if it is malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand = True
    for token in _TOKEN.findall(expression):
        word = token.upper()
        if word in _ORDER:
            if operand:
                raise ValueError(f"operand expected before {token}")
            while stack and stack[-1] != "(" and _ORDER[stack[-1]] >= _ORDER[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        elif token == "(":
            if not operand:
                raise ValueError("operator expected before (")
            stack.append(token)
        elif token == ")":
            if operand:
                raise ValueError("operand expected before )")
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError("unbalanced )")
            stack.pop()
        elif not operand or not re.fullmatch(r"[A-Za-z0-9.:+-]+", token):
            raise ValueError(f"unexpected {token}")
        else:
            out.append(token)
            operand = False
    if operand or "(" in stack:
        raise ValueError("incomplete")
    return out + stack[::-1]


def leading(line: str) -> str:
    """The longest valid expression that a line begins with; comment closers, a full stop or prose may follow it. Raises ValueError
    if there is none, or if an operator follows it whose operand is missing."""
    said: list[str] = []
    end, depth, operand = 0, 0, True
    for m in _TOKEN.finditer(line):
        token = m[0] if m[0] in "()" else m[0].rstrip(".:-")
        operator = token.upper() in _ORDER
        if operand:
            fits = token == "(" or (not operator and re.fullmatch(r"[A-Za-z0-9.:+-]+", token))
        else:
            fits = operator or (token == ")" and depth > 0)
        if not fits:
            break
        said.append(token)
        depth += (token == "(") - (token == ")")
        operand = operator or token == "("
        if not operand and not depth:
            end = len(said)
    if not end or (end < len(said) and said[end].upper() in _ORDER):
        raise ValueError("incomplete")
    return " ".join(said[:end])


def evaluate(expression: str) -> tuple[float, set[str]]:
    """How much it permits (or: the best side, and: the worst, with: a little more) and the labels in it."""
    stack: list[tuple[float, set[str]]] = []
    for token in rpn(expression):
        if token == "WITH":
            stack.pop()
            value, names = stack.pop()
            stack.append((min(1.0, value + EXCEPTION), names))
        elif token in _ORDER:
            (y, right), (x, left) = stack.pop(), stack.pop()
            stack.append(((max if token == "OR" else min)(x, y), left | right))
        else:
            stack.append((permits(label(token)), {label(token)}))
    return stack[0]


def automaton(notices: dict[str, str] | None = None) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE), ("notice", NOTICES if notices is None else notices), ("tag", {TAG: ""})):
        for phrase, name in phrases.items():
            a.add_word(f" {phrase} ", (kind, name, phrase.count(" ") + 1))
    a.make_automaton()
    return a


def statements(hits: list[tuple[int, int, str]], found: list[bytes]) -> list[str]:
    """Expressions of the phrases in a text. hits: first word, last word and label of each, in order; a phrase within another is left to it."""
    out: list[list[str]] = []
    last = -1
    for first, end, name in hits:
        if end <= last:
            continue
        between = [x.upper().decode("utf-8", "replace") for x in found[last + 1 : first] if x not in _FILLERS] if out and first > last and first - last <= _BETWEEN + 1 else []
        if len(between) == 1 and between[0] in _ORDER:
            out[-1] += [between[0], name]
        else:
            out.append([name])
        last = end
    return [" ".join(x) for x in out]


def scan(text: str | None, a: ahocorasick.Automaton) -> dict:
    """Every finding in one whole text."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()
    line = f" {b' '.join(found).decode('utf-8', 'surrogatepass')} "
    names, base_names, starts, miss, tags = set(), set(), [], 1.0, False
    hits: list[tuple[int, int, str]] = []
    at, n = 0, 0  # n words stand in the line before at
    for end, (kind, name, size) in a.iter(line):
        n += line.count(" ", at, end)
        at = end
        if kind == "tag":
            tags = True
            continue
        if kind == "base":
            base_names.add(name)
            starts.append(n - size)
        hits.append((n - size, n - 1, name))
        names.add(name)
        miss *= 1 - (PHRASE if kind == "base" else NOTICE)
    hits.sort(key=lambda x: (x[0], -x[1]))
    said = statements(hits, found)
    values = [evaluate(x)[0] for x in said]
    if tags:
        for m in _EXPRESSION.finditer(text):
            said.append(m[1].strip())
            try:
                worth, own = evaluate(leading(m[1]))
            except ValueError:
                miss *= 1 - BROKEN
                continue
            names |= own
            miss *= 1 - SURE
            values.append(worth)
    return {
        "n_words": len(found), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base_names)), "labels": ",".join(sorted(names)), "score": 1 - miss, "permits": min(values, default=None), "expressions": "\n".join(said),
    }


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permits double, expressions string"


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] | None = None) -> DataFrame:
    """One row per row of df: its id and what scan() finds. No shuffle; memory is that of one Arrow batch."""
    if id_col in _ARROW.names:
        raise ValueError(f"the id column is called like a result: {id_col}")
    lean(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(notices)
        for batch in batches:
            rows = [scan(x.as_py(), a) for x in batch.column(1)]
            ids = batch.column(0)
            own = pa.Table.from_pylist(rows, schema=_ARROW) if rows else _ARROW.empty_table()
            for part in own.combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([ids, *part.columns], [id_col, *part.schema.names])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")


_ARROW = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("permits", pa.float64()), ("expressions", pa.string())])


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
