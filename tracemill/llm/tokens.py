"""Token ids of whole texts by the tokenizers library, each distinct split of a text encoded once.

The tokenizer in use lower-cases, drops white space and splits by a pattern before its model sees a text. For texts of plain
characters that pattern is applied here, and each distinct split goes to the library's model alone. A word of other characters, or
one that holds a special token, takes the library's whole path. Ids of splits are kept in a bounded table of each Python worker.
Null text counts as empty; each document ends with END.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import regex

END = 1
NAME = "word_bpe_49k.json"
KEPT_SPLITS = 300_000  # about 75 MB
LONG_SPLIT = 64  # characters; longer ones are not kept
#: Characters whose normal form, case and class no Unicode version disputes: all below U+0500 but controls, combining accents, and two
#: letters whose lower case depends on their place or is longer.
PLAIN = "!-~\u00a1-\u012f\u0131-\u02ff\u0370-\u03a2\u03a4-\u04ff"
_PLAIN_TEXT = regex.compile(f"[ \\t-\\r{PLAIN}]*+").fullmatch
#: Which units of UTF-16 are such a character that is its own normal form; without combining accents, a text of these is then normal too.
_PLAIN_UNIT = np.array([c < 0x500 and bool(_PLAIN_TEXT(chr(c))) and unicodedata.is_normalized("NFC", chr(c)) for c in range(1 << 16)])


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(NAME)

_ID = attrgetter("id")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: its own where it prints, else the next from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _class(category: str) -> str:
    """The characters of PLAIN of a category, for a pattern's brackets."""
    return "".join(c for c in map(chr, range(0x500)) if unicodedata.category(c).startswith(category) and _PLAIN_TEXT(c))


class _Splits(dict):
    """The ids of lower-cased splits, as bytes; made when first asked for."""

    def __init__(self, model, kind: np.dtype):
        self.model, self.code = model, kind.char
        self.letters = _byte_letters()

    def __missing__(self, split: str) -> bytes:
        named = split if split.isascii() else split.encode().decode("latin-1").translate(self.letters)
        ids = array(self.code, map(_ID, self.model.tokenize(named))).tobytes()
        if len(split) <= LONG_SPLIT:
            self[split] = ids
        return ids


class Encoder:
    """Encodes texts; one for each worker and file."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.end = np.array([END], self.kind).tobytes()
        self.splits = _Splits(self.tokenizer.model, self.kind)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pattern = made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.cut = re.compile(pattern.replace(r"\p{L}", _class("L")).replace(r"\p{N}", _class("N"))).findall
        self.special = tuple(t["content"] for t in made["added_tokens"])

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def rest(self) -> None:
        """Drops the table of splits, which else stays with a reused worker."""
        self.splits.clear()

    def _plain(self, text: str) -> bool:
        return bool(_PLAIN_UNIT[np.frombuffer(text.encode("utf-16-le"), "<u2")].all()) and not any(t in text for t in self.special)

    def _ids(self, text: str) -> bytes:
        if self._plain(text):
            return b"".join(map(self.splits.__getitem__, self.cut(text.lower())))
        words = re.split("[ \t-\r]+", text)
        if len(words) > 1:
            return b"".join([self._ids(w) for w in words])
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, texts: list[str | None], kept: int | None = None) -> list[bytes]:
        """For each text, its ids and END as integers of self.kind. kept: splits whose ids are kept, at most, but for those of one text."""
        out = []
        kept = KEPT_SPLITS if kept is None else kept
        for t in texts:
            if len(self.splits) > kept:
                self.splits.clear()
            t = t or ""
            if not t.isascii():
                t = t.encode("utf-8", "replace").decode()  # lone surrogates
            out.append(self._ids(t) + self.end)
        return out


def encoded(batch: pa.RecordBatch, path: str, column: int = 1, most: int = 2 << 20, kept: int | None = None) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, last row, ids of each) for parts of a batch of about `most` characters."""
    encoder = Encoder.of(path)
    texts, first, size = [], 0, 0
    for i, t in enumerate(batch.column(column)):
        t = t.as_py()
        texts.append(t)
        size += len(t or "")
        if size > most:
            yield first, i + 1, encoder.encode(texts, kept)
            texts, first, size = [], i + 1, 0
    if texts:
        yield first, len(batch), encoder.encode(texts, kept)
