"""Ids of whole texts equal the library's own, whatever characters they hold."""

import random

import numpy as np

from tracemill.llm import tokens

LETTERS = "aAbÉéßœΣσςİıΐΰ'sStT0123½²ªº×÷¿¡.,;!<|>|́҃­ẞ中ﬁ\u0000\u0085\u001cЖжǅͅ;·ʹ \n\t "


def test_ids_are_the_librarys():
    e = tokens.Encoder(tokens.tokenizer_path())
    r = random.Random(1)
    texts = ["", None, " \n", "it's WE'LL x" + "a" * 5000, "<|endoftext|> <|ENDOFTEXT|>"]
    for _ in range(5000):
        x = "".join(r.choice(LETTERS) for _ in range(r.randrange(1, 30)))
        texts.append(x + "<|endoftext|>" + x if r.random() < 0.05 else x)
    for text, found in zip(texts, e.encode(texts), strict=True):
        ids = e.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(found, e.kind).tolist() == [*ids, tokens.END], text


def test_table_of_splits_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_SPLITS", 3)
    e = tokens.Encoder(tokens.tokenizer_path())
    twice = e.encode(["one two three four five", "six", "one two three four five"])
    assert twice[0] == twice[2] and len(e.splits) <= 6
