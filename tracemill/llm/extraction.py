"""Main text of web pages by a tree-structured graphical model.

Every element of a page's DOM is a binary variable, content or not. Its own features give its unary potential; a table for
each pair of states, learned too, joins it to its parent. Sum-product messages, passed once upward and once downward, give exact
marginals; texts under an element whose content marginal reaches one half are kept. The model is trained by maximum
likelihood (the same messages give the gradient) on labelled pages, which a seeded generator makes from common layouts.

Null or empty page: empty text. Nothing in a page is capped or dropped but what the model rejects, scripts, styles and markup. Repeated
rows are extracted alike; an empty table gives no rows. Columns but page_id, url and html don't matter. A long page is held by one worker,
with a node of some 500 bytes for each of its elements.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import lean, table
from .dom import BLOCK, Node, parse

TRAINING_PAGES, ROUNDS, RATE, RIDGE, SEED = 300, 80, 1.5, 1e-4, 11
_HINTS = {
    "h:ad": r"\bads?\b|advert|sponsor|promo|banner", "h:nav": r"\bnav|menu|breadcrumb|pagination|\btoc\b|skip", "h:frame": r"header|footer|masthead|copyright|legal",
    "h:side": r"side|\brelated|recommend|widget|popular|trending", "h:notice": r"cookie|consent|gdpr|notice|popup|modal|alert|newsletter|subscribe|signup|login",
    "h:comment": r"comment|disqus|repl(?:y|ies)|respond|discussion", "h:share": r"share|social|follow|tags?\b", "h:main": r"article|content|entry|\bpost\b|story|main|body-?text",
}
_HINT = {k: re.compile(v, re.I) for k, v in _HINTS.items()}
_TAGS = "article main section div p h1 h2 h3 h4 ul ol li dl dd dt table tr td blockquote pre figure figcaption nav header footer aside form button select label title head a b i em strong span body html # details address".split()
FEATURES = {name: i for i, name in enumerate([*(f"t:{t}" for t in _TAGS), "t:other", *_HINTS, "r:ad", "long", "medium", "links", "some links", "bias"])}


def _features(nodes: list[Node], size: list[int], linked: list[int]) -> list[list[int]]:
    out = []
    for i, x in enumerate(nodes):
        f = [FEATURES.get(f"t:{x.tag}", FEATURES["t:other"]), FEATURES["bias"]]
        if x.attributes and x.tag not in ("html", "body"):
            name = f"{x.get('class') or ''} {x.get('id') or ''} {x.get('role') or ''} {x.get('aria-label') or ''}"
            if name.strip():
                f += [FEATURES[k] for k, p in _HINT.items() if p.search(name)]
        if size[i] >= 120:
            f.append(FEATURES["long"])
        elif size[i] >= 25:
            f.append(FEATURES["medium"])
        if size[i] and linked[i] * 2 > size[i]:
            f.append(FEATURES["links"])
        elif linked[i] * 5 > size[i]:
            f.append(FEATURES["some links"])
        out.append(f)
    return out


def tree(root: Node):
    """Elements in document order, index of each one's parent (-1: none), and active features."""
    nodes, parents, stack = [], [], [(root, -1)]
    while stack:
        x, p = stack.pop()
        i = len(nodes)
        nodes.append(x)
        parents.append(p)
        stack.extend((c, i) for c in reversed(x.children) if c.tag)
    size, linked = [0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        size[i] += sum(len(c.text.strip()) for c in nodes[i].children if not c.tag)
        if nodes[i].tag == "a":
            linked[i] = size[i]
        if parents[i] >= 0:
            size[parents[i]] += size[i]
            linked[parents[i]] += linked[i]
    return nodes, parents, _features(nodes, size, linked)


def marginals(unary: list[float], parents: list[int], pair: list[list[float]]):
    """Sum-product on a tree whose parents precede their children. unary: log odds of content; pair[parent state][own state]: log potentials.

    Returns the content marginal of each node, and the joint marginals of (parent, node) summed over all edges."""
    n = len(unary)
    up0, up1 = [0.0] * n, list(unary)  # log of what a subtree says about its root's states
    to0, to1 = [0.0] * n, [0.0] * n  # the message of each node to its parent
    (a, b), (c, d) = pair
    for i in range(n - 1, 0, -1):
        x, y = up0[i], up1[i]
        to0[i], to1[i] = _add(x + a, y + b), _add(x + c, y + d)
        p = parents[i]
        up0[p] += to0[i]
        up1[p] += to1[i]
    out, joint = [0.0] * n, [0.0] * 4
    down0, down1 = [0.0] * n, [0.0] * n
    for i in range(n):
        if i:
            p = parents[i]
            q0, q1 = up0[p] + down0[p] - to0[i], up1[p] + down1[p] - to1[i]  # the parent without this child
            down0[i], down1[i] = _add(q0 + a, q1 + c), _add(q0 + b, q1 + d)
            w = (q0 + a + up0[i], q0 + b + up1[i], q1 + c + up0[i], q1 + d + up1[i])
            most = max(w)
            w = [math.exp(x - most) for x in w]
            all_ = sum(w)
            for k in range(4):
                joint[k] += w[k] / all_
        gap = up0[i] + down0[i] - up1[i] - down1[i]
        out[i] = 1 / (1 + math.exp(min(gap, 700.0)))
    return out, np.array(joint).reshape(2, 2)


def content(unary: list[float], parents: list[int], pair: list[list[float]]) -> list[float]:
    """The marginals alone."""
    n = len(unary)
    up, to = list(unary), [0.0] * n  # log odds suffice: a message's scale doesn't matter
    (a, b), (c, d) = pair
    for i in range(n - 1, 0, -1):
        to[i] = _add(c, up[i] + d) - _add(a, up[i] + b)
        up[parents[i]] += to[i]
    odds = up
    for i in range(1, n):
        q = odds[parents[i]] - to[i]
        odds[i] = up[i] + _add(b, q + d) - _add(a, q + c)
    return [1 / (1 + math.exp(min(-x, 700.0))) for x in odds]


def _add(x: float, y: float) -> float:
    return max(x, y) + math.log1p(math.exp(-abs(x - y)))


class Model:
    def __init__(self, weights: np.ndarray, pair: np.ndarray):
        self.weights, self.pair = weights.tolist(), pair.tolist()

    def scores(self, parents: list[int], features: list[list[int]]) -> list[float]:
        w = self.weights
        return content([sum(w[k] for k in f) for f in features], parents, self.pair)


def train(pages: list[tuple[Node, dict[int, bool]]]) -> Model:
    """pages: a tree, and for each element (by id()) whether it is content. Gradient ascent on the log likelihood, with a ridge."""
    data = []
    for root, labels in pages:
        nodes, parents, features = tree(root)
        y = [int(labels[id(x)]) for x in nodes]
        seen = np.zeros((2, 2))
        for i in range(1, len(y)):
            seen[y[parents[i]], y[i]] += 1
        data.append((parents, features, y, seen))
    w, pair = np.zeros(len(FEATURES)), np.zeros((2, 2))
    sw, sp = np.full_like(w, 1e-6), np.full_like(pair, 1e-6)
    total = sum(len(d[0]) for d in data)
    for _ in range(ROUNDS):
        gw, gp = -RIDGE * w, -RIDGE * pair
        own = w.tolist()
        for parents, features, y, seen in data:
            m, joint = marginals([sum(own[k] for k in f) for f in features], parents, pair.tolist())
            for f, label, p in zip(features, y, m, strict=True):
                for k in f:
                    gw[k] += (label - p) / total
            gp += (seen - joint) / total
        sw += gw**2
        sp += gp**2
        w += RATE * gw / np.sqrt(sw)
        pair += RATE * gp / np.sqrt(sp)
    return Model(w, pair)


def _labels(root: Node) -> dict[int, bool]:
    """By id() of each element, whether it is content; takes the marks out of the tree."""
    labels: dict[int, bool] = {}
    stack = [(root, False)]
    while stack:
        x, inside = stack.pop()
        inside = (inside or x.get("keep") is not None) and x.get("cut") is None
        labels[id(x)] = inside
        x.attributes = re.sub(r"\b(?:keep|cut)\b", "", x.attributes)
        stack.extend((c, inside) for c in x.children if c.tag)
    return labels


def labelled_pages(n: int = TRAINING_PAGES, seed: int = SEED) -> list[tuple[Node, dict[int, bool]]]:
    """Pages of random layouts whose parts are known: an attribute `keep` marks the root of the main text, `cut` what isn't within it."""
    r = random.Random(seed)

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(r.choice("aeioulnrstmd") for _ in range(r.randint(2, 9))) for _ in range(r.randint(lo, hi)))

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k))

    def some(*parts: str) -> str:
        return "".join(x for x in parts if r.random() < 0.5)

    def close(tag: str) -> str:
        return f"</{tag}>" if r.random() < 0.8 else ""

    def block() -> str:
        k = r.random()
        if k < 0.6:
            inner = words(1, 90)
            if r.random() < 0.3:
                inner += f" <a href='/x'>{words(1, 4)}</a> {words(1, 12)}"
            if r.random() < 0.2:
                inner = f"<{(t := r.choice(['b', 'em', 'i', 'strong', 'span']))}>{inner}{close(t)}"
            return f"<p>{inner}{close('p')}"
        if k < 0.7:
            return f"<h{(h := r.randint(2, 4))}>{words(1, 8)}</h{h}>"
        if k < 0.78:
            return "<ul>" + "".join(f"<li>{words(1, 20)}{close('li')}" for _ in range(r.randint(2, 5))) + "</ul>"
        if k < 0.84:
            return f"<blockquote><p>{words(4, 40)}</p></blockquote>"
        if k < 0.89:
            return "<table>" + "".join(f"<tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr>" for _ in range(3)) + "</table>"
        if k < 0.93:
            return f"<pre>{words(3, 20)}</pre>"
        if k < 0.97:
            return f"<figure><img src=a.png><figcaption>{words(2, 10)}</figcaption></figure>"
        return f"<div>{words(3, 60)}</div>"

    out = []
    for _ in range(n):
        nav = r.choice(["<nav cut><ul>{}</ul></nav>", "<nav cut>{}</nav>", "<div cut class='menu'><ul>{}</ul></div>", "<ul cut id='main-nav'>{}</ul>", "<div cut class=breadcrumbs>{}</div>"]).format(links(r.randint(1, 9)))
        head = r.choice([f"<header cut><h1>{words(1, 3)}</h1><p>{words(2, 8)}</p></header>", f"<div cut id='header'>{words(1, 6)}</div>", f"<header cut>{nav}</header>", ""])
        ad = r.choice([f"<div cut class='ad'>{words(3, 14)}</div>", f"<div cut class='advert'><a href='/b'>{words(2, 8)}</a></div>", f"<aside cut class=sponsored><p>{words(4, 30)}</p></aside>", f"<ins cut class='ad-banner'>{words(2, 9)}</ins>"])
        side = r.choice([f"<aside cut><h3>{words(1, 3)}</h3><ul>{links(4)}</ul><p>{words(3, 30)}</p></aside>", f"<div cut class='sidebar'><p>{words(5, 40)}</p><ul>{links(3)}</ul></div>", f"<section cut class='related'><h2>{words(1, 3)}</h2><ul>{links(4)}</ul></section>"])
        notice = r.choice([f"<div cut class='cookie-notice'><p>{words(6, 40)}</p><button>{words(1, 2)}</button></div>", f"<div cut id=consent>{words(5, 30)}</div>", f"<div cut role='alert' class='notice'>{words(3, 25)}</div>", f"<div cut class='newsletter'><p>{words(3, 20)}</p></div>"])
        form = r.choice([f"<form cut><label>{words(1, 3)}</label><input><button>{words(1, 2)}</button></form>", f"<form cut class='search'><select><option>{words(1, 2)}<option>{words(1, 2)}</select></form>"])
        remarks = r.choice(["<section cut class='comments'><h2>{}</h2>{}</section>", "<div cut id='comments'><h3>{}</h3>{}</div>", "<ol cut class='comment-list'><li>{}</li>{}</ol>"]).format(words(1, 3), "".join(f"<div class=comment><p>{words(3, 50)}</p></div>" for _ in range(r.randint(1, 5))))
        foot = r.choice([f"<footer cut><p>{words(3, 20)}</p></footer>", f"<footer cut>&copy; {words(3, 12)}</footer>", f"<div cut class='footer'><ul>{links(3)}</ul>{words(2, 9)}</div>"])
        short = r.random() < 0.3
        blocks = (f"<p>{words(1, 5)}{close('p')}" for _ in range(r.randint(1, 2))) if short else (block() + (some(ad) if r.random() < 0.1 else "") for _ in range(r.randint(1, 9)))
        inner = f"<h1>{words(1, 10)}</h1>" * (r.random() < 0.8) + "".join(blocks) + (some(f"<div cut class='share'>{links(3)}</div>", form, remarks) if r.random() < 0.4 else "")
        main = r.choice(["<article keep>{}</article>", "<article keep>{}</article>", "<main keep>{}</main>", "<div keep class='content'>{}</div>", "<div keep id='post' class='entry-content'>{}</div>", "<main><article keep>{}</article></main>", "<div keep>{}</div>", "<section keep>{}</section>"]).format(inner)
        bare = r.random()
        if bare < 0.25:  # the body itself, or the whole fragment, holds the text
            inner = inner if r.random() < 0.7 else words(1, 60)
            body = some(nav, ad) + inner + some(foot, remarks)
            page = f"<html><body keep>{body}</body></html>" if bare < 0.15 else f"<html keep><head cut><title>{words(1, 6)}</title></head><body>{body}" if bare < 0.2 else body
            root = parse(page)
            if bare >= 0.2:
                root.attributes = "keep"
            out.append((root, _labels(root)))
            continue
        wrap = r.choice(["{}", "<div class=wrapper>{}</div>", "<div id=page><div>{}</div></div>"])
        body = wrap.format(some(notice) + head + some(nav) + some(ad, form) + main + some(side, ad) + some(remarks) + foot + some(notice))
        root = parse(f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title><style>p{{}}</style></head><body>{body}" + "</body></html>" * (r.random() < 0.8))
        out.append((root, _labels(root)))
    return out


@lru_cache(1)
def default_model() -> Model:
    return train(labelled_pages())


def extract(page: str | None, model: Model) -> str:
    """The main text: white space inside a block is one space, and so is the border of two blocks."""
    nodes, parents, features = tree(parse(page))
    kept = {id(x): p >= 0.5 for x, p in zip(nodes, model.scores(parents, features), strict=True)}
    pieces: list[str] = []
    stack: list[Node | str] = [nodes[0]]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            pieces.append(x)
        elif not x.tag:
            if kept[id(x.parent)]:
                pieces.append(x.text)
        elif x.tag in BLOCK:
            pieces.append("\n")
            stack.append("\n")
            stack.extend(reversed(x.children))
        else:
            stack.extend(reversed(x.children))
    return " ".join("".join(pieces).split())


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """pages: page_id, url, html. Returns page_id, url, text, n_chars for each row. No shuffle."""
    lean(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast((lambda m: (m.weights, m.pair))(model or default_model()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*map(np.array, shared.value))
        for batch in batches:
            texts = [extract(x.as_py(), own) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op9_tree_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
