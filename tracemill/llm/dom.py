"""A forgiving HTML reader: a tree of elements and texts, with the usual implied end tags."""

from __future__ import annotations

import html
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea iframe".split())
FOREIGN = frozenset(["svg", "math"])  # a slash closes these and what they hold, unless an element of HTML_IN stands between
HTML_IN = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html img legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul video audio picture".split())
#: An opening tag of the value's set ends an open element of the key, unless one of LIMIT stands between.
_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS = {
    "p": _P, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "head": frozenset(["body", "article", "div", "p", "nav", "header", "main", "section", "h1"]),
}
LIMIT = frozenset("table ul ol dl div article section main aside nav header footer form blockquote body html figure select fieldset".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_UNQUOTED = re.compile(r"=\s*[^\s\"']+$")  # a slash here belongs to the value
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    """tag "" is a text, whose decoded characters are in text."""

    __slots__ = ("attributes", "children", "parent", "tag", "text")

    def __init__(self, tag: str, parent: Node | None, attributes: str = "", text: str = ""):
        self.tag, self.parent, self.attributes, self.text, self.children = tag, parent, attributes, text, []
        if parent is not None:
            parent.children.append(self)

    def get(self, name: str) -> str | None:
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return None


def _closed(tag: str, attributes: str, parent: Node) -> bool:
    """Whether a tag's own slash closes it."""
    if not attributes.endswith("/") or _UNQUOTED.search(attributes):
        return False
    x = parent
    while tag not in FOREIGN and x is not None and x.tag not in HTML_IN and x.tag not in FOREIGN:
        x = x.parent
    return tag in FOREIGN or (x is not None and x.tag in FOREIGN)


def parse(page: str | None) -> Node:
    """The tree of a page; its root has tag "#". Comments, declarations and the contents of RAW elements are left out."""
    root = now = Node("#", None)
    page = page or ""
    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None or m.start() > at:
            Node("", now, text=html.unescape(page[at : m.start() if m else n]))
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            x = now
            while x is not None and x.tag != tag:
                if x.tag in ("table", "article", "main", "body") and tag not in ("body", "html", "article", "main", "section", "div", "table"):
                    x = None  # a stray inner end tag doesn't close what holds it
                    break
                x = x.parent
            if x is not None and x.parent is not None:
                now = x.parent
            continue
        if tag in BLOCK:
            x = now
            while x.parent is not None:
                if x.tag in ENDS and tag in ENDS[x.tag]:
                    now = x.parent
                if x.tag in LIMIT and x.tag != "head" and now is not x.parent:
                    break
                x = x.parent
        element = Node(tag, now, m[3] or "")
        if _closed(tag, element.attributes, element.parent):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID:  # a slash at the end closes nothing else in HTML
            now = element
    return root
