"""CSS selection over a column of HTML, as one Arrow-batched function.

Spark has no HTML type, so this is the one place where text is parsed in
Python: a page in, the selected text out, with nothing kept between rows. Only
the HTML and the selectors travel to the worker.

Selectors: ``tag``, ``.class``, ``#id``, ``[attr='value']``, ``:nth-child(n)``,
descendant (blank) and child (``>``).
"""

from __future__ import annotations

import functools
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the HTML syntax.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = {"script", "style"}
BLOCK = set(
    """address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul""".split()
)
INLINE_STYLE = set("a b big code em font i nobr s small strike strong tt u".split())
# Start tags that end an open element of the given kinds, up to the given fence.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}

_STEP = re.compile(
    r"""(?P<tag>\*|[A-Za-z][A-Za-z0-9-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)"""
    r"""|\[\s*(?P<attr>[\w-]+)\s*=\s*(?P<q>["'])(?P<val>.*?)(?P=q)\s*\]|:nth-child\(\s*(?P<nth>\d+)\s*\)"""
    r"""|(?P<child>\s*>\s*)|(?P<space>\s+)"""
)


class Node:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag, attrs=(), up=None):
        self.tag, self.attrs, self.kids, self.up = tag, dict(attrs), [], up

    def text(self) -> str:
        return "".join(k if isinstance(k, str) else k.text() for k in self.kids)

    def walk(self):
        for k in self.kids:
            if not isinstance(k, str):
                yield k
                yield from k.walk()


class _Builder(HTMLParser):
    """Tree builder with implied end tags and re-opened style tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.top = Node("")
        self.again: list[Node] = []

    def _close(self, tags, fence):
        """Leave the nearest open element of ``tags``, unless a fence is nearer."""
        at, left = self.top, []
        while at.up is not None and at.tag not in tags:
            if at.tag in fence:
                return False
            left.append(at)
            at = at.up
        if at.up is None:
            return False
        self.top = at.up
        if at.tag in RAW:
            return True
        styles = [n for n in reversed(left) if n.tag in INLINE_STYLE]
        for n in styles:
            same = [m for m in self.again if (m.tag, m.attrs) == (n.tag, n.attrs)]
            if len(same) >= 3:
                self.again.remove(same[0])
            self.again.append(n)
        return True

    def _reopen(self):
        todo, self.again = self.again, []
        for n in todo:
            self._push(n.tag, n.attrs)

    def _push(self, tag, attrs):
        node = Node(tag, attrs, self.top)
        self.top.kids.append(node)
        if tag not in VOID:
            self.top = node

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self._close({"p"}, {"button", "table", "td", "th", "html"})
        elif tag in CLOSES:
            self._close(*CLOSES[tag])
        elif tag not in RAW and tag not in ("html", "head", "body", "tbody", "thead", "tfoot"):
            self._reopen()
        if tag == "tr" and self.top.tag == "table":
            self._push("tbody", ())
        # The first value of a repeated attribute counts.
        self._push(tag, [(k, v or "") for k, v in reversed(attrs)])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in VOID or self._close({tag}, set() if tag in BLOCK else BLOCK - {"p"}):
            return
        for n in reversed(self.again):
            if n.tag == tag:
                self.again.remove(n)
                return

    def handle_data(self, data):
        if self.again and self.top.tag not in RAW | {"html", "head", "table", "tbody", "tr", "ul", "ol"}:
            self._reopen()
        self.top.kids.append(data)


def parse_html(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def escape(text: str) -> str:
    # The references written for characters in text and attributes.
    for raw, ref in (("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("\r", "&#13;")):
        text = text.replace(raw, ref)
    return text


def inner_html(node: Node) -> str:
    out = []
    for k in node.kids:
        if isinstance(k, str):
            out.append(k if node.tag in RAW else escape(k))
            continue
        attrs = "".join(f' {a}="{escape(v)}"' for a, v in reversed(k.attrs.items()))
        if k.tag in VOID:
            out.append(f"<{k.tag}{attrs}/>")
        else:
            out.append(f"<{k.tag}{attrs}>{inner_html(k)}</{k.tag}>")
    return "".join(out)


@functools.lru_cache(maxsize=4096)
def compile_selector(selector: str) -> tuple:
    """Steps from the last to the first: ``(tests, combinator before it)``."""
    steps, tests, link, at = [], [], "", 0
    text = selector.strip()
    while at < len(text):
        m = _STEP.match(text, at)
        if m is None:
            raise ValueError(f"unsupported selector: {selector}")
        at = m.end()
        if m["child"] or m["space"]:
            if not tests:
                raise ValueError(f"unsupported selector: {selector}")
            steps.append((tuple(tests), link))
            tests, link = [], ">" if m["child"] else " "
        elif m["attr"]:
            tests.append(("attr", m["attr"].lower(), m["val"]))
        else:
            kind = m.lastgroup
            value = m[kind].lower() if kind == "tag" else m[kind]
            tests.append((kind, value, None))
    if not tests:
        raise ValueError(f"unsupported selector: {selector!r}")
    steps.append((tuple(tests), link))
    return tuple(reversed(steps))


def _fits(node: Node, tests) -> bool:
    for kind, name, value in tests:
        if kind == "tag":
            ok = name in ("*", node.tag)
        elif kind == "cls":
            ok = name in node.attrs.get("class", "").split()
        elif kind == "id":
            ok = node.attrs.get("id") == name
        elif kind == "attr":
            ok = node.attrs.get(name) == value
        else:
            peers = [k for k in node.up.kids if not isinstance(k, str)]
            ok = int(name) <= len(peers) and peers[int(name) - 1] is node
        if not ok:
            return False
    return True


def _on_path(node: Node, steps, i: int) -> bool:
    if not _fits(node, steps[i][0]):
        return False
    link = steps[i][1]
    if not link:
        return True
    up = node.up
    while up is not None and up.tag:
        if _on_path(up, steps, i + 1):
            return True
        if link == ">":
            return False
        up = up.up
    return False


def find(root: Node, selector: str):
    steps = compile_selector(selector)
    return (n for n in root.walk() if _on_path(n, steps, 0))


def _take(root: Node, selector: str | None, what: str):
    """``text`` and ``html`` of the first match, ``texts`` and ``attr:x`` of all."""
    if what in ("text", "html"):
        first = next(find(root, selector), None) if selector else None
        if first is None:
            return ""
        return first.text() if what == "text" else inner_html(first)
    nodes = find(root, selector) if selector else ()
    if what == "texts":
        return [n.text() for n in nodes]
    attr = what.split(":", 1)[1]
    return [n.attrs[attr] for n in nodes if attr in n.attrs]


def select_html(html: Column | str, wanted: dict[str, tuple[Column | str, str]]) -> Column:
    """A struct with one field per entry of ``wanted``: name -> (selector, what).

    A selector is a column, or a string that is checked here and now.
    """
    names, whats, columns = list(wanted), [w for _, w in wanted.values()], []
    for selector, _ in wanted.values():
        if isinstance(selector, str):
            compile_selector(selector)
            selector = F.lit(selector)
        columns.append(selector)
    types = ["string" if w in ("text", "html") else "array<string>" for w in whats]
    fields = ", ".join(f"{n}: {t}" for n, t in zip(names, types))

    @F.pandas_udf(f"struct<{fields}>")
    def run(pages: pd.Series, *selectors: pd.Series) -> pd.DataFrame:
        rows = []
        for page, *given in zip(pages, *selectors):
            root = parse_html(page or "")
            rows.append([_take(root, s, w) for s, w in zip(given, whats)])
        return pd.DataFrame(rows, columns=names)

    return run(html, *columns)
