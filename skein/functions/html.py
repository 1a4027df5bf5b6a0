"""Sections, key-value tables and links of a page's HTML, with the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Classes of elements that hold no article text.
NOISE = re.compile("toc|navbox|reflist|reference|mw-editsection|metadata")
_NOISY_TAGS = {"div", "table", "sup", "span"}
_VOID = {"br", "img", "hr", "meta", "link", "input", "wbr", "area", "base", "col", "source", "track", "embed"}
_CLOSED_BY = {"p": {"p", "div", "table", "h2", "h3", "ul", "ol"}, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}


class _Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: _Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def text(self, glue: str = " ") -> str:
        out = []
        stack = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                if n.strip():
                    out.append(n.strip())
            else:
                stack.extend(reversed(n.children))
        return glue.join(out)

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, _Node))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        while self.at.parent and tag in _CLOSED_BY.get(self.at.tag, ()):
            self.at = self.at.parent
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        n = self.at
        while n.parent and n.tag != tag:
            n = n.parent
        if n.parent:
            self.at = n.parent

    def handle_data(self, data):
        if self.at.tag not in ("script", "style"):
            self.at.children.append(data)


def parse(html: str) -> _Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _tree(html: str | _Node | None) -> _Node:
    return html if isinstance(html, _Node) else parse(html or "")


def _content(root: _Node) -> _Node:
    for want in (lambda n: "mw-parser-output" in n.attrs.get("class", ""), lambda n: n.tag == "article", lambda n: n.tag == "body"):
        for n in root.walk():
            if want(n):
                return n
    return root


def sections(html: str | _Node | None) -> list[dict[str, str]]:
    """Sections of the content's direct children: h2 or h3, bare or wrapped, begin one; p gives text."""
    out, heading, text = [], "Introduction", []

    def close() -> None:
        if text:
            out.append({"heading": heading, "text": "\n".join(text)})

    for n in _content(_tree(html)).children:
        if not isinstance(n, _Node) or n.tag in _NOISY_TAGS and NOISE.search(n.attrs.get("class", "")):
            continue
        for inner in [x for x in n.walk() if x.tag in _NOISY_TAGS and NOISE.search(x.attrs.get("class", ""))]:
            if inner.parent:
                inner.parent.children.remove(inner)
        head = n if n.tag in ("h2", "h3") else next((x for x in n.walk() if x.tag in ("h2", "h3")), None) if "mw-heading" in n.attrs.get("class", "") else None
        if head is not None:
            close()
            heading, text = head.text(), []
        elif n.tag == "p" and n.text():
            text.append(n.text())
    close()
    return out


def infobox(html: str | _Node | None) -> dict[str, str]:
    """Rows with a header and a value of the first table whose class names an infobox."""
    out: dict[str, str] = {}
    box = next((n for n in _tree(html).walk() if n.tag == "table" and "infobox" in n.attrs.get("class", "")), None)
    for row in box.walk() if box else ():
        if row.tag == "tr":
            th, td = (next((x for x in row.walk() if x.tag == t), None) for t in ("th", "td"))
            if th and td and th.text():
                out[th.text()] = td.text()
    return out


def _each(f):
    def run(s: pd.Series) -> pd.Series:
        return s.map(f)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return run


def html_sections(c: Column | str) -> Column:
    kind = T.ArrayType(T.StructType([T.StructField("heading", T.StringType()), T.StructField("text", T.StringType())]))
    return F.pandas_udf(_each(sections), kind)(c)


def html_infobox(c: Column | str) -> Column:
    return F.pandas_udf(_each(infobox), T.MapType(T.StringType(), T.StringType()))(c)


def page_parts(c: Column | str) -> Column:
    """struct<sections, infobox> of a page, which is parsed once."""

    def run(s: pd.Series) -> pd.DataFrame:
        trees = [_tree(x) for x in s]
        return pd.DataFrame({"sections": [sections(t) for t in trees], "infobox": [infobox(t) for t in trees]})

    run.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "sections array<struct<heading: string, text: string>>, infobox map<string,string>")(c)
