"""Reading HTML pages.

One Arrow function parses a page with the standard library and returns the raw
findings of each cascade step; choosing, cleaning and defaulting happens in
Spark expressions (see ``operators.pages``).  No readability step is applied.
"""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, SparkSession, types as T
from pyspark.sql.functions import pandas_udf

from folioworks.session import bounded_batches

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("p div section article li h1 h2 h3".split())
_SILENT = frozenset("script style noscript template".split())
# Parts of a page that are not content.
_FURNITURE = frozenset("script style noscript nav footer header aside form".split())

FINDINGS = T.StructType([
    T.StructField("titles", T.ArrayType(T.StringType())),
    T.StructField("authors", T.ArrayType(T.StringType())),
    T.StructField("dates", T.ArrayType(T.StringType())),
    T.StructField("keywords", T.StringType()),
    T.StructField("tag_links", T.ArrayType(T.StringType())),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("section", T.StringType()),
    T.StructField("canonical", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("full_text", T.StringType()),
    T.StructField("links", T.ArrayType(T.StringType())),
    T.StructField("media", T.ArrayType(T.StructType([
        T.StructField("tag", T.StringType()), T.StructField("src", T.StringType())]))),
    T.StructField("main_blocks", T.ArrayType(T.StringType())),
])


class _Node:
    __slots__ = ("tag", "attrs", "first", "last", "raw")

    def __init__(self, tag, attrs, first):
        self.tag, self.attrs, self.first, self.last, self.raw = tag, attrs, first, first, []


class Page(HTMLParser):
    """Elements in document order, each knowing its slice of the text pieces."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[_Node] = []
        self.pieces: list[tuple[str, bool]] = []
        self._open: list[_Node] = []
        self._hidden = 0
        self.feed(html)
        self.close()
        while self._open:
            self._shut(self._open.pop())

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs}, len(self.pieces))
        self.nodes.append(node)
        if tag == "br":
            self.pieces.append(("\n", not self._hidden))
        if tag not in _VOID:
            self._open.append(node)
            self._hidden += tag in _FURNITURE

    def handle_endtag(self, tag):
        if any(node.tag == tag for node in self._open):
            while True:
                node = self._open.pop()
                self._shut(node)
                if node.tag == tag:
                    return

    def _shut(self, node):
        if node.tag in _BLOCK:
            self.pieces.append(("\n", not self._hidden))
        self._hidden -= node.tag in _FURNITURE
        node.last = len(self.pieces)

    def handle_data(self, data):
        if self._open and self._open[-1].tag in _SILENT:
            self._open[-1].raw.append(data)
        else:
            self.pieces.append((data, not self._hidden))

    def inside(self, node: _Node) -> str:
        parts = (piece.strip() for piece, _ in self.pieces[node.first:node.last])
        return " ".join(p for p in parts if p)

    def texts(self, wanted) -> list[str]:
        return [self.inside(n) for n in self.nodes if wanted(n)]

    def meta(self, *names: str) -> str | None:
        """Content of the first listed meta name; ``name`` is preferred to ``property``."""
        for name in names:
            for attribute in ("name", "property"):
                for node in self.nodes:
                    if node.tag == "meta" and node.attrs.get(attribute) == name and node.attrs.get("content"):
                        return node.attrs["content"].strip()
        return None

    def linked_data(self, *keys: str) -> list[str]:
        values = []
        for node in self.nodes:
            if node.tag == "script" and node.attrs.get("type") == "application/ld+json":
                try:
                    values += _named(json.loads("".join(node.raw)), keys)
                except (json.JSONDecodeError, RecursionError):
                    continue
        return values


def _named(data, keys) -> list[str]:
    """String values, or the names of objects, under the keys; graphs follow their holder."""
    queue, found = list(data) if isinstance(data, list) else [data], []
    for node in queue:
        if not isinstance(node, dict):
            continue
        if isinstance(node.get("@graph"), list):
            queue.extend(node["@graph"])
        for value in (node.get(key) for key in keys):
            for item in value if isinstance(value, list) else [value]:
                name = item.get("name") if isinstance(item, dict) else item
                if isinstance(name, str):
                    found.append(name)
    return found


def _classes(node: _Node) -> list[str]:
    return node.attrs.get("class", "").split()


def _has_class(name: str):
    return lambda n: name in _classes(n)


def _class_like(part: str):
    return lambda n: part in n.attrs.get("class", "")


# Places a byline is looked for, in order.
_BYLINES = (
    lambda n: "author" in n.attrs.get("rel", "").split(),
    _has_class("author"), _has_class("speaker"), _has_class("byline"),
    lambda n: n.tag == "a" and "/speakers/" in n.attrs.get("href", ""),
    lambda n: n.tag == "a" and "/authors/" in n.attrs.get("href", ""),
    _class_like("byline"), _class_like("author"), _class_like("speaker"),
    lambda n: n.attrs.get("itemprop") in ("author", "creator"),
    lambda n: "data-speaker" in n.attrs or "data-author" in n.attrs,
)


def read_page(html: str) -> dict:
    page = Page("".join(ch for ch in html if ch >= " " or ch in "\t\n\r"))
    tag = lambda name: lambda n: n.tag == name
    first = lambda wanted: page.texts(wanted)[:1]
    times = [n for n in page.nodes if n.tag == "time"][:1]
    bylines = []
    for rule in _BYLINES:
        for node in [n for n in page.nodes if rule(n)][:1]:
            bylines.append(node.attrs.get("data-author") or node.attrs.get("data-speaker") or page.inside(node))
    links = [n.attrs["href"] for n in page.nodes if n.tag == "a" and n.attrs.get("href")]
    return {
        "titles": [
            *first(tag("h1")), page.meta("og:title", "twitter:title"), page.meta("title", "dc.title", "DC.title"),
            *first(tag("title")), *page.linked_data("headline", "name"),
            *first(lambda n: "title" in n.attrs.get("data-testid", "")), *first(_class_like("title"))],
        "authors": [page.meta("author", "article:author", "citation_author", "dc.creator", "DC.creator"),
                    *page.linked_data("author", "creator", "publisher"), None, *bylines],
        "dates": [
            page.meta("article:published_time", "article:modified_time", "date", "pubdate",
                      "citation_publication_date", "dc.date", "DC.date"),
            *page.linked_data("datePublished", "dateCreated", "dateModified", "uploadDate"),
            *(n.attrs.get("datetime") for n in times), *(page.inside(n) for n in times)],
        "keywords": page.meta("keywords", "news_keywords"),
        "tag_links": page.texts(lambda n: (n.tag == "a" and "tag" in n.attrs.get("rel", "").split())
                                or _has_class("tag")(n)),
        "categories": [*first(_has_class("category")), *first(_class_like("category"))],
        "section": page.meta("article:section"),
        "canonical": next((n.attrs.get("href") for n in page.nodes
                           if n.tag == "link" and "canonical" in n.attrs.get("rel", "")), None),
        "text": "\n".join(piece for piece, shown in page.pieces if shown),
        "full_text": "\n".join(p for p in (piece.strip() for piece, _ in page.pieces) if p),
        "links": links,
        "media": [{"tag": n.tag, "src": n.attrs["src"]} for n in page.nodes
                  if n.tag in ("audio", "source", "iframe") and n.attrs.get("src")],
        "main_blocks": page.texts(lambda n: n.tag in ("h2", "h3", "p", "li")),
    }


@pandas_udf(FINDINGS)
def _findings(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(x or "") for x in html], columns=[f.name for f in FINDINGS.fields])


def findings(html: Column) -> Column:
    """The findings of each page; a batch of parsed pages is what a task holds, so batches are small."""
    bounded_batches(SparkSession.active())
    return _findings(html)
