"""HTML on columns, by a small event parser in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements and classes without page content, and the id of the article body where there is one.
NOISE_TAGS = frozenset(["script", "style", "nav", "footer", "header", "aside", "noscript"])
NOISE_CLASSES = frozenset(["mw-jump-link", "mw-editsection", "catlinks", "printfooter", "navbox"])
BODY_ID = "mw-content-text"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Reader(HTMLParser):
    """Text in the whole page and in the article body, title and link targets."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.whole: list[str] = []
        self.body: list[str] | None = None
        self.body_depth: int | None = None
        self.body_done = False
        self.title: str | None = None
        self.title_mixed = False
        self.links: list[str] = []
        self.stack: list[tuple[str, bool]] = []
        self.noise = 0
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named = dict(attrs)
        if tag == "a" and named.get("href") is not None:
            self.links.append(named["href"].strip())
        if self.in_title:
            self.title_mixed = True
        if tag in VOID:
            return
        if self.body is None and named.get("id") == BODY_ID:
            self.body, self.body_depth = [], len(self.stack)
            noisy = False
        else:
            noisy = tag in NOISE_TAGS or not NOISE_CLASSES.isdisjoint((named.get("class") or "").split())
        self.stack.append((tag, noisy))
        self.noise += noisy
        if tag == "title" and self.title is None:
            self.in_title, self.title = True, ""

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.noise -= sum(n for _, n in self.stack[k:])
                del self.stack[k:]
                break
        else:
            return
        if tag == "title":
            self.in_title = False
        if self.body_depth is not None and len(self.stack) <= self.body_depth:
            self.body_done = True

    def handle_data(self, data: str) -> None:
        if self.in_title and self.title is not None:
            self.title += data
        if self.noise:
            return
        self.whole.append(data)
        if self.body is not None and not self.body_done:
            self.body.append(data)


def read(source: str | None) -> _Reader:
    """Parse a page; null is an empty page."""
    r = _Reader()
    r.feed(source or "")
    r.close()
    return r


def page_text(source: str | None) -> str:
    """Text of the article body if there is one, else of the page, without noise; pieces joined by a blank."""
    return _text(read(source))


def _text(r: _Reader) -> str:
    return " ".join(r.whole if r.body is None else r.body)


def _title(r: _Reader) -> str | None:
    return r.title.strip() if r.title and not r.title_mixed else None


@F.pandas_udf(T.StringType())
def html_text(source: pd.Series) -> pd.Series:
    """:func:`page_text` of each page."""
    return pd.Series([page_text(s) for s in source], dtype=object)


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("links", T.ArrayType(T.StringType()))]))
def html_facts(source: pd.Series) -> pd.DataFrame:
    """Title (null without a title element of plain text, or with an empty one) and the targets of all links, in order,
    repeated ones too."""
    pages = [read(s) for s in source]
    return pd.DataFrame({"title": [_title(p) for p in pages], "links": [p.links for p in pages]})


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))
def html_document(source: pd.Series) -> pd.DataFrame:
    """Title and text of each page, as :func:`html_facts` and :func:`html_text` give them, in one reading."""
    pages = [read(s) for s in source]
    return pd.DataFrame({"title": [_title(p) for p in pages], "text": [_text(p) for p in pages]})
