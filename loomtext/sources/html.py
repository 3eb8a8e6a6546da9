"""Text of XHTML and HTML documents, titles, paragraphs."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strict_pieces(html: bytes | str | None) -> list[str]:
    """Text pieces of a well-formed document: each element's text, then its tail, before its descendants; nothing if it is not well formed."""
    try:
        root = ET.fromstring(html or "")
    except ET.ParseError:
        return []
    return [t.strip() for e in root.iter() for t in (e.text, e.tail) if t and t.strip()]


class _Lenient(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.pieces.append(data.strip())


def lenient_pieces(html: str | None) -> list[str]:
    """Visible text pieces of any HTML, in document order."""
    p = _Lenient()
    p.feed(html or "")
    p.close()
    return p.pieces


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_pieces_strict(s: pd.Series) -> pd.Series:
    return s.map(strict_pieces)


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_pieces(s: pd.Series) -> pd.Series:
    return s.map(lenient_pieces)


def title(html: str) -> Column:
    """The title, else the first heading of level 1 or 2; null without either."""
    t = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title>", 1))
    h = F.trim(F.regexp_extract(html, r"(?is)<h[12][^>]*>([^<]*)<", 1))
    return F.when(t != "", t).when(h != "", h)


def escaped(col: str) -> Column:
    """& < > " ' as entities."""
    c = F.replace(F.col(col), F.lit("&"), F.lit("&amp;"))
    for plain, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def paragraphs(col: str) -> Column:
    """Non-empty trimmed lines."""
    return F.filter(F.transform(F.split(F.col(col), "\n"), lambda p: F.trim(p)), lambda p: p != "")
