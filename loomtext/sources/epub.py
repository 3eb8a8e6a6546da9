"""EPUB books as DataFrames: one row per document of a book; and books written from chapters."""

from __future__ import annotations

import html
import io
import zipfile
from collections.abc import Iterable
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.sentences import SENTENCE, proxy_tokens, split_sentences
from loomtext.sources.html import html_pieces_strict

_OPF, _CONTAINER = "{http://www.idpf.org/2007/opf}", "{urn:oasis:names:tc:opendocument:xmlns:container}"


def document_names(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, place in the file) of a book's documents in reading order, then of those outside it."""
    package = ET.fromstring(z.read("META-INF/container.xml")).find(f".//{_CONTAINER}rootfile").get("full-path")
    folder = package.rpartition("/")[0]
    opf = ET.fromstring(z.read(package))
    items = {i.get("id"): i for i in opf.iter(f"{_OPF}item")}
    order = [r.get("idref") for r in opf.iter(f"{_OPF}itemref")]
    documents = [k for k in [*order, *items] if k in items and items[k].get("media-type") == "application/xhtml+xml"]
    names = [items[k].get("href") for k in dict.fromkeys(documents)]
    return [(n, f"{folder}/{n}" if folder else n) for n in names]


def spine_documents(book: bytes) -> list[tuple[str, str]]:
    """(name, XHTML) of a book's documents in reading order, then those outside it."""
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        return [(name, z.read(place).decode("utf-8", "replace")) for name, place in document_names(z)]


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """path, chapter_id, title (the document's name), html; a book is read in one task, books in parallel."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for books in batches:
            rows = [(p, k, name, body) for p, content in zip(books["path"], books["content"], strict=True) for k, (name, body) in enumerate(spine_documents(content))]
            yield pd.DataFrame(rows, columns=["path", "chapter_id", "title", "html"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, chapter_id long, title string, html string")


def read_epub_sentences(spark: SparkSession, path: str, tokens=proxy_tokens, pattern: str = SENTENCE) -> DataFrame:
    """path, chapter_id, title, sentence_index, token_count, text of all well-formed documents of a book."""
    body = read_epub(spark, path).withColumn("text", F.array_join(html_pieces_strict("html"), " "))
    each = body.select("path", "chapter_id", "title", F.posexplode(split_sentences(F.col("text"), pattern)).alias("sentence_index", "text"))
    return each.withColumn("token_count", tokens(F.col("text")))


_PAGE = '<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{title}</title></head><body><h1>{title}</h1>{body}</body></html>'


class BookWriter:
    """A book written into an open file a chapter at a time; only the names of earlier chapters are kept."""

    def __init__(self, file, title: str, author: str = "", language: str = "en") -> None:
        self.title, self.author, self.language, self.names = title, author, language, []
        self.zip = zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED)
        self.zip.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        self.zip.writestr("META-INF/container.xml", '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')

    def add(self, name: str | None, text: str | None) -> None:
        """Every non-empty line of text is a paragraph; a null is empty."""
        name = name or ""
        lines = [f"<p>{html.escape(p.strip())}</p>" for p in (text or "").split("\n") if p.strip()]
        self.zip.writestr(f"OEBPS/chapter_{len(self.names)}.xhtml", _PAGE.format(title=html.escape(name), body="".join(lines)))
        self.names.append(name)

    def close(self) -> None:
        title, numbers = html.escape(self.title), range(len(self.names))
        links = "".join(f'<li><a href="chapter_{k}.xhtml">{html.escape(self.names[k])}</a></li>' for k in numbers)
        items = "".join(f'<item id="c{k}" href="chapter_{k}.xhtml" media-type="application/xhtml+xml"/>' for k in numbers)
        refs = "".join(f'<itemref idref="c{k}"/>' for k in numbers)
        self.zip.writestr("OEBPS/nav.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>Contents</title></head><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>')
        self.zip.writestr(
            "OEBPS/content.opf",
            f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{title}</dc:identifier>'
            f"<dc:title>{title}</dc:title><dc:creator>{html.escape(self.author)}</dc:creator><dc:language>{self.language}</dc:language></metadata>"
            f'<manifest><item id="nav" href="nav.xhtml" media-type="text/html" properties="nav"/>{items}</manifest><spine>{refs}</spine></package>',
        )
        self.zip.close()


def epub_bytes(chapters: list[tuple[str, str]], title: str, author: str = "", language: str = "en") -> bytes:
    """One book from (title, text) chapters."""
    out = io.BytesIO()
    book = BookWriter(out, title, author, language)
    for name, text in chapters:
        book.add(name, text)
    book.close()
    return out.getvalue()
