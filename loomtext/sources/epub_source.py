"""Books as a Spark data source: spark.read.format("epub") and df.write.format("epub").

A reading task takes some documents of one large book or many small books, so tasks grow with bytes, not with books; a writing task
holds one chapter at a time. Folders and files may be on any file system that pyarrow knows.
"""

from __future__ import annotations

import hashlib
import uuid
import zipfile
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from loomtext.sources.epub import BookWriter, document_names

READ_SCHEMA = "path string, chapter_id long, title string, html string"
WRITE_COLUMNS = ("book", "chapter_id", "title", "text")
BYTES_PER_TASK = 8 << 20
#: Small books are put together to about so many tasks, of 1 / LEAST of the bytes of a task at least and a task's bytes at most.
TASKS, LEAST = 256, 32


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Documents(InputPartition):
    """Shares (path, part, parts): the documents of a book whose place lies in the share part of parts."""

    shares: list[tuple[str, int, int]]


class EpubReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.path, self.size = options["path"], int(options.get("bytesPerTask", BYTES_PER_TASK))

    def partitions(self) -> list[InputPartition]:
        """Files are listed, not opened: a book of so many bytes is so many partitions, and small books share one."""
        store, at = file_system(self.path)
        found = store.get_file_info(at)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(".epub") and not any(p.startswith(("_", ".")) for p in f.path[len(at) :].split("/"))]
        full = min(self.size, max(self.size // LEAST, sum(f.size for f in files) // TASKS))
        out, held = [], full
        for f in sorted(files, key=lambda f: f.path):
            n = max(1, -(-f.size // self.size))
            for k in range(n):
                if held + f.size // n > full:
                    out.append(Documents([]))
                    held = 0
                out[-1].shares.append((f.path, k, n))
                held += f.size // n
        return out

    def read(self, partition: Documents) -> Iterator[tuple]:
        store, _ = file_system(self.path)
        for path, part, parts in partition.shares:
            with store.open_input_file(path) as file:
                try:
                    with zipfile.ZipFile(file) as z:
                        names = document_names(z)
                        first, last = (len(names) * k // parts for k in (part, part + 1))
                        for k in range(first, last):
                            yield path, k, names[k][0], z.read(names[k][1]).decode("utf-8", "replace")
                except (zipfile.BadZipFile, KeyError, AttributeError, SyntaxError) as e:
                    raise ValueError(f"{path} is no EPUB: {e}") from e


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


def file_name(book: str) -> str:
    """A name of at most 200 bytes; two books never have the same."""
    name = quote(book, safe=" ")
    return f"{name}.epub" if len(name) <= 150 and not name.startswith((".", "_")) else f"book {name[:100]}-{hashlib.sha256(book.encode()).hexdigest()[:40]}.epub"


class EpubWriter(DataSourceWriter):
    """Tasks write to folders of their own; only a commit of all of them puts the books in their places."""

    def __init__(self, options: Mapping[str, str], schema: StructType, overwrite: bool) -> None:
        missing = [c for c in WRITE_COLUMNS if c not in schema.names]
        if missing:
            raise ValueError(f"columns missing: {', '.join(missing)}")
        self.path, self.overwrite, self.author, self.language = options["path"], overwrite, options.get("author", ""), options.get("language", "en")
        self.run = f"_writing-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        store, at = file_system(self.path)
        folder, names, book, file, title = f"{at}/{self.run}/{uuid.uuid4().hex}", [], None, None, None
        store.create_dir(folder, recursive=True)
        seen: set[str] = set()
        for row in rows:
            if row["book"] is None:
                raise ValueError("a chapter without a book")
            if book is None or row["book"] != title:
                if book is not None:
                    book.close()
                    file.close()
                title = row["book"]
                if title in seen:
                    raise ValueError(f"chapters of {title!r} do not follow one another: use write_books")
                seen.add(title)
                names.append(file_name(title))
                file = store.open_output_stream(f"{folder}/{names[-1]}")
                book = BookWriter(file, title, self.author, self.language)
            book.add(row["title"], row["text"])
        if book is not None:
            book.close()
            file.close()
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = file_system(self.path)
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("a book's chapters are in several tasks: use write_books")
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
                if old.type == fs.FileType.File and old.path.endswith(".epub"):
                    store.delete_file(old.path)
        for m in done:
            for n in m.names:
                store.move(f"{m.folder}/{n}", f"{at}/{n}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, at = file_system(self.path)
        if store.get_file_info(f"{at}/{self.run}").type != fs.FileType.NotFound:
            store.delete_dir(f"{at}/{self.run}")


class EpubSource(DataSource):
    """Reading: path, a file or a folder, and bytesPerTask. Writing: path, a folder, and author, language."""

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> EpubReader:
        return EpubReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> EpubWriter:
        return EpubWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EpubSource)


def write_books(chapters: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    """A file for each book in the folder path. chapters: book, chapter_id, title, text; other columns are left out.

    Chapters are in order of chapter_id, equal ones in order of title and text; a book is written in one task. A file of a book that is
    there already is replaced, with mode "overwrite" all others go. A null title or text is empty, a null book is refused.
    """
    register(chapters.sparkSession)
    rows = chapters.select(*WRITE_COLUMNS).repartition("book").sortWithinPartitions(*WRITE_COLUMNS)
    rows.write.format("epub").mode(mode).options(**options).save(path)


def read_books(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """path, chapter_id (the place in reading order), title (the document's name), html of all books in a file or folder."""
    register(spark)
    return spark.read.format("epub").options(**options).load(path)
