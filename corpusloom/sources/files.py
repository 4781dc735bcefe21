"""Text, EPUB and HTML files, and the readers' registry."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

# Encodings in the order they are tried; tags that are blocks, and tags that are dropped.
ENCODINGS = ("utf-8-sig", "utf-8", "utf-16", "latin-1")
BLOCKS = {"p", "div", "blockquote", "li", "td"}
DROPPED = {"script", "style", "head", "nav"}
HEADS = {"h1", "h2", "h3", "h4"}


def decode(data: bytes) -> str:
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except (UnicodeDecodeError, ValueError):
            continue
    raise ValueError("unknown encoding")


class Blocks(HTMLParser):
    """Texts of block elements, each stretch of text once, and the first heading."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.title: str | None = None
        self.open: list[str] = []
        self.text: list[str] = []
        self.head: list[str] | None = None

    def flush(self) -> None:
        joined = " ".join("".join(self.text).split())
        if joined:
            self.blocks.append(joined)
        self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in DROPPED:
            self.open.append(tag)
        if tag in BLOCKS:
            self.flush()
        if tag in HEADS and self.title is None and not self.open:
            self.flush()
            self.head = []
        if tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED and tag in self.open:
            self.open.remove(tag)
        if tag in BLOCKS:
            self.flush()
        if tag in HEADS and self.head is not None:
            self.title = " ".join("".join(self.head).split()) or None
            self.head = None

    def handle_data(self, data: str) -> None:
        if self.open:
            return
        if self.head is not None:
            self.head.append(data)
        else:
            self.text.append(data)


def html_blocks(html: str | None) -> tuple[str | None, list[str]]:
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.title, parser.blocks


def read_html(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Title and blocks of pages, joined by blank lines."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = f"`{key}` {kinds[key]}, title string, n_blocks int, text string"
    ship(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, h in zip(b[key], b[html], strict=True):
                title, blocks = html_blocks(h)
                out.append((k, title, len(blocks), "\n\n".join(blocks)))
            yield pd.DataFrame(out, columns=[key, "title", "n_blocks", "text"])

    return pages.select(key, html).mapInPandas(run, schema)


def read_txt(spark: SparkSession, path: str) -> DataFrame:
    """path, title and text of text files in any of the encodings."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "title": [posixpath.splitext(posixpath.basename(p))[0] for p in b["path"]], "text": [decode(bytes(c)) for c in b["content"]]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, title string, text string")


def epub_sections(data: bytes) -> tuple[dict[str, str | None], list[tuple[str | None, str]]]:
    """Metadata and sections of an EPUB: one for each document of the spine."""
    book = zipfile.ZipFile(io.BytesIO(data))
    container = ElementTree.fromstring(book.read("META-INF/container.xml"))
    place = next(e.attrib["full-path"] for e in container.iter() if e.tag.endswith("rootfile"))
    package = ElementTree.fromstring(book.read(place))
    meta = {e.tag.rpartition("}")[2]: (e.text or "").strip() or None for e in package.iter() if "purl.org/dc/elements" in e.tag}
    items = {e.attrib["id"]: e.attrib["href"] for e in package.iter() if e.tag.endswith("}item")}
    sections = []
    for ref in (e for e in package.iter() if e.tag.endswith("}itemref")):
        name = posixpath.normpath(posixpath.join(posixpath.dirname(place), items[ref.attrib["idref"]]))
        title, blocks = html_blocks(decode(book.read(name)))
        if blocks:
            sections.append((title, "\n\n".join(blocks)))
    if not sections:
        raise ValueError("nothing readable")
    return {k: meta.get(k) for k in ("title", "creator", "publisher", "language", "date")}, sections


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """A row for each section of EPUB files."""
    ship(spark)
    schema = "path string, title string, creator string, publisher string, language string, date string, sect_pos int, section string, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, c in zip(b["path"], b["content"], strict=True):
                meta, sections = epub_sections(bytes(c))
                out += [(p, meta["title"] or posixpath.splitext(posixpath.basename(p))[0], meta["creator"], meta["publisher"], meta["language"], meta["date"], i, t, x) for i, (t, x) in enumerate(sections)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, schema)


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {".txt": read_txt, ".epub": read_epub}


def reader(path: str) -> Callable[[SparkSession, str], DataFrame]:
    """The reader for a path's suffix."""
    suffix = re.search(r"\.\w+$", path)
    found = READERS.get(suffix[0].lower() if suffix else "")
    if found is None:
        raise ValueError(f"no reader for {path}; known: {', '.join(READERS)}")
    return found
