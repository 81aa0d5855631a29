"""EPUB files: a batch data source with one partition per file range, and a writer.

Files come through Spark's binaryFile reader, so any store that Spark reads will do. A book is read whole in one task.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from verso.cluster import ship
from verso.functions.html import read_document
from verso.functions.text import escape_html
from verso.operators.select import LEAST_CHARS

ITEMS = "book string, title string, author string, pos int, item_id string, filename string, media_type string, properties string, html string, data binary"
UNKNOWN_TITLE, UNKNOWN_AUTHOR = "Unknown Title", "Unknown Author"
_OPF, _DC = "{http://www.idpf.org/2007/opf}", "{http://purl.org/dc/elements/1.1/}"


def parse_epub(book: str, content: bytes) -> list[tuple]:
    """Rows of ITEMS: the documents of the manifest in its order (html set), and its images (data set)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(x.attrib["full-path"] for x in container.iter() if x.tag.endswith("rootfile"))
        package = ElementTree.fromstring(z.read(opf))
        first = lambda tag, default: next((x.text for x in package.iter(_DC + tag) if x.text), default)
        title, author = first("title", UNKNOWN_TITLE), first("creator", UNKNOWN_AUTHOR)
        meta_cover = next((x.attrib.get("content") for x in package.iter(_OPF + "meta") if x.attrib.get("name") == "cover"), None)
        rows, names = [], set(z.namelist())
        for pos, item in enumerate(package.iter(_OPF + "item")):
            name = posixpath.normpath(posixpath.join(posixpath.dirname(opf), item.attrib["href"]))
            kind, props = item.attrib.get("media-type", ""), item.attrib.get("properties", "")
            if name not in names:
                continue
            if item.attrib.get("id") == meta_cover and meta_cover:
                props = f"{props} cover-image".strip()
            if kind in ("application/xhtml+xml", "text/html"):
                rows.append((book, title, author, pos, item.attrib.get("id"), name, kind, props, z.read(name).decode("utf-8", "ignore"), None))
            elif kind.startswith("image/"):
                rows.append((book, title, author, pos, item.attrib.get("id"), name, kind, props, None, z.read(name)))
    return rows


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    """All items of the EPUB files under a path; book is the file's stem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path)
    return epub_items(files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("book"), "content"))


def epub_items(files: DataFrame) -> DataFrame:
    """files: book, content. All items of the books."""
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ITEMS.split(", ")]
        for frame in frames:
            for book, content in zip(frame["book"], frame["content"]):
                yield pd.DataFrame(parse_epub(book, bytes(content)), columns=names)

    return files.mapInPandas(run, ITEMS)


def candidates(items: DataFrame) -> DataFrame:
    """Documents with enough text: book, pos, filename, text, title. Each document is parsed once, in one Python pass."""
    docs = items.where("html IS NOT NULL").select("book", "pos", "filename", "html")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            read = [read_document(h) for h in frame["html"]]
            out = frame[["book", "pos", "filename"]].assign(text=[t for t, _ in read], title=[t for _, t in read])
            yield out[out["text"].map(lambda t: len(t.strip()) >= LEAST_CHARS).astype(bool)]

    return docs.mapInPandas(run, "book string, pos int, filename string, text string, title string")


def metadata(items: DataFrame) -> DataFrame:
    return items.select("book", "title", "author").distinct()


def cover_items(items: DataFrame) -> DataFrame:
    """Rows for operators.select.pick_cover, one per image."""
    return items.where("data IS NOT NULL").select("book", "pos", F.when(F.contains("properties", F.lit("cover-image")), "cover").otherwise("image").alias("kind"), "item_id", F.col("filename").alias("name"), "media_type", "data")


def chapter_html(title, paragraphs):
    """XHTML of a chapter as a Column; title a string column, paragraphs an array of strings."""
    body = F.array_join(F.transform(paragraphs, lambda p: F.concat(F.lit("<p>"), escape_html(p), F.lit("</p>"))), "\n")
    head = F.lit('<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>')
    return F.concat(head, escape_html(title), F.lit("</title></head><body>\n<h1>"), escape_html(title), F.lit("</h1>\n"), body, F.lit("\n</body></html>"))


def build_epub(title: str, author: str, chapters: list[tuple[str, str]]) -> bytes:
    """chapters: (title, xhtml) in order."""
    from xml.sax.saxutils import escape

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        z.writestr("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        files = [f"chapter_{i:02d}.xhtml" for i in range(1, len(chapters) + 1)]
        manifest = "".join(f'<item id="c{i}" href="{f}" media-type="application/xhtml+xml"/>' for i, f in enumerate(files))
        spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(files)))
        z.writestr("OEBPS/content.opf", f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{escape(title)}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:creator>{escape(author)}</dc:creator><dc:language>en</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{manifest}</manifest><spine>{spine}</spine></package>')
        links = "".join(f'<li><a href="{f}">{escape(t)}</a></li>' for f, (t, _) in zip(files, chapters))
        z.writestr("OEBPS/nav.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>Contents</title></head><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>')
        for f, (_, xhtml) in zip(files, chapters):
            z.writestr(f"OEBPS/{f}", xhtml)
    return out.getvalue()


def epub_files(chapters: DataFrame) -> DataFrame:
    """chapters: book, title, author, number, chapter_title, paragraphs. A row (book, content) per book: the bytes of its EPUB file."""
    ship(chapters.sparkSession)
    pages = chapters.select("book", "title", "author", "number", "chapter_title", chapter_html(F.col("chapter_title"), F.col("paragraphs")).alias("xhtml"))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("number")
        return pd.DataFrame({"book": [rows["book"].iloc[0]], "content": [build_epub(rows["title"].iloc[0], rows["author"].iloc[0], list(zip(rows["chapter_title"], rows["xhtml"])))]})

    return pages.groupBy("book").applyInPandas(build, "book string, content binary")


def toc(chapters: DataFrame) -> DataFrame:
    return chapters.select("book", F.row_number().over(W.partitionBy("book").orderBy("number")).alias("entry"), "chapter_title")
