"""Documents from files, and names and types of stored objects."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.text import clean
from sievework.sources import pdf

#: File types by suffix, and MIME types by suffix.
FILE_TYPES = {".pdf": "pdf", ".docx": "docx", ".txt": "txt", ".md": "md", ".markdown": "md"}
MIME_TYPES = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".doc": "application/msword",
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".markdown": "text/markdown",
    ".json": "application/json",
    ".xml": "application/xml",
    ".csv": "text/csv",
    ".html": "text/html",
    ".htm": "text/html",
}
#: Fixed value: what stands between the pages of a PDF.
PAGE_BREAK = "\n\n--- Page Break ---\n\n"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def file_type(path: Column) -> Column:
    """pdf, docx, txt or md; null for any other suffix."""
    return _lookup(FILE_TYPES, suffix(path))


def mime_type(path: Column) -> Column:
    return F.coalesce(_lookup(MIME_TYPES, suffix(path)), F.lit("application/octet-stream"))


def object_parts(key: Column) -> tuple[Column, Column, Column]:
    """source, document type and file name of an object key; unknown where a part is missing."""
    parts = F.split(key, "/")
    known = lambda i: F.coalesce(F.when((F.size(parts) > i + 1) & (F.get(parts, F.lit(i)) != ""), F.get(parts, F.lit(i))), F.lit("unknown"))
    return known(1), known(2), F.element_at(parts, -1)


def object_key(source: Column, kind: Column, filename: Column, at: Column) -> Column:
    """raw_documents/source/type/stem_time.suffix"""
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    return F.concat(F.lit("raw_documents/"), source, F.lit("/"), kind, F.lit("/"), stem, F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.regexp_extract(filename, r"(\.[^.]*)$", 1))


def store_raw(files: DataFrame, root: str) -> None:
    """Files (source, document_type, key, content) into a store, a folder for each source and type."""
    files.select("source", "document_type", "key", "content").write.mode("append").partitionBy("source", "document_type").parquet(root)


def image_key(document: Column, index: Column, at: Column, content: Column, extension: Column) -> Column:
    return F.concat(document, F.lit("/image_"), index.cast("string"), F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), F.left(F.md5(content), F.lit(8)), F.lit("."), extension)


def listing(objects: DataFrame, source: str | None = None, document_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Objects (key, ...) with source, document_type and filename; filters come before the limit."""
    s, t, f = object_parts(F.col("key"))
    rows = objects.withColumns({"source": s, "document_type": t, "filename": f})
    if source:
        rows = rows.where(F.col("source") == source)
    if document_type:
        rows = rows.where(F.col("document_type") == document_type)
    return rows.orderBy("key").limit(limit) if limit else rows


def search_listing(rows: DataFrame, text: str) -> DataFrame:
    """Case-blind substring of file name, source or type; a blank text keeps all."""
    word = text.strip().lower()
    return rows if not word else rows.where(F.lower("filename").contains(word) | F.lower("source").contains(word) | F.lower("document_type").contains(word))


def decoded(content: Column) -> Column:
    """UTF-8, or Latin-1 where the bytes are not valid UTF-8."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def docx_parts(data: bytes) -> tuple[str, list[list[list[str]]]]:
    """Text (paragraphs, then table rows as 'a | b') and tables of a word-processor file."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{WORD}t"))
    paragraphs = [x for x in map(said, body.findall(f"{WORD}p")) if x.strip()]
    tables = [[["\n".join(map(said, c.iter(f"{WORD}p"))).strip() for c in row.findall(f"{WORD}tc")] for row in t.findall(f"{WORD}tr")] for t in body.findall(f"{WORD}tbl")]
    return "\n\n".join([*paragraphs, *(" | ".join(r) for t in tables for r in t)]), tables


def pdf_text(data: bytes) -> tuple[str, int, dict[str, str]]:
    """Text, pages, and title, author and the like of a PDF; an optional library reads more kinds of text."""
    try:
        from pypdf import PdfReader
    except ImportError:
        pages = pdf.text_of(data)
    else:
        pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]
    return PAGE_BREAK.join(p for p in pages if p.strip()), len(pages), pdf.File(data).about()


EXTRACTED = "path string, file_type string, text string, page_count int, tables array<array<array<string>>>, error string, metadata map<string,string>"


#: Files whose texts a worker holds at a time.
HELD = 64


def extract(files: DataFrame) -> DataFrame:
    """Text and tables of files (path, content): plain text in the JVM, word-processor and PDF files in Python. A file
    that cannot be read has its error and no text; the others are unaffected."""
    rows = files.select("path", file_type(F.col("path")).alias("file_type"), "content")
    none = F.lit(None).cast("array<array<array<string>>>")
    plain = rows.where(F.col("file_type").isin("txt", "md")).select("path", "file_type", decoded(F.col("content")).alias("text"), F.lit(None).cast("int").alias("page_count"), none.alias("tables"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("map<string,string>").alias("metadata"))
    bad = rows.where("file_type IS NULL").select("path", "file_type", F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("page_count"), none.alias("tables"), F.lit("unsupported file type").alias("error"), F.lit(None).cast("map<string,string>").alias("metadata"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (frame[i : i + HELD] for frame in frames for i in range(0, len(frame), HELD)):
            out = []
            for path, kind, content in part.itertuples(index=False):
                try:
                    if kind == "docx":
                        text, tables = docx_parts(content)
                        out.append((path, kind, text, None, tables, None, None))
                    else:
                        text, pages, about = pdf_text(content)
                        out.append((path, kind, text, pages, None, None, about))
                except Exception as e:  # noqa: BLE001  one bad file must not end the scan
                    out.append((path, kind, None, None, None, f"{type(e).__name__}: {e}"[:500], None))
            yield pd.DataFrame(out, columns=["path", "file_type", "text", "page_count", "tables", "error", "metadata"]).astype({"page_count": "Int32"})

    rich = rows.where(F.col("file_type").isin("docx", "pdf")).mapInPandas(run, EXTRACTED)
    return plain.unionByName(rich).unionByName(bad).withColumn("text", clean(F.col("text")))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path, as extract() takes them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", "length", "modificationTime")


