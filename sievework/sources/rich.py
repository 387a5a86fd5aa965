"""Images and tables inside files, and extraction of all three kinds with a status for each."""

from __future__ import annotations

import io
import posixpath
import struct
import zipfile
from collections.abc import Callable, Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.images import image_type
from sievework.functions.tables import is_valid
from sievework.operators import layout
from sievework.session import materialize
from sievework.sources import files, pdf

#: A method takes a file's bytes and returns its tables, rows of cells, header first.
TableMethod = Callable[[bytes], Sequence[list[list[str]]]]


def dimensions(data: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG, GIF or JPEG by its header."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:4] == b"GIF8" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height
            at += 2 + size
    return None


#: Names of a word-processor file's pictures and of what they refer to.
BLIP = "{http://schemas.openxmlformats.org/drawingml/2006/main}blip"
EMBED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}embed"


def docx_images(data: bytes) -> list[tuple[bytes, str]]:
    """Bytes and suffix of each picture of a word-processor file, in the order in which the text shows them, as often as it
    does; where it shows none, all that the file relates to, and where it relates to none, all that it holds by name."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        related = {}
        if "word/_rels/document.xml.rels" in names:
            for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels")):
                target = r.get("Target", "")
                path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"word/{target}")
                if r.get("Type", "").endswith("/image") and path in names:
                    related[r.get("Id")] = path
        shown = []
        if "word/document.xml" in names:
            shown = [related[e.get(EMBED)] for e in ElementTree.fromstring(z.read("word/document.xml")).iter(BLIP) if e.get(EMBED) in related]
        held = sorted(n for n in names if n.startswith("word/media/"))
        return [(z.read(n), n.rsplit(".", 1)[-1].lower()) for n in shown or list(related.values()) or held]


IMAGES = "path string, image_index int, content binary, extension string, width int, height int"
PLACE = ("x0", "y0", "x1", "y1")


def images(found: DataFrame) -> DataFrame:
    """A row for each picture in files (path, content): running number from 1, size, kind and, in PDF files, the page and
    the first place on it (null if the page does not draw it). Files without pictures, or that cannot be read, have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in frame.itertuples(index=False):
                try:
                    pictures = docx_images(content)
                except Exception:  # noqa: BLE001  one bad file must not end the scan
                    pictures = []
                for i, (data, suffix) in enumerate(pictures, 1):
                    width, height = dimensions(data) or (None, None)
                    out.append((path, i, data, suffix, width, height))
            yield pd.DataFrame(out, columns=["path", "image_index", "content", "extension", "width", "height"]).astype({"width": "Int32", "height": "Int32", "image_index": "int32"})

    shown = found.where(files.file_type(F.col("path")) == "docx").select("path", "content").mapInPandas(run, IMAGES)
    order = F.row_number().over(Window.partitionBy("path").orderBy("page", "place")).cast("int")
    drawn = pdf.marks(found, ("image",)).withColumn("image_index", order).select(*shown.columns, "page", F.when(F.col("x0").isNotNull(), F.struct(*PLACE)).alias("position"))
    return shown.unionByName(drawn, allowMissingColumns=True).withColumn("image_type", image_type(F.col("width"), F.col("height")))


def tables(found: DataFrame, pdf_methods: Sequence[tuple[str, TableMethod]] = ()) -> DataFrame:
    """A row for each valid table in files: path, table_index from 1, data, method and, in PDF files, the page where it is
    known. The first PDF method that finds any table of a file wins: those of the caller, then ruled lines, then gaps."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        methods = {"docx": [("docx", lambda d: files.docx_parts(d)[1])], "pdf": list(pdf_methods)}
        for frame in frames:
            out = []
            for path, content in frame.itertuples(index=False):
                for name, method in methods.get(path.lower().rsplit(".", 1)[-1], []):
                    try:
                        got = list(method(content))
                    except Exception:  # noqa: BLE001  the next method may read it
                        got = []
                    if got:
                        out += [(path, i, t, name) for i, t in enumerate(got, 1)]
                        break
            yield pd.DataFrame(out, columns=["path", "table_index", "data", "method"]).astype({"table_index": "int32"})

    rich = found.where(files.file_type(F.col("path")).isin("docx", *(["pdf"] if pdf_methods else []))).select("path", "content")
    got = rich.mapInPandas(run, "path string, table_index int, data array<array<string>>, method string").where(is_valid(F.col("data")))
    rest = found.join(got.select("path").distinct(), "path", "left_anti") if pdf_methods else found
    lying = materialize(pdf.marks(rest, ("word", "rule")))
    seen = layout.tables(lying.where("kind = 'word'"), lying.where("kind = 'rule'"))
    return got.unionByName(seen, allowMissingColumns=True)


def extract_all(found: DataFrame, pdf_methods: Sequence[tuple[str, TableMethod]] = ()) -> DataFrame:
    """Text, number of tables and of images of each file, and a status: a file without readable text has failed; tables
    and images that cannot be read are empty."""
    text = files.extract(found).select("path", "file_type", "text", "page_count", "error")
    n_tables = tables(found, pdf_methods).groupBy("path").agg(F.count("*").alias("n_tables"))
    n_images = images(found).groupBy("path").agg(F.count("*").alias("n_images"))
    zero = F.lit(0).cast("long")
    rows = text.join(n_tables, "path", "left").join(n_images, "path", "left")
    return rows.select("path", "file_type", "text", "page_count", "error", F.coalesce("n_tables", zero).alias("n_tables"), F.coalesce("n_images", zero).alias("n_images"), F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"))

