"""Queries over what lies on the pages of PDF files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.chunking import sliced
from sievework.plans.common import read
from sievework.sources import files, rich

#: Customers in a file and on a page of it.
FILE, PAGE = 40, 20


def pdf_file(pages: list[str], pictures: list[tuple[str, int, int]] = (), title: str = "") -> bytes:
    """A PDF file with these page contents and pictures (name, width, height) in the resources of every page."""
    n = 5 + len(pictures)  # the first page's number; its contents come next
    kids = " ".join(f"{n + 2 * i} 0 R" for i in range(len(pages)))
    held = " ".join(f"/{p[0]} {5 + i} 0 R" for i, p in enumerate(pictures))
    objects = {
        1: "<< /Type /Catalog /Pages 2 0 R >>",
        2: f"<< /Type /Pages /Count {len(pages)} /Kids [{kids}] /MediaBox [0 0 600 800] /Resources << /Font << /F 3 0 R >> /XObject << {held} >> >> >>",
        3: "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
        4: f"<< /Title ({title}) /Author (nobody) >>",
    }
    for i, (_, width, height) in enumerate(pictures):
        objects[5 + i] = f"<< /Subtype /Image /Width {width} /Height {height} /Filter /DCTDecode /Length 3 >>\nstream\njpg\nendstream"
    for i, body in enumerate(pages):
        objects[n + 2 * i] = f"<< /Type /Page /Parent 2 0 R /Contents {n + 2 * i + 1} 0 R >>"
        objects[n + 2 * i + 1] = f"<< /Length {len(body)} >>\nstream\n{body}\nendstream"
    return ("%PDF-1.4\n" + "".join(f"{k} 0 obj\n{v}\nendobj\n" for k, v in objects.items()) + "trailer << /Root 1 0 R /Info 4 0 R >>\n%%EOF").encode("latin-1")


def _page(title: str, rows: list[list[str]], ruled: bool) -> str:
    said = [f"BT /F 10 Tf 50 760 Td ({title}) Tj ET"]
    said += [f"BT /F 10 Tf {x} {720 - 14 * i} Td ({c}) Tj ET" for i, row in enumerate(rows) for x, c in zip((50, 120, 420), row) if c]
    low = 716 - 14 * (len(rows) - 1)
    said += [f"{x} {low} m {x} 730 l S" for x in (45, 115, 415, 520)] * ruled + [f"45 {730 - 14 * i} m 520 {730 - 14 * i} l S" for i in range(len(rows) + 1)] * ruled
    return "\n".join(said)


def _pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for every 40 customers: pages with a table of 20, ruled in every other file, and two pictures, of which the
    one that is listed first is not drawn; and one that is no PDF file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for key, rows in zip(batch.column("key").to_pylist(), batch.column("rows").to_pylist()):
                cells = [["Key", "Full name", "Owns"], *([r["key"], r["name"], r["owns"]] for r in rows)]
                pages = [_page(f"Customers of part {key}", [cells[0], *cells[i : i + PAGE]], key % 2 == 0) for i in range(1, len(cells), PAGE)]
                pages[0] += f"\nq 100 0 0 50.128 {key % 7} 20 cm /Last Do Q q 10 0 0 10 0 0 cm /Last Do Q"
                out.append((f"in/{key}.pdf", pdf_file(pages, [("First", 300, 300), ("Last", 100 * (key % 30 + 1), 600)], f"part {key}")))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())], ["path", "content"])

    row = F.struct(F.col("c_custkey").cast("string").alias("key"), F.concat("c_name", F.lit(" of "), F.col("c_nationkey").cast("string")).alias("name"), F.when(F.col("c_acctbal") >= 0, F.floor("c_acctbal").cast("string")).otherwise("").alias("owns"))
    told = read(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / FILE).cast("long").alias("key"))
    rows = told.agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("r")))), lambda x: x["r"]).alias("rows"))
    broken = spark.createDataFrame([("in/broken.pdf", bytearray(b"no pages"))], "path string, content binary")
    return rows.mapInArrow(run, "path string, content binary").unionByName(broken)


def pdf_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of every table, by rules or by gaps."""
    found = rich.tables(_pdfs(spark, sf_dir))
    rows = found.select("path", "page", "table_index", "method", F.posexplode("data").alias("row_index", "cells"))
    return rows.select("path", "page", "table_index", "method", "row_index", F.array_join("cells", " | ").alias("cells"))


def pdf_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rich.images(_pdfs(spark, sf_dir))
    return found.select("path", "image_index", "page", "extension", "width", "height", "image_type", *(F.col(f"position.{c}").alias(c) for c in rich.PLACE))


def pdf_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, metadata and how often the text names a customer; a file that cannot be read has failed."""
    found = files.extract(_pdfs(spark, sf_dir))
    return found.select("path", "page_count", F.col("metadata")["title"].alias("title"), F.size(F.split("text", "Customer#")).alias("n_parts"), F.col("error").isNotNull().alias("failed"))


QUERIES = {f.__name__: f for f in (pdf_tables, pdf_images, pdf_texts)}

_C = f"""c AS (SELECT c_custkey // {FILE} AS f, c_custkey AS k, (row_number() OVER (PARTITION BY c_custkey // {FILE} ORDER BY c_custkey) - 1) // {PAGE} AS p,
  c_custkey || ' | ' || c_name || ' of ' || c_nationkey || ' | ' || CASE WHEN c_acctbal >= 0 THEN CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) ELSE '' END AS cells FROM customer)"""

ORACLES = {
    "pdf_tables": f"""WITH {_C}, t AS (SELECT f, p, k, cells FROM c QUALIFY count(*) OVER (PARTITION BY f, p) >= 2 UNION ALL SELECT f, p, -1, 'Key | Full name | Owns' FROM c GROUP BY f, p HAVING count(*) >= 2)
SELECT 'in/' || f || '.pdf' AS path, CAST(p + 1 AS INTEGER) AS page, CAST(p + 1 AS INTEGER) AS table_index, CASE WHEN f % 2 = 0 THEN 'lattice' ELSE 'stream' END AS method,
CAST(row_number() OVER (PARTITION BY f, p ORDER BY k) - 1 AS INTEGER) AS row_index, cells FROM t""",
    "pdf_images": f"""WITH {_C}, s AS (SELECT DISTINCT f, p, i FROM c, (VALUES (1), (2)) AS v(i)),
w AS (SELECT *, CASE WHEN i = 1 THEN 300 ELSE 100 * (f % 30 + 1) END AS width, CASE WHEN i = 1 THEN 300 ELSE 600 END AS height FROM s), z AS (SELECT *, width / height AS r FROM w)
SELECT 'in/' || f || '.pdf' AS path, CAST(2 * p + i AS INTEGER) AS image_index, CAST(p + 1 AS INTEGER) AS page, 'jpg' AS extension, CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) AS height,
CASE WHEN r > 2 OR r < 0.5 THEN 'diagram' WHEN r BETWEEN 0.8 AND 1.2 AND width < 500 THEN 'screenshot' WHEN r BETWEEN 0.8 AND 1.2 OR width BETWEEN 500 AND 2000 THEN 'chart' WHEN width > 2000 THEN 'photo' ELSE 'unknown' END AS image_type,
CASE WHEN i = 2 AND p = 0 THEN CAST(f % 7 AS DOUBLE) END AS x0, CASE WHEN i = 2 AND p = 0 THEN CAST(729.87 AS DOUBLE) END AS y0, CASE WHEN i = 2 AND p = 0 THEN CAST(f % 7 + 100 AS DOUBLE) END AS x1, CASE WHEN i = 2 AND p = 0 THEN CAST(780 AS DOUBLE) END AS y1 FROM z""",
    "pdf_texts": f"""WITH {_C} SELECT 'in/' || f || '.pdf' AS path, CAST(max(p) + 1 AS INTEGER) AS page_count, 'part ' || f AS title, CAST(count(*) + 1 AS INTEGER) AS n_parts, FALSE AS failed FROM c GROUP BY f
UNION ALL SELECT 'in/broken.pdf', NULL, NULL, NULL, TRUE""",
}
