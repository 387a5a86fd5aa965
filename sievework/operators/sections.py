"""Headings, sections and the order of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import despaced

#: What a heading looks like.
HEADINGS = (
    r"^\d+(\.\d+)*\s+[A-Z]",
    r"^Chapter\s+\d+",
    r"^Section\s+\d+",
    r"^Part\s+[IVX\d]+",
    r"^[A-Z][A-Z\s]{8,}$",
    r"^\d+\.\s+[A-Z][a-z]+",
    r"^[A-Z][a-z]+\s+\d+:",
)
UNTITLED, TABLES_TITLE = "Document Content", "Tables"


def heading(text: Column, named: Column | None = None) -> Column:
    """The first of the first three lines that is a heading, at most 100 characters; else the name that metadata gives."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 3), lambda x: despaced(F.trim(x)))
    is_heading = lambda x: (F.length(x) >= 3) & F.array_max(F.array(*(x.rlike(h) for h in HEADINGS)))
    found = F.try_element_at(F.filter(lines, is_heading), F.lit(1))
    return F.left(F.coalesce(found, named) if named is not None else found, F.lit(100))


def assign(chunks: DataFrame, is_heading: Column, by: str, order: str) -> DataFrame:
    """Adds section_index: headings so far, from 0; what stands before a first heading is section 0 too."""
    w = Window.partitionBy(by).orderBy(order)
    flag = F.when(is_heading, 1).otherwise(0)
    first = F.first(flag).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return chunks.withColumn("section_index", (F.sum(flag).over(w) - first).cast("int"))


def titled(chunks: DataFrame, title: Column, by: str, order: str) -> DataFrame:
    """Adds section_index and section_title from a nullable title of each chunk."""
    rows = assign(chunks.withColumn("_title", title), F.col("_title").isNotNull(), by, order)
    within = Window.partitionBy(by, "section_index")
    return rows.withColumn("section_title", F.coalesce(F.min_by("_title", F.when(F.col("_title").isNotNull(), F.col(order))).over(within), F.lit(UNTITLED))).drop("_title")


def place_tables(chunks: DataFrame, by: str, many: int = 3) -> DataFrame:
    """More than `many` tables of a document form a section 'Tables' after the last; fewer, and images, join the last."""
    w = Window.partitionBy(by)
    tables = F.count_if(F.col("chunk_type") == "table").over(w)
    last = F.coalesce(F.max(F.when(F.col("chunk_type") == "text", F.col("section_index"))).over(w), F.lit(0))
    own = (F.col("chunk_type") == "table") & (tables > many)
    index = F.when(F.col("chunk_type") == "text", F.col("section_index")).when(own, last + 1).otherwise(last)
    return chunks.withColumn("section_index", index.cast("int")).withColumn("section_title", F.when(own, F.lit(TABLES_TITLE)).otherwise(F.col("section_title")))


def next_chunks(chunks: DataFrame, by: list[str], order: str, key: str = "chunk_id") -> DataFrame:
    """Edges src, dst from each chunk to the next one of its section."""
    w = Window.partitionBy(*by).orderBy(order)
    return chunks.select(F.col(key).alias("src"), F.lead(key).over(w).alias("dst")).where("dst IS NOT NULL")


def expand(chunks: DataFrame, seeds: DataFrame, before: int, after: int, by: str, order: str, key: str = "chunk_id") -> DataFrame:
    """seed and the chunks up to `before` ahead of it and `after` behind it, with offset; the seed itself is left out."""
    w = Window.partitionBy(by).orderBy(order)
    numbered = chunks.withColumn("_pos", F.row_number().over(w))
    near = seeds.select(F.col(key).alias("seed")).join(numbered.select(F.col(key).alias("seed"), by, F.col("_pos").alias("_at")), "seed")
    wanted = near.select("seed", by, F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset"), "_at").where("offset <> 0").withColumn("_pos", F.col("_at") + F.col("offset"))
    return wanted.join(numbered, [by, "_pos"]).drop("_pos", "_at")


def stride(chunks: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """About `most` chunks of each `by`, evenly spaced: every nth, at most that many."""
    w = Window.partitionBy(by)
    n = F.count("*").over(w)
    at = F.row_number().over(w.orderBy(order)) - 1
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / most))
    rows = chunks.withColumns({"_n": n, "_at": at})
    return rows.where((F.pmod("_at", step) == 0) & (F.floor(F.col("_at") / step) < most)).drop("_n", "_at")


def batches(chunks: DataFrame, by: str, order: str, size: int = 500) -> DataFrame:
    """Long sections in parts: section_id gains _n and the title (cont.) from the second part on."""
    part = F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / size).cast("int")
    rows = chunks.withColumn("_part", part)
    cont = F.col("_part") > 0
    return rows.withColumn("section_id", F.when(cont, F.concat("section_id", F.lit("_"), F.col("_part").cast("string"))).otherwise(F.col("section_id"))).withColumn("section_title", F.when(cont, F.concat("section_title", F.lit(" (cont.)"))).otherwise(F.col("section_title"))).drop("_part")
