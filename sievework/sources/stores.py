"""Lookups in the stored tables, and writers of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.schemas import deterministic_id


def document(documents: DataFrame, *, id: str | None = None, source_path: str | None = None) -> DataFrame:
    """The document with an id or a path, or no row."""
    return documents.where(F.col("id") == id if id is not None else F.col("source_path") == source_path).limit(1)


def chunks_of(chunks: DataFrame, document_id: str, limit: int | None = None) -> DataFrame:
    rows = chunks.where(F.col("document_id") == document_id).orderBy("chunk_index")
    return rows.limit(limit) if limit else rows


def with_document(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """hits (chunk_id, ...) with the chunk's text and its document's name, type and path where the hit lacks them."""
    facts = chunks.select(F.col("id").alias("chunk_id"), "document_id", F.col("chunk_text").alias("_text"), "chunk_index").join(documents.select(F.col("id").alias("document_id"), "filename", "document_type", "source_path"), "document_id", "left")
    have = [c for c in ("document_id", "chunk_index", "filename", "document_type", "source_path") if c in hits.columns]
    rows = hits.drop(*have).join(facts, "chunk_id", "left")
    text = F.coalesce(F.when(F.col("chunk_text") != "", F.col("chunk_text")), "_text") if "chunk_text" in hits.columns else F.col("_text")
    return rows.withColumn("chunk_text", text).drop("_text")


def chunk_rows(chunked: DataFrame, document_id: str = "document_id") -> DataFrame:
    """Rows of the chunks table from chunking: deterministic ids, offsets and tokens in the metadata."""
    facts = F.create_map(*(x for c in ("start_char_index", "end_char_index", "token_count") for x in (F.lit(c), F.col(c).cast("string"))))
    return chunked.select(deterministic_id(F.col(document_id), F.lit("text"), F.col("chunk_index")).alias("id"), F.current_timestamp().alias("created_at"), F.col(document_id).cast("string").alias("document_id"), "chunk_text", "chunk_index", F.lit("text").alias("chunk_type"), facts.alias("metadata"))


def continued(rows: DataFrame, after: DataFrame, by: str, order: str) -> DataFrame:
    """chunk_index of tables or images, going on after the chunks that a document has already."""
    from pyspark.sql import Window

    start = after.groupBy(by).agg((F.max("chunk_index") + 1).alias("_start"))
    n = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return rows.join(start, by, "left").withColumn("chunk_index", (F.coalesce("_start", F.lit(0)) + n).cast("int")).drop("_start")


def append(df: DataFrame, path: str, *partitions: str) -> None:
    """Parquet append; clustered by the partition columns so that each has few files."""
    writer = (df.repartition(*partitions) if partitions else df).write.mode("append")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def overwrite(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace a table: written beside it first, since it may be what df is read from. The old one is moved aside and goes
    last, so that a crash at any point leaves a whole table, which recover() puts in place."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target, fresh, old = hadoop(path), hadoop(f"{path}.new"), hadoop(f"{path}.old")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    recover(spark, path)
    fs.delete(fresh, True)
    append(df, f"{path}.new", *partitions)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(fresh, target)
    fs.delete(old, True)


def recover(spark: SparkSession, path: str) -> None:
    """Put a table back that overwrite() had moved aside when it was cut off, or take away what it had still to delete."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target, old = hadoop(path), hadoop(f"{path}.old")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(old):
        if fs.exists(target):
            fs.delete(old, True)
        else:
            fs.rename(old, target)
