"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents; the last one returns
the places of all pieces in their sequences. Between stages the rows are written to the shared folder and read again, and
executors give back the memory that the stage before has left free.

Cases: rows without a doc_id pass the filters of stages 1, 3 and 4 unchanged (the quality classifier judges them by
their text like any other); rows that share a doc_id are kept or dropped together by stages 1 and 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import op3_quality, op4_substring, op6_jaccard, op7_language, op8_packing
from sievework.llm.common import materialize, read, release, without


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without letters or without a certain language go."""
    release(spark)
    found = op7_language.identify(op7_language.evidence_of_documents(docs), op7_language.fit(docs))
    return without(docs, found.where(~F.col("accepted")).select("doc_id"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that its neighbours' votes call bad go."""
    release(spark)
    return op3_quality.good(docs, op3_quality.fit(docs, read(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group that links connect, the document with the smallest id stays."""
    release(spark)
    found = op6_jaccard.join(docs)
    return without(docs, found.where("doc_id <> group_id").select("doc_id"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: words of 13-word windows that start in a smaller document go; n_chars is counted anew."""
    release(spark)
    found = op4_substring.dedup(docs, carry=True)
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    whole = found.select("doc_id", F.col("kept").alias("text"), *(f"rest.{c}" for c in rest))
    return whole.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 2048 tokens."""
    release(spark)
    return op8_packing.sequences(docs)


STAGES = [("language ID", language), ("quality classifier", quality), ("n-gram Jaccard join", near_copies), ("substring dedup", passages), ("best-fit packing", packing)]

#: SQL can't express the text model, the classifier or the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
