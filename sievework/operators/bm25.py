"""BM25 over an inverted index of plain DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import tokens

K1, B = 1.2, 0.75


@dataclass
class Index:
    """postings (term, id, tf, dl), terms (term, df), lengths (id, dl) and totals (n, avgdl; one row). An index that is
    stored and changed is one of segments."""

    postings: DataFrame
    terms: DataFrame
    lengths: DataFrame
    totals: DataFrame


def _terms_and_totals(postings: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    return postings.groupBy("term").agg(F.count("*").alias("df")), lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """Index of docs; documents without tokens count in n and avgdl with length 0."""
    words = docs.select(F.col(key).alias("id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("t")).select("id", "t", F.size("t").alias("dl"))
    postings = words.select("id", "dl", F.explode("t").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
    lengths = words.select("id", "dl")
    terms, totals = _terms_and_totals(postings, lengths)
    return Index(postings, terms, lengths, totals)


def asked_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf."""
    return queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def search_texts(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """query_id, id, score for queries (query_id, query) straight from texts, without an index: only the postings of
    query terms are counted. Repeated query terms count again."""
    asked = asked_terms(queries)
    words = docs.select(F.col(key).alias("id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    totals = words.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"))
    said = words.select("id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    postings = said.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
    # The sum reads tf, so that both uses of the postings share their exchange.
    return _scored(postings, postings.groupBy("term").agg(F.sum(F.least("tf", F.lit(1))).alias("df")), totals, asked)


def search(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, id, score from an index."""
    asked = asked_terms(queries)
    return _scored(index.postings.join(asked.select("term").distinct(), "term", "left_semi"), index.terms, index.totals, asked)


def _scored(postings: DataFrame, terms: DataFrame, totals: DataFrame, asked: DataFrame) -> DataFrame:
    """Scores are rounded to 9 digits, so that they do not depend on the order of their terms."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qtf") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighed = asked.join(terms, "term").crossJoin(F.broadcast(totals))  # totals: one row
    return postings.join(weighed, "term").groupBy("query_id", "id").agg(F.round(F.sum(part), 9).alias("score"))


def top(scored: DataFrame, k: int, *ties: Column | str) -> DataFrame:
    """Each query's k best, with rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *(ties or ("id",)))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_filter(df: DataFrame, conditions: dict[str, str], metadata: str | None = "metadata", strict: bool = True) -> DataFrame:
    """Rows that equal all conditions. `metadata.x` looks into the metadata map. An unknown field matches nothing, or is
    ignored if strict is off."""
    for name, value in conditions.items():
        if name in df.columns:
            df = df.where(F.col(name).cast("string") == F.lit(str(value)))
        elif metadata in df.columns and name.startswith("metadata."):
            df = df.where(F.try_element_at(metadata, F.lit(name[9:])) == F.lit(str(value)))
        elif strict:
            df = df.where(F.lit(False))
    return df
