"""Context for an answer, its citations and how well it is grounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import preview

CITATION = r"(?i)\[Document:\s*([^,]+),\s*Chunk:\s*(\d+)\]"
#: Fixed value: the answer where nothing was found.
NO_CONTEXT = "I don't have enough information to answer this question. No relevant context was found."


def formatted(hits: DataFrame) -> DataFrame:
    """Adds part: a hit as it enters the context, citation first; tables as markdown, images by what is known of them."""
    name, index = F.coalesce("filename", F.lit("unknown")), F.coalesce(F.col("chunk_index").cast("string"), F.lit("0"))
    cite = F.concat(F.lit("[Document: "), name, F.lit(", Chunk: "), index, F.lit("]"))
    markdown = F.when((F.col("chunk_type") == "table") & (F.coalesce("table_markdown", F.lit("")) != ""), F.col("table_markdown"))
    image = F.when(F.col("chunk_type") == "image", F.concat_ws("\n", F.concat(F.lit("[Image] "), F.coalesce("caption", F.lit("no description"))), F.when(F.coalesce("chunk_text", F.lit("")) != "", F.concat(F.lit("Context: "), F.col("chunk_text"))), F.concat(F.lit("URL: "), F.col("image_path"))))
    return hits.withColumn("part", F.concat(cite, F.lit("\n"), F.coalesce(markdown, image, "chunk_text", F.lit("")), F.lit("\n")))


def within_budget(parts: DataFrame, budget: int = 8000, by: str = "query_id", order: str = "rank", part: str = "part") -> DataFrame:
    """Parts up to the first that would overflow the budget; the very first is always in, and later ones that might
    fit are not tried."""
    w = Window.partitionBy(by).orderBy(order)
    rows = parts.withColumn("_sum", F.sum(F.length(part)).over(w)).withColumn("_at", F.row_number().over(w))
    over = F.min(F.when((F.col("_sum") > budget) & (F.col("_at") > 1), F.col("_at"))).over(Window.partitionBy(by))
    return rows.withColumn("_over", over).where("_over IS NULL OR _at < _over").drop("_sum", "_over").withColumnRenamed("_at", "citation_number")


def assemble(parts: DataFrame, by: str = "query_id") -> DataFrame:
    """by, context: the parts in order, one line between them."""
    rows = F.array_sort(F.collect_list(F.struct("citation_number", "part")))
    return parts.groupBy(by).agg(F.array_join(F.transform(rows, lambda x: x["part"]), "\n").alias("context"))


def citations(answers: DataFrame, key: str = "query_id", answer: str = "answer") -> DataFrame:
    """key, filename (lower case), chunk_index: the citations of each answer, each once."""
    pair = F.arrays_zip(F.regexp_extract_all(answer, F.lit(CITATION), 1).alias("f"), F.regexp_extract_all(answer, F.lit(CITATION), 2).alias("i"))
    return answers.select(key, F.explode(pair).alias("p")).select(key, F.lower(F.trim("p.f")).alias("filename"), F.expr("try_cast(p.i AS INT)").alias("chunk_index")).distinct()


def sources(answers: DataFrame, hits: DataFrame, key: str = "query_id") -> DataFrame:
    """The hits that an answer cites; all of them if none of its citations is a hit."""
    cited = citations(answers, key)
    rows = hits.withColumn("_file", F.lower("filename"))
    marked = rows.join(cited.select(key, F.col("filename").alias("_file"), "chunk_index").withColumn("_cited", F.lit(True)), [key, "_file", "chunk_index"], "left")
    some = F.max(F.coalesce("_cited", F.lit(False))).over(Window.partitionBy(key))
    return marked.withColumn("_some", some).where("_cited OR NOT _some").drop("_file", "_cited", "_some")


def source_rows(hits: DataFrame) -> DataFrame:
    """Sources as a reader sees them: preview, citation, score."""
    cite = F.concat(F.lit("[Document: "), F.col("filename"), F.lit(", Chunk: "), F.col("chunk_index").cast("string"), F.lit("]"))
    return hits.select("query_id", "chunk_id", "document_id", "filename", "chunk_index", preview(F.col("chunk_text")).alias("chunk_text"), cite.alias("citation"), "score")


def groundedness(answers: DataFrame, hits: DataFrame, key: str = "query_id", answer: str = "answer", text: str = "chunk_text") -> DataFrame:
    """key, score: words that answer and chunks share, over the chunks' mean number of words, at most 1; grounded from 0.3."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    a = answers.select(key, words(F.col(answer)).alias("_a"))
    rows = hits.select(key, words(F.col(text)).alias("_c")).join(a, key)
    shared = rows.groupBy(key).agg(F.sum(F.size(F.array_intersect("_a", "_c"))).alias("o"), F.avg(F.size("_c")).alias("m"))
    return shared.select(key, F.least(F.lit(1.0), F.col("o") / F.greatest(F.col("m"), F.lit(1.0))).alias("score")).withColumn("grounded", F.col("score") >= 0.3)
