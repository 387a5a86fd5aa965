"""Merging hits of several retrievers: one row for each chunk, scores normalised and weighted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sources in the order that decides attributes and ties, and their weights.
WEIGHTS = {"sparse": 0.25, "dense": 0.25, "table": 0.15, "image": 0.15, "graph": 0.20}
SOURCES = tuple(WEIGHTS)
ATTRIBUTES = ("document_id", "chunk_text", "chunk_type", "filename", "document_type", "source_path", "table_markdown", "image_path", "caption")


def merge(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """hits: query_id, source, rank, chunk_id, score and any of ATTRIBUTES. One row for each query and chunk with
    `<source>_score` (the greatest, null where the source has no hit), attributes of the first source that has them,
    and src_prio, src_rank, its place in the merged list."""
    prio = F.element_at(F.create_map(*(F.lit(x) for i, s in enumerate(SOURCES) for x in (s, i))), F.col("source"))
    rows = hits.where("chunk_id IS NOT NULL").withColumn("_prio", prio)
    order = F.struct("_prio", "rank")
    have = [a for a in ATTRIBUTES if a in hits.columns]

    def first(name: str):
        return F.min_by(name, F.when(F.col(name).isNotNull() & (F.col(name) != ""), order)).alias(name)

    scores = [F.max(F.when(F.col("source") == s, F.col("score"))).alias(f"{s}_score") for s in SOURCES]
    kind = []
    if "chunk_type" in have:
        seen = F.collect_set("source")
        kind = [F.when(F.array_contains(seen, "image"), "image").when(F.array_contains(seen, "table"), "table").otherwise(F.min_by("chunk_type", F.when(F.col("chunk_type").isNotNull(), order))).alias("chunk_type")]
    place = F.min(order).alias("_place")
    out = rows.groupBy(by, "chunk_id").agg(*scores, *(first(a) for a in have if a != "chunk_type"), *kind, place)
    return out.select("*", F.col("_place._prio").alias("src_prio"), F.col("_place.rank").alias("src_rank")).drop("_place")


def normalize(merged: DataFrame, by: str = "query_id") -> DataFrame:
    """Adds `<source>_normalized`: min-max over the query's scores of a source; 0 where there is no score, for a lone
    score, and where all are equal."""
    w = Window.partitionBy(by)
    for s in SOURCES:
        c = F.col(f"{s}_score")
        low, high = F.min(c).over(w), F.max(c).over(w)
        merged = merged.withColumn(f"{s}_normalized", F.when(c.isNull(), 0.0).otherwise((c - low) / F.when(high > low, high - low).otherwise(1.0)))
    return merged


def combine(merged: DataFrame, weights: dict[str, float] | None = None, normalized: bool = True) -> DataFrame:
    """Adds score: the weighted mean, rounded to 9 digits, so that ties are ties whatever the order of sums. Normalised scores are never absent, so absence counts as 0; without normalisation
    absent sources leave the divisor."""
    weights = WEIGHTS | (weights or {})
    kind = "normalized" if normalized else "score"
    top = sum((F.coalesce(F.col(f"{s}_{kind}"), F.lit(0.0)) * weights[s] for s in SOURCES), F.lit(0.0))
    under = sum((F.when(F.col(f"{s}_{kind}").isNotNull(), F.lit(weights[s])).otherwise(0.0) for s in SOURCES), F.lit(0.0))
    return merged.withColumn("score", F.when(under > 0, F.round(top / F.when(under > 0, under), 9)).otherwise(0.0))


def top(merged: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The k best; ties keep the merged list's order."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "src_prio", "src_rank", "chunk_id")
    return merged.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= k)


def type_counts(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """Text, table and image hits of each query."""
    return hits.groupBy(by).agg(*(F.count_if(F.col("chunk_type") == t).alias(t) for t in ("text", "table", "image")), F.count("*").alias("n"))


def fuse(hits: DataFrame, k: int = 10, weights: dict[str, float] | None = None, normalized: bool = True, by: str = "query_id") -> DataFrame:
    """merge, normalise, combine, cut. All steps after the merge share one partitioning by query."""
    merged = merge(hits, by)
    return top(combine(normalize(merged, by) if normalized else merged, weights, normalized), k, by)
