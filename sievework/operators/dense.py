"""Exact cosine search: every vector against a batch of queries, as matrix products of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.vectors import cosine

#: Bytes of queries that are sent to every task; larger batches are joined in blocks.
SENT = 64 << 20


def sound(vector: Column) -> Column:
    """A vector with components, all of them finite."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite)


def search(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", batch: int = 256) -> DataFrame:
    """query_id, id, score of each query's k nearest; queries: query_id, vector. Ties go to the smaller id. Vectors and
    queries that are null, empty or hold nulls or what is not finite take no part; only those of one dimension meet.

    Each group of queries of one dimension and at most SENT bytes (an exact count, no cap) is broadcast and meets all
    vectors in one pass: each task keeps its own k best, and only those are shuffled."""
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    qkind = queries.schema["query_id"].dataType.simpleString()
    asked = queries.where(sound(F.col("vector"))).select("query_id", F.col("vector").cast("array<double>").alias("vector")).withColumn("_d", F.size("vector"))
    sizes = sorted((r["_d"], r["n"]) for r in asked.groupBy("_d").agg(F.count("*").alias("n")).collect())  # a row for each dimension
    rows = vectors.where(sound(F.col(vector))).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    found = spark.createDataFrame([], f"query_id {qkind}, id {kind}, score double")
    for dim, n in sizes:
        parts = -(-n * 8 * dim // SENT)
        for part in range(parts):
            group = asked.where((F.col("_d") == dim) & (F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)).select("query_id", "vector").toArrow()
            q = group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            length = np.linalg.norm(q, axis=1, keepdims=True)
            sent = spark.sparkContext.broadcast((group.column("query_id").combine_chunks(), np.divide(q, length, out=np.zeros_like(q), where=length > 0)))

            def run(batches: Iterator[pa.RecordBatch], sent=sent, dim=dim) -> Iterator[pa.RecordBatch]:
                ids, q = sent.value
                for b in batches:
                    if not b.num_rows:
                        continue
                    b = b.take(pc.array_sort_indices(b.column("id")))
                    x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
                    size = np.linalg.norm(x, axis=1, keepdims=True)
                    x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
                    for a in range(0, len(q), batch):
                        s = np.round(q[a : a + batch] @ x.T, 12)
                        least = np.partition(s, -k, axis=1)[:, -k][:, None] if s.shape[1] > k else s.min(axis=1, keepdims=True)
                        equal = s == least
                        above = s > least
                        # Of those at the kth score, the smallest ids fill what is left.
                        r, c = np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True))))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(a + r)), b.column("id").take(pa.array(c)), pa.array(s[r, c])], ["query_id", "id", "score"])

            here = rows.where(F.size("v") == dim).mapInArrow(run, f"query_id {qkind}, id {kind}, score double")
            found = found.unionByName(here)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def against(vectors: DataFrame, query: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, id, score of all vectors against a stated set of queries (query_id, vector), without Python: for filters
    and fusions that need every score. Queries are broadcast in groups of about SENT bytes, each of which meets all
    vectors in one scan."""
    size = query.agg(F.sum(F.size("vector") * 8)).first()[0] or 0
    parts, out = max(1, -(-size // SENT)), None
    for i in range(parts):
        group = query.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) if parts > 1 else query
        found = vectors.crossJoin(F.broadcast(group)).select("query_id", F.col(key).alias("id"), cosine(F.col(vector), F.col("vector")).alias("score"))
        out = found if out is None else out.unionByName(found)
    return out
