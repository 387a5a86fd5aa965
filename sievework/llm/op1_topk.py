"""Exact top-k search by distributed histogram selection.

Scores are whole numbers, so the kth greatest score of a query can be found by counting. Each round scores everything
and counts the scores of each query by bin over the range that is still open; the bin with the kth score is the next
range. Rounds end when bins are one score wide. A last pass keeps the scores over the kth and, of those equal to it,
the smallest ids. A task counts a block pair at once and passes on only the bins from the top down to its own kth
score, since lower ones can't hold the query's kth.

Cases: vectors that are null, empty or hold null or non-finite components take no part. Rows that share an id count
once, with the greatest vector. Scores equal ones tie to the smaller id. Only vectors of one dimension meet. Products
are exact: in double precision where no sum can reach 2^53, else in 64-bit integers. If a sum could leave 64 bits (the
greatest sum of absolute components of a query times the greatest component of all is 2^62 or more), its score has no
value in the result's type: that is an error, which names the two numbers. Without candidates a query has no rows. Other
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm.common import materialize, read
from sievework.llm.vectors import QUERIES, ROWS, blocks, clean, meet

BINS = 256
#: Scores stay below this, so that the range of a query's scores fits 64 bits.
LIMIT = 2.0**62


def whole(vectors: DataFrame, scale: int) -> DataFrame:
    """floor(scale * x) of each component, as a double, which holds it exactly."""

    def floor(x: Column) -> Column:
        y = x * scale
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)  # beyond 2^53 every double is whole

    return vectors.withColumn("v", F.transform("v", floor))


def scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of queries and candidates, and their scores; a query's own row is marked by the least integer."""
    q = np.frombuffer(row["q_data"]).reshape(row["q_n"], -1)
    c = np.frombuffer(row["data"]).reshape(row["n"], -1)
    ids, own = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["q_ids"], dtype=np.int64)
    if np.abs(q).sum(axis=1).max() * np.abs(c).max() < 2.0**53:
        s = (q @ c.T).astype(np.int64)
    else:
        s = q.astype(np.int64) @ c.astype(np.int64).T
    s[own[:, None] == ids[None, :]] = np.iinfo(np.int64).min
    return own, ids, s


def each(pairs: DataFrame, step, schema: str) -> DataFrame:
    """step(row) -> columns, for every block pair."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                columns = step({c: batch.column(c)[i].as_py() for c in batch.schema.names})
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    return pairs.mapInArrow(run, schema)


def histogram(row: dict, k: int) -> list[np.ndarray]:
    """query, bin, count from the top down to the block's own kth score within the open range."""
    own, _, s = scores(row)
    lo, span = (np.frombuffer(row[f"q_{c}"], dtype=np.int64)[:, None] for c in ("lo", "span"))
    inside = (s >= lo) & (s < lo + span) & (s != np.iinfo(np.int64).min)
    width = -(-span // BINS)
    at = np.where(inside, (s - lo) // width, 0)
    n = len(own)
    counts = np.bincount((at + np.arange(n)[:, None] * BINS)[inside], minlength=n * BINS).reshape(n, BINS)
    above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
    r, b = np.nonzero((counts > 0) & (above < k))
    return [own[r], b.astype(np.int32), counts[r, b].astype(np.int64)]


def leaders(row: dict, k: int) -> list[np.ndarray]:
    """query, id, score over the kth score, and the smallest ids at it."""
    own, ids, s = scores(row)
    least = np.frombuffer(row["q_lo"], dtype=np.int64)[:, None]
    order = np.argsort(ids, kind="stable")
    ids, s = ids[order], s[:, order]
    legal = s != np.iinfo(np.int64).min
    equal = (s == least) & legal
    r, c = np.nonzero(((s > least) & legal) | (equal & (np.cumsum(equal, axis=1) <= k)))
    return [own[r], ids[c], s[r, c]]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k greatest integer inner products, its own row left out.

    is_query is a condition on the column `id`."""
    spark = vectors.sparkSession
    rows = materialize(whole(clean(vectors, key, vector), scale))
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    candidates = materialize(blocks(rows, ROWS))
    queries = rows.where(is_query)
    # No score of a query lies outside +- (its sum of absolute components) * (greatest component of any candidate).
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x))
    facts = rows.agg(F.max(F.array_max(F.transform("v", F.abs))).alias("most"), F.max(F.when(is_query, total)).alias("total")).first()  # one row
    most, sums = float(facts["most"] or 0), float(facts["total"] or 0)
    if most * sums >= LIMIT:
        raise ValueError(f"scores may leave 64 bits: a query's absolute components sum up to {sums:.6g}, and the greatest component is {most:.6g}")
    bound = (total * F.lit(most)).cast("long")
    # The open range of a query: it starts at lo and has span scores, in BINS bins of equal width.
    open_ = queries.select("id", (-bound).alias("lo"), (2 * bound + 1).alias("span"), F.lit(k).cast("long").alias("need"))
    open_ = materialize(open_)
    width = F.ceil(F.col("span") / BINS).cast("long")
    done = False
    while not done:
        asked = blocks(queries.join(open_, "id"), QUERIES, ("lo", "span"))
        counted = each(meet(asked, candidates, parts), lambda row: histogram(row, k), "id long, bin int, n long")
        counted = counted.groupBy("id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("id").orderBy(F.desc("bin"))
        counted = counted.withColumn("upto", F.sum("n").over(down)).join(open_, "id")
        found = counted.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        found = found.select("id", (F.col("lo") + F.col("bin") * width).alias("new_lo"), width.alias("new_span"), (F.col("need") - F.col("upto") + F.col("n")).alias("new_need"))
        # With fewer than k scores in all there is no kth: everything from the range's lower end on counts.
        step = open_.join(found, "id", "left").select("id", F.coalesce("new_lo", "lo").alias("lo"), F.coalesce("new_span", F.lit(1).cast("long")).alias("span"), F.coalesce("new_need", "need").alias("need"))
        open_ = materialize(step)
        done = open_.where("span > 1").isEmpty()
    asked = blocks(queries.join(open_, "id"), QUERIES, ("lo",))
    kept = each(meet(asked, candidates, parts), lambda row: leaders(row, k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 20th vector against all others."""
    return top_k(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, max(list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
