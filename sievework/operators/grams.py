"""Substring search by an index of trigrams: which texts contain a word, without a scan of all texts.

The index is a table (gram, ids) in folders by a hash of the gram; each of its rows has the documents of one batch of texts.
A word is looked up by the trigrams that the fewest texts have; texts with all of these are candidates, and only they are
read and tested. Words of one or two characters have no trigram and are not looked up (see words_of)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of a gram, grams that a word is looked up by, ids of a row, bytes of text of a bucket, most buckets.
SIZE, RAREST, LISTED, BUCKET, BUCKETS = 3, 4, 4096, 4 << 20, 2048


@dataclass(frozen=True)
class Grams:
    """A stored index: rows (gram, bucket, n, ids)."""

    rows: DataFrame
    buckets: int


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def build(texts: DataFrame, path: str, key: str = "chunk_id", text: str = "content") -> Grams:
    """Index the lower case of all texts at path; nulls have no grams. Texts stay where they are: only their lists move."""
    spark = texts.sparkSession
    rows = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.lower(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = int(min(BUCKETS, 1 + size // BUCKET))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        ids: list[pa.Array] = []
        n = entries = 0

        def listed() -> pa.RecordBatch:
            grams = sorted(held)
            offsets, flat = [0], []
            for g in grams:
                flat += held[g]
                offsets.append(len(flat))
            return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array([len(held[g]) for g in grams], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(ids).take(pa.array(flat, pa.int64())))], ["gram", "n", "ids"])

        for batch in batches:
            for i, t in enumerate(batch.column("text").to_pylist()):
                ids.append(batch.column("id").slice(i, 1))
                for g in {t[k : k + SIZE] for k in range(len(t) - SIZE + 1)}:
                    held.setdefault(g, []).append(n)
                    entries += 1
                n += 1
                if n == LISTED or entries > 500 * LISTED:
                    yield listed()
                    held, ids, n, entries = {}, [], 0, 0
        if held:
            yield listed()

    lists = rows.mapInArrow(run, f"gram string, n long, ids array<{kind}>").withColumn("bucket", _bucket(F.col("gram"), buckets))
    # Lists of a frequent gram are rows of their own; each row goes by itself, so that no bucket is one task's.
    lists.repartition(min(2000, 4 * buckets), "bucket", F.pmod(F.xxhash64("n", F.get("ids", F.lit(0))), F.lit(4))).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").mode("overwrite").parquet(path)
    return load(spark, path, buckets, kind)


def load(spark: SparkSession, path: str, buckets: int, kind: str = "long") -> Grams:
    return Grams(spark.read.schema(f"gram string, n long, ids array<{kind}>, bucket int").parquet(path), buckets)


def words_of(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """query_id, w of keywords that can be looked up, and of those that are too short for it."""
    words = queries.select("query_id", F.explode(F.array_distinct(F.transform("keywords", lambda w: F.lower(w)))).alias("w"))
    return words.where(F.length("w") >= SIZE), words.where(F.length("w") < SIZE)


def candidates(index: Grams, words: DataFrame, named: int = 5000) -> DataFrame:
    """w, id: texts that have the rarest grams of each word (w). Grams of the words are named to the scan, up to `named`."""
    grams = words.select("w").distinct().withColumn("gram", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("w") - SIZE + 1), lambda i: F.substring("w", i, F.lit(SIZE))))))
    few = [r["gram"] for r in grams.select("gram").distinct().limit(named + 1).collect()]
    rows = index.rows
    if len(few) <= named:
        own = grams.sparkSession.createDataFrame([(g,) for g in few], "gram string").select(_bucket(F.col("gram"), index.buckets).alias("b")).distinct().collect()
        rows = rows.where(F.col("bucket").isin([r["b"] for r in own]) & F.col("gram").isin(few)) if few else rows.where("false")
    counts = rows.groupBy("gram").agg(F.sum("n").alias("df"))
    order = Window.partitionBy("w").orderBy(F.coalesce("df", F.lit(0)), "gram")
    chosen = grams.join(counts, "gram", "left").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= RAREST)
    needed = chosen.groupBy("w").agg(F.count("*").alias("_k"))
    met = rows.select("gram", "ids").join(chosen.select("w", "gram"), "gram").select("w", F.explode("ids").alias("id")).groupBy("w", "id").agg(F.count("*").alias("_n"))
    return met.join(needed, "w").where("_n = _k").select("w", "id")


def containing(index: Grams, texts: DataFrame, queries: DataFrame, key: str = "chunk_id") -> DataFrame:
    """query_id, key of texts that may contain any keyword: candidates of all words long enough; where a question has a
    shorter word, all texts for it."""
    long, short = words_of(queries)
    found = long.join(candidates(index, long), "w").select("query_id", F.col("id").alias(key)).distinct()
    rest = short.select("query_id").distinct()
    if rest.isEmpty():
        return found
    every = texts.select(key).crossJoin(F.broadcast(rest)).select("query_id", key)  # questions with such a word, stated by the user
    return found.unionByName(every).distinct()
