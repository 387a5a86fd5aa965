"""Stored vectors in lists by k-means: a search reads the lists whose centres are near a query, and filters reach the scan.

The centres are fitted on a bounded sample; every vector is in the list of its nearest centre, in a folder of that list, so
that a scan skips all others. How many lists to read is measured on some queries against the exact search; with all lists
the search is exact. Scores are cosines of the vectors as they are, never of centres."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.operators import dense
from sievework.session import materialize

#: Vectors of a list, most lists, sampled vectors for each list (and in all), rounds of k-means, rows of a file of a list.
LIST, LISTS, SAMPLE, MOST, ROUNDS, FILE = 1000, 2048, 40, 50_000, 12, 1_000_000
#: Queries that the number of lists is measured on, and the recall it has to reach.
TRIED, RECALL = 64, 0.95
FITTED = "key string, vector string, centres string, probes int, recall double"


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def fit(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """k centres of unit vectors, by Lloyd's rounds on cosines; a centre without vectors takes the worst served one."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = np.concatenate([np.argmax(x[a : a + 8192] @ centres.T, axis=1) for a in range(0, len(x), 8192)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        none = np.flatnonzero(np.bincount(near, minlength=k) == 0)
        worst = np.argsort(np.einsum("ij,ij->i", x, centres[near]))
        sums[none] = x[worst[: len(none)]]
        centres = unit(sums)
    return centres


@dataclass(frozen=True)
class Lists:
    """Rows of a table at path, with list; centres of the lists; lists to read for a query, and the recall measured with
    that many."""

    rows: DataFrame
    centres: np.ndarray
    key: str
    vector: str
    probes: int
    recall: float

    def search(self, queries: DataFrame, k: int, where: Column | None = None, probes: int | None = None) -> DataFrame:
        """query_id, rank, id, score of each query's k nearest of its lists, ties to the smaller id. where filters rows in
        the scan; with probes = len(centres) the search is exact. Queries (query_id, vector) without a finite vector of
        the lists' dimension take no part."""
        spark, dim, n = self.rows.sparkSession, self.centres.shape[1], min(probes or self.probes, len(self.centres))
        sound = queries.where(dense.sound(F.col("vector")) & (F.size("vector") == dim)).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
        kind, qkind = self.rows.schema[self.key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
        out = f"query_id {qkind}, id {kind}, score double"
        found = spark.createDataFrame([], out)
        asked = materialize(sound)
        parts = -(-asked.count() * 8 * dim // dense.SENT)
        for part in range(parts):
            group = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).toArrow()  # at most about SENT bytes
            q = unit(group.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, dim))
            near = np.argpartition(-(q @ self.centres.T), n - 1, axis=1)[:, :n]
            of = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
            sent = spark.sparkContext.broadcast((group.column("query_id").combine_chunks(), q, of))

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                ids, q, of = sent.value
                for b in batches:
                    lists = b.column("list").to_numpy()
                    for c in np.unique(lists).tolist():
                        rows = b.filter(pa.array(lists == c))
                        rows = rows.take(pc.array_sort_indices(rows.column("id")))
                        mine = of[c]
                        x = unit(rows.column("v").flatten().to_numpy().reshape(rows.num_rows, -1))
                        s = np.round(q[mine] @ x.T, 12)
                        order = np.argsort(-s, axis=1, kind="stable")[:, :k]  # ids ascend
                        r = np.repeat(np.arange(len(mine)), order.shape[1])
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(mine[r])), rows.column("id").take(pa.array(order.ravel())), pa.array(s[r, order.ravel()])], ["query_id", "id", "score"])

            held = self.rows.where(F.col("list").isin(sorted(of)))
            held = held if where is None else held.where(where)
            found = found.unionByName(held.select("list", F.col(self.key).alias("id"), F.col(self.vector).cast("array<double>").alias("v")).mapInArrow(run, out))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def build(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", lists: int | None = None, k: int = 10) -> Lists:
    """Lists at path of all vectors that are finite and of the dimension that most have; other columns go along, for
    filters. The number of lists to read is the least power of two that reaches RECALL on TRIED of the vectors."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(key).isNotNull() & dense.sound(F.col(vector)))
    dims = rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        raise ValueError("there are no vectors")
    rows = rows.where(F.size(vector) == dims["d"])
    lists = max(1, min(lists or dims["n"] // LIST, LISTS, dims["n"]))
    wanted = min(MOST, max(SAMPLE * lists, 1000))
    share = min(1.0, 1.2 * wanted / dims["n"])
    taken = rows.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) < share * (1 << 30)).select(F.col(vector).cast("array<double>").alias("v")).limit(max(wanted, lists)).toArrow()  # bounded by MOST
    x = unit(taken.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dims["d"]))
    lists = min(lists, len(x))
    sent = spark.sparkContext.broadcast(fit(x, lists))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(b.schema.get_field_index("_v")).flatten().to_numpy().reshape(b.num_rows, -1)
            near = np.argmax(unit(v) @ sent.value.T, axis=1).astype(np.int32)
            kept = [i for i, n in enumerate(b.schema.names) if n != "_v"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(near)], [*(b.schema.names[i] for i in kept), "list"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", list int"
    dealt = rows.withColumn("_v", F.col(vector).cast("array<double>")).mapInArrow(assign, schema)
    # A list of very many rows goes to several tasks and files.
    salts = 1 + dims["n"] // FILE
    dealt.repartition(min(2000, lists * salts), "list", F.pmod(F.xxhash64(key), F.lit(salts))).write.partitionBy("list").parquet(f"{path}/rows")
    found = Lists(spark.read.parquet(f"{path}/rows"), sent.value, key, vector, lists, 1.0)
    tried = materialize(found.rows.orderBy(F.xxhash64(F.col(key).cast("string"))).limit(TRIED).select(F.col(key).cast("string").alias("query_id"), F.col(vector).alias("vector")))
    exact = {(r["query_id"], r["id"]) for r in found.search(tried, k, probes=lists).collect()}
    probes, recall = 1, 0.0
    while True:
        recall = sum((r["query_id"], r["id"]) in exact for r in found.search(tried, k, probes=probes).collect()) / max(1, len(exact))
        if recall >= RECALL or probes >= lists:
            break
        probes = min(lists, 2 * probes)
    # Written last: lists whose build was cut off cannot be loaded.
    spark.createDataFrame([(key, vector, json.dumps(sent.value.tolist()), probes, recall)], FITTED).coalesce(1).write.json(f"{path}/fitted")
    return Lists(found.rows, sent.value, key, vector, probes, recall)


def load(spark: SparkSession, path: str) -> Lists:
    r = spark.read.schema(FITTED).json(f"{path}/fitted").first()
    return Lists(spark.read.parquet(f"{path}/rows"), np.array(json.loads(r["centres"])), r["key"], r["vector"], r["probes"], r["recall"])
