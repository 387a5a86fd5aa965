"""Approximate nearest neighbours by multiprobe p-stable hashing.

Every vector is scaled into the unit ball and lifted by one coordinate onto the sphere, which turns the largest inner
product into the smallest distance. Lengths fall into bands, each half as long as the one above and scaled by its own
upper end, so that a few long vectors do not press the others together. A table cuts K random projections into cells of
width W; the cells of a vector name its bucket. A query visits its own bucket and those with cells moved by one or two,
in the order of their estimated chance to hold a neighbour (least squared distance from the query to the moved cells),
so many of them in each table. Everything found in a bucket is scored exactly on the original vectors, and the best of
all tables are merged. A query that has found fewer than k, and fewer than there are, is compared with all vectors in
blocks.

K and the number of probes follow the data. At most CALIBRATED queries, taken in hash order, are compared with all rows;
from where their true neighbours lie, each K up to the logarithm of the rows gets the least number of probes that reaches
RECALL on them, and the K that looks at the fewest vectors is taken (estimated on REFERENCE rows). Clustered data gets
many narrow buckets and few probes. Without structure, in 64 dimensions, most vectors are nearly as far as the
neighbours, and any setting with such a recall looks at more than half of them. Every vector is indexed.

Buckets are dealt into parts by their names, about PART vectors each; a query goes, once, to each part that has buckets
it visits. A part with more than PART vectors, as one vector's many copies give, is dealt into several, and so are a
part's queries, and each deal of rows meets each deal of queries in a group of its own.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part. Rows that share an id
count once, with the greatest vector. Equal scores tie to the smaller id. Only vectors of one dimension meet. Other
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm.common import materialize, read
from sievework.llm.vectors import QUERIES, ROWS, blocks, clean, matrix, meet

TABLES, W, SEED = 2, 2.0, 7
#: What calibration aims at; queries and neighbours, and rows, that it looks at; numbers of probes that it tries.
RECALL, CALIBRATED, PAIRS, REFERENCE, PROBES = 0.93, 128, 4096, 2000, (4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 320, 384, 448, 512)
#: Numbers of projections that it tries.
WIDTHS = (3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16)
#: Rows, and queries, of a part that meet in one group, roughly.
PART, ASKED = 16_384, 4096
#: What visiting a bucket costs, in inner products.
VISIT = 0.25


def projections(dim: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.normal(size=(dim + 1, TABLES * k)), rng.uniform(0, W, size=TABLES * k)


def places(x: np.ndarray, k: int, longest: float, query: bool) -> np.ndarray:
    """Where vectors lie, in cells: (vectors, TABLES, k). A query stands at the upper end of every band."""
    norm = np.sqrt((x * x).sum(axis=1))
    if query:
        lifted = np.column_stack([x / norm[:, None], np.zeros(len(x))])
    else:
        bands = 2.0 ** np.floor(np.log2(np.maximum(longest / norm, 1)))
        y = x * (bands / longest)[:, None]
        lifted = np.column_stack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1)))])
    a, b = projections(x.shape[1], k)
    return ((lifted @ a + b) / W).reshape(len(x), TABLES, k)


def names(cells: np.ndarray) -> np.ndarray:
    """A 64-bit name for the cells (..., TABLES, [n,] k) of each table. Buckets that share a name only add candidates."""
    tables = np.arange(1, TABLES + 1, dtype=np.uint64).reshape(TABLES, *[1] * (cells.ndim - 3))
    out = np.zeros(cells.shape[:-1], dtype=np.uint64) + tables
    with np.errstate(over="ignore"):
        for i in range(cells.shape[-1]):
            out = (out ^ cells[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def probes(place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n buckets nearest to each place (m, k), nearest first: their cells (m, n, k) and squared distances (m, n). The
    distance is a sum over coordinates, so the best of all moves grow from the best of the coordinates before."""
    cell = np.floor(place)
    f = place - cell
    options = np.stack([(f + 1) ** 2, f**2, np.zeros_like(f), (1 - f) ** 2, (2 - f) ** 2], axis=-1)
    cost, move = np.zeros((len(place), 1)), np.zeros((len(place), 1, 0), dtype=np.int8)
    for i in range(place.shape[1]):
        m = cost.shape[1]
        cost = (cost[:, :, None] + options[:, None, i, :]).reshape(len(place), 5 * m)
        best = np.argpartition(cost, n - 1, axis=1)[:, :n] if 5 * m > n else np.broadcast_to(np.arange(5 * m), cost.shape)
        cost = np.take_along_axis(cost, best, axis=1)
        move = np.concatenate([np.take_along_axis(move, (best // 5)[:, :, None], axis=1), (best % 5 - 2).astype(np.int8)[:, :, None]], axis=2)
    order = np.argsort(cost, axis=1, kind="stable")
    return cell[:, None, :] + np.take_along_axis(move, order[:, :, None], axis=1), np.take_along_axis(cost, order, axis=1)


def distances(place: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Squared distance of each place to each bucket, as probes() counts it; both (..., k)."""
    own = np.floor(place)
    d = np.where(cells > own, cells - place, np.where(cells < own, place - cells - 1, 0))
    return np.where((np.abs(cells - own) > 2).any(axis=-1), np.inf, (d * d).sum(axis=-1))


def setting(asked: np.ndarray, pairs: np.ndarray, near: np.ndarray, others: np.ndarray, n: int, longest: float) -> tuple[int, int] | None:
    """K and probes: the fewest vectors to look at among those with the recall, or None if no setting has it; pairs are
    the rows of asked that the neighbours (near) belong to."""
    tried = []
    for k in [k for k in WIDTHS if k <= max(WIDTHS[0], np.ceil(np.log2(max(2, n))))]:
        place = places(asked, k, longest, True)
        limit = np.stack([probes(place[:, t], PROBES[-1])[1] for t in range(TABLES)], axis=1)  # (queries, TABLES, probes)
        own, every = (np.floor(places(x, k, longest, False)) for x in (near, others))
        to_near = distances(place[pairs], own)
        to_any = distances(place[:, None], every[None])
        for p in PROBES:
            last = limit[:, :, min(p, limit.shape[2]) - 1]
            recall = (to_near <= last[pairs]).any(axis=1).mean()
            if recall >= RECALL or p == PROBES[-1]:
                share = (to_any <= last[:, None]).any(axis=2).mean()
                if recall >= RECALL:
                    tried.append((share * n + p * TABLES * VISIT, p, k))
                break
    return min(tried)[:0:-1] if tried else None


def hashed(vectors: DataFrame, longest: float, k: int, n_probes: int, parts: int, query: bool) -> DataFrame:
    """dim, part, id, v and the name of the bucket, a row for each table; or, of queries, the names of all buckets to
    visit in a part, a row for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 250 if query else 2000):
                batch = whole.slice(start, 250 if query else 2000)
                sizes = np.diff(batch.column("v").offsets.to_numpy())
                for dim in np.unique(sizes).tolist():
                    part = batch.filter(pa.array(sizes == dim))
                    x = matrix(part.column("v"))
                    place = places(x, k, longest, query)
                    v = pa.array([r.tobytes() for r in x], pa.binary())
                    if not query:
                        bucket = names(np.floor(place)).ravel()
                        row, cut = np.repeat(np.arange(len(x)), TABLES), None
                    else:
                        cells = np.stack([probes(place[:, t], n_probes)[0] for t in range(TABLES)], axis=1)
                        bucket = names(cells).reshape(len(x), -1)
                        row = np.repeat(np.arange(len(x)), bucket.shape[1])
                        bucket = bucket.ravel()
                        order = np.lexsort((bucket, bucket % np.uint64(parts), row))
                        bucket, row = bucket[order], row[order]
                        to = bucket % np.uint64(parts)
                        cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (to[1:] != to[:-1])]))
                        data, row = bucket, row[cut]
                        bucket = bucket[cut]
                    columns = {"dim": pa.array(np.full(len(row), dim, dtype=np.int32)), "part": pa.array((bucket % np.uint64(parts)).astype(np.int64)), "id": part.column("id").take(pa.array(row)), "v": v.take(pa.array(row))}
                    if query:
                        edges = np.append(cut, len(data))
                        columns["buckets"] = pa.array([data[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())
                    else:
                        columns["bucket"] = pa.array(bucket.view(np.int64))
                    yield pa.RecordBatch.from_pydict(columns)

    return vectors.select("id", "v").mapInArrow(run, "dim int, part long, id long, v binary, " + ("buckets binary" if query else "bucket long"))


def leading(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, visited=None) -> Iterator[pa.RecordBatch]:
    """query_id, vec_id, score: each query's k best of a block of candidates (ids ascending), or of those that it visits:
    visited(a, b) is True where queries a to b look at a candidate."""
    for a in range(0, len(q), 512):
        own, some = q_ids[a : a + 512], q[a : a + 512]
        s = some @ c.T if visited is None else visited(a, a + 512)
        s[own[:, None] == c_ids[None, :]] = -np.inf
        least = np.partition(s, -k, axis=1)[:, -k][:, None] if len(c) > k else np.full((len(s), 1), -np.inf)
        equal = (s == least) & (s > -np.inf)
        r, at = np.nonzero((s > least) | (equal & (np.cumsum(equal, axis=1) <= k)))
        exact = (some[r] * c[at]).sum(axis=1)  # one order of summation, whatever the block
        yield pa.RecordBatch.from_arrays([pa.array(own[r]), pa.array(c_ids[at]), pa.array(exact)], ["query_id", "vec_id", "score"])


def best_of(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: each query's k best of each part, of what lies in the buckets it visits."""
    key = ["dim", "part"]
    many = lambda df, size, name: df.groupBy(key).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    deals = many(rows, PART, "_rows").join(many(asked, ASKED, "_asked"), key)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = rows.join(deals, key).withColumn("i", at("_rows")).withColumn("j", spread("_asked")).drop("_rows", "_asked")
    right = asked.join(deals, key).withColumn("j", at("_asked")).withColumn("i", spread("_rows")).drop("_rows", "_asked")
    group = [*key, "i", "j"]

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]).empty_table()
        dim = a.column("dim")[0].as_py()
        ids, bucket = a.column("id").to_numpy(), a.column("bucket").to_numpy().view(np.uint64)
        order = np.lexsort((ids, bucket))
        ids, bucket = ids[order], bucket[order]
        x = np.frombuffer(b"".join(a.column("v").to_pylist())).reshape(-1, dim)[order]
        q_ids, q = b.column("id").to_numpy(), np.frombuffer(b"".join(b.column("v").to_pylist())).reshape(-1, dim)
        wanted = [np.frombuffer(w, dtype=np.uint64) for w in b.column("buckets").to_pylist()]
        begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        end, have = np.append(begin[1:], len(bucket)), bucket[begin]
        by_id = np.argsort(ids, kind="stable")
        once = np.flatnonzero(np.diff(ids[by_id], prepend=ids.min() - 1))  # a vector may be there by several tables

        def visited(first: int, last: int) -> np.ndarray:
            some = wanted[first:last]
            name = np.concatenate(some)
            who = np.repeat(np.arange(len(some)), [len(w) for w in some])
            place = np.minimum(np.searchsorted(have, name), len(have) - 1)
            hit = have[place] == name
            place, who = place[hit], who[hit]
            turn = np.argsort(place, kind="stable")
            place, who = place[turn], who[turn]
            out = np.full((len(some), len(x)), -np.inf)
            edges = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]])) if len(place) else np.zeros(1, np.int64)
            for u, v in zip(edges.tolist(), edges[1:].tolist()):
                g = place[u]
                out[who[u:v], begin[g] : end[g]] = q[first + who[u:v]] @ x[begin[g] : end[g]].T
            return np.maximum.reduceat(out[:, by_id], once, axis=1)

        return pa.Table.from_batches(list(leading(q_ids, q, ids[by_id][once], x[by_id][once], k, visited)))

    return left.groupBy(group).cogroup(right.groupBy(group)).applyInArrow(score, "query_id long, vec_id long, score double")


def best_of_all(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: each query's k best of each block of all rows."""
    spark = rows.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (c_ids, c), (q_ids, q) = ((np.frombuffer(row[f"{n}ids"], dtype=np.int64), np.frombuffer(row[f"{n}data"]).reshape(-1, row["dim"])) for n in ("", "q_"))
                order = np.argsort(c_ids, kind="stable")
                yield from leading(q_ids, q, c_ids[order], c[order], k)

    pairs = meet(blocks(queries, QUERIES), blocks(rows, ROWS), parts)
    return pairs.select("dim", "ids", "data", "q_ids", "q_data").mapInArrow(run, "query_id long, vec_id long, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def calibrated(rows: DataFrame, is_query: Column, k: int, longest: float) -> tuple[int, int] | None:
    """K and probes for these rows; None if none has the recall."""
    n_of = {r["dim"]: r["n"] for r in rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()}
    if not n_of:
        return 3, PROBES[0]
    (dim, n), = n_of.items()
    same = rows.where(F.size("v") == dim)
    first = (F.xxhash64("id"), F.col("id"))
    some = materialize(same.where(is_query).orderBy(*first).limit(max(1, min(CALIBRATED, PAIRS // k))))
    near = ranked(best_of_all(some, same, k), k).join(rows.select(F.col("id").alias("vec_id"), "v"), "vec_id").select("query_id", "v").collect()  # at most PAIRS, or k
    asked, others = some.collect(), same.orderBy(*first).limit(REFERENCE).collect()
    if not near:
        return 3, PROBES[0]
    place = {r["id"]: i for i, r in enumerate(asked)}
    return setting(np.array([r["v"] for r in asked]), np.array([place[r["query_id"]] for r in near]), np.array([r["v"] for r in near]), np.array([r["v"] for r in others]), n, longest)


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", width: int | None = None, n_probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each query (a condition on `id`), its own row left out.
    Without width (K) and n_probes, calibration says them; where no setting reaches RECALL on its queries, all queries
    meet all vectors, so that recall is never lost without a word."""
    rows = materialize(clean(vectors, key, vector).where(F.exists("v", lambda x: x != 0)))
    spark = rows.sparkSession
    facts = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("longest"), F.count("*").alias("n")).first()  # one row
    longest, parts = facts["longest"] or 1.0, max(2 * spark.sparkContext.defaultParallelism, -(-facts["n"] * TABLES * 2 // PART))
    if width is None or n_probes is None:
        found = calibrated(rows, is_query, k, longest)
        if found is None:
            return ranked(best_of_all(rows.where(is_query), rows, k), k)
        width, n_probes = found
    index = hashed(rows, longest, width, n_probes, parts, False)
    asked = hashed(rows.where(is_query), longest, width, n_probes, parts, True)
    found = materialize(ranked(best_of(index, asked, k), k))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    have = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("have"))
    few = rows.where(is_query).withColumn("dim", F.size("v")).join(F.broadcast(sizes), "dim").join(have, "id", "left")
    few = materialize(few.where(F.coalesce("have", F.lit(0)) < F.least(F.lit(k), F.col("n") - 1)).select("id", "v"))
    if few.isEmpty():
        return found
    rest = found.join(few.select(F.col("id").alias("query_id")), "query_id", "left_anti").select(*found.columns)
    return rest.unionByName(ranked(best_of_all(few, rows, k), k))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 20th vector against all others."""
    return neighbours(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
