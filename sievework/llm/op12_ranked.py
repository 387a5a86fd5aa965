"""Ranked lexical search: documents are scored one after the other by a heap over compressed postings.

The index has shards, each of the documents of some megabytes of text: their ids, ascending, their numbers of terms, and
for each term a posting list in the order of ids (gaps and counts as variable-length bytes). A search sends the asked
terms' lists of a shard to one task. There, for each item, a heap merges its lists by document: the least document of
all lists is scored whole and meets a bounded heap of results, whose least entry has the least score, or of equal ones
the greatest doc_id. Each list knows the most it can add in its shard; lists that together cannot reach the bounded
heap's least score leave the merge and are only asked for documents that others bring up. The heaps of all tasks are
merged at last.

Terms are runs of ASCII letters, digits and anything outside ASCII, A to Z in lower case. All but the weights, which are
floor(1000 * ln((2 * N + 2) / (2 * df + 1))), is arithmetic in 64-bit integers.

Cases: a null or empty text has no terms and is not found. Documents without a doc_id take no part, neither do items
without an item_id. Documents that share a doc_id are each scored and ranked; items that share an item_id ask for the
terms of all. An item without terms that occur has no results. Equal scores go by doc_id. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm.common import materialize, read, slices, small_batches
from sievework.llm.words import bytes_of, split

#: Bytes of text of a shard, terms that a searching task has in its shards, and asked (item, term) pairs sent at once.
SHARD, PART, BLOCK = 12 << 20, 4_000_000, 500_000
#: The byte that stands for each byte of a text: itself, its lower case, or a blank.
LOWER = np.full(256, 0x20, dtype=np.uint8)
LOWER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """edges, codes and the dictionary of all texts' terms."""
    flat, edges = bytes_of(texts)
    plain = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(edges)), pa.py_buffer(LOWER[flat])])
    return split(plain)


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits, the last one of each number below 128; and how many bytes each takes."""
    size = np.ones(len(values), dtype=np.int64)
    for bits in range(7, 63, 7):
        size += values >= 1 << bits
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        more = np.flatnonzero(size > k)
        out[at[more] + k] = (values[more] >> (7 * k)) & 127 | np.where(size[more] > k + 1, 128, 0)
    return out, size


def unpacked(raw: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(raw < 128)
    if not len(last):
        return np.zeros(0, np.int64)
    first = np.append(0, last[:-1] + 1)
    shift = 7 * (np.arange(len(raw)) - np.repeat(first, last - first + 1))
    return np.add.reduceat((raw & 127).astype(np.int64) << shift, first)


def binaries(flat: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())


#: A shard's documents are its row without a term; df counts those with terms, and total is the sum of their lengths.
INDEX = "shard long, term string, df long, total long, ids binary, postings binary"


def shard_rows(shard: int, ids: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), dtype=np.int64)
    place[order] = np.arange(len(ids))
    edges, codes, dictionary = terms(texts)
    lengths = np.diff(edges)
    uses = np.sort(codes * len(ids) + np.repeat(place, lengths))
    begin = np.flatnonzero(np.append(True, uses[1:] != uses[:-1])) if len(uses) else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, len(uses)))
    term, doc = np.divmod(uses[begin], max(1, len(ids)))
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
    gap = np.diff(doc, prepend=0)
    gap[first] = doc[first]
    flat, size = packed(np.stack([gap, count - 1], axis=1).ravel())
    ends = np.append(0, np.cumsum(size)[1::2])
    bounds = ends[np.append(first, len(term))]
    own, _ = packed(lengths[order])
    n = len(first)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + 1, shard, dtype=np.int64)),
            pa.concat_arrays([pa.array([None], pa.string()), dictionary.take(pa.array(term[first])).cast(pa.string())]),
            pa.array(np.append(int((lengths > 0).sum()), np.diff(np.append(first, len(term)))).astype(np.int64)),
            pa.array(np.append(int(lengths.sum()), np.add.reduceat(count, first) if n else []).astype(np.int64)),
            pa.concat_arrays([pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), pa.nulls(n, pa.binary())]),
            pa.concat_arrays([pa.array([own.tobytes()], pa.binary()), binaries(flat, bounds)]),
        ],
        ["shard", "term", "df", "total", "ids", "postings"],
    )


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """The index of all documents, as rows of INDEX in the shared folder; no row is moved between tasks."""
    rows = small_batches(docs).where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, size, ids, texts = TaskContext.get().partitionId(), 0, 0, [], []
        for batch in batches:
            for part in slices(batch, "text", shard):
                column = part.column("text")
                if ids and size + column.nbytes > shard:
                    yield shard_rows((task << 32) + n, np.concatenate(ids), pa.concat_arrays(texts))
                    n, size, ids, texts = n + 1, 0, [], []
                size += column.nbytes
                ids.append(part.column("doc_id").to_numpy())
                texts.append(column)
        if ids:
            yield shard_rows((task << 32) + n, np.concatenate(ids), pa.concat_arrays(texts))

    return materialize(rows.mapInArrow(run, INDEX))


@dataclass
class Postings:
    """A term's list in a shard: documents by their place in it, what each adds to a score, the most that any adds, and
    the kth most."""

    docs: list[int]
    adds: list[int]
    most: int
    kth: int
    of: dict[int, int]


class Shard:
    """The asked lists of a shard."""

    def __init__(self, rows: pa.Table, weights: dict[str, int], n: int, total: int, k: int):
        own = rows.filter(pa.compute.is_null(rows.column("term")))
        self.ids = np.frombuffer(own.column("ids")[0].as_py(), dtype="<i8").tolist()
        lengths = unpacked(np.frombuffer(own.column("postings")[0].as_py(), dtype=np.uint8))
        damp = 20 * (50 + (50 * lengths * n) // total)
        self.lists: dict[str, Postings] = {}
        rows = rows.filter(pa.compute.is_in(rows.column("term"), pa.array([t for t, w in weights.items() if w > 0], pa.string())))
        if not rows.num_rows:
            return
        size = rows.column("df").to_numpy()
        edges = np.append(0, np.cumsum(size))
        names = rows.column("term").to_pylist()
        pairs = unpacked(np.frombuffer(b"".join(rows.column("postings").to_pylist()), dtype=np.uint8)).reshape(-1, 2)
        docs, count = np.cumsum(pairs[:, 0]), pairs[:, 1] + 1
        docs -= np.repeat(docs[edges[:-1]] - pairs[edges[:-1], 0], size)
        adds = np.repeat([weights[t] for t in names], size) * ((1_000_000_000 * count) // (1000 * count + damp[docs]))
        most = np.maximum.reduceat(adds, edges[:-1]).tolist()
        d, a = docs.tolist(), adds.tolist()
        for i, (term, low, high) in enumerate(zip(names, edges.tolist(), edges[1:].tolist())):
            kth = int(np.partition(adds[low:high], high - low - k)[high - low - k]) if high - low >= k else 0
            self.lists[term] = Postings(d[low:high], a[low:high], most[i], kth, dict(zip(d[low:high], a[low:high])))

    def rank(self, asked: list[str], k: int, best: list[tuple[int, int]]) -> None:
        """Brings an item's best results, a heap of (score, -doc_id), up to date with this shard."""
        lists = sorted((self.lists[t] for t in asked if t in self.lists), key=lambda x: x.most)
        if not lists:
            return
        ids, n = self.ids, len(lists)
        reach = [0]  # what the first lists can add together
        for x in lists:
            reach.append(reach[-1] + x.most)
        # k documents of one list have its kth addend at least.
        least = max(x.kth for x in lists)
        if len(best) == k:
            least = max(least, best[0][0])
        out = 0  # lists before this one are out of the merge
        while out < n and reach[out + 1] < least:
            out += 1
        heads = [x.docs[0] * n + t for t, x in enumerate(lists) if t >= out]
        heapq.heapify(heads)
        at = [0] * n
        while heads:
            doc, t = divmod(heads[0], n)
            score, head = 0, doc * n + n
            while True:
                x = lists[t]
                place = at[t]
                if t >= out:
                    score += x.adds[place]
                    at[t] = place = place + 1
                    if place < len(x.docs):
                        heapq.heapreplace(heads, x.docs[place] * n + t)
                    else:
                        heapq.heappop(heads)
                else:
                    heapq.heappop(heads)
                if not heads or heads[0] >= head:
                    break
                t = heads[0] % n
            if not score:
                continue  # only lists that have left the merge
            for t in range(out - 1, -1, -1):
                if score + reach[t + 1] < least:
                    break
                score += lists[t].of.get(doc, 0)
            if score < least:
                continue
            entry = (score, -ids[doc])
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
            if len(best) == k and best[0][0] > least:
                least = best[0][0]
                while out < n and reach[out + 1] < least:
                    out += 1


def asked_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item_id and term, each pair once."""
    rows = small_batches(items).where(F.col(key).isNotNull()).select(F.col(key).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                edges, codes, dictionary = terms(part.column("text"))
                of = np.repeat(np.arange(part.num_rows), np.diff(edges))
                yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(of)), dictionary.take(pa.array(codes)).cast(pa.string())], ["item_id", "term"])

    return rows.mapInArrow(run, f"item_id {rows.schema['item_id'].dataType.simpleString()}, term string").distinct()


def search(index: DataFrame, asked: DataFrame, k: int = 50, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 for each item of asked (item_id, term)."""
    spark = index.sparkSession
    asked = materialize(asked)
    kind = asked.schema["item_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    n, total = index.where("term IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    blocks = -(-asked.count() // block)
    for b in range(blocks if total else 0):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        vocabulary = F.broadcast(part.select("term").distinct())  # block rows, but for items of more terms
        lists = index.where("term IS NOT NULL").join(vocabulary, "term", "left_semi")
        w = F.floor(1000 * F.log(F.lit(2 * n + 2) / (2 * F.sum("df") + 1)))
        weights = {r["term"]: r["w"] for r in lists.groupBy("term").agg(w.alias("w")).toLocalIterator()}
        pairs = part.toArrow().to_pylist()
        wanted: dict = {}
        for p in pairs:
            if weights.get(p["term"], 0) > 0:
                wanted.setdefault(p["item_id"], []).append(p["term"])
        sent = spark.sparkContext.broadcast((weights, wanted))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            weights, wanted = sent.value
            best: dict = {i: [] for i in wanted}

            def take(parts: list[pa.RecordBatch]) -> None:
                shard = Shard(pa.Table.from_batches(parts), weights, n, total, k)
                for item, words in wanted.items():
                    shard.rank(words, k, best[item])

            parts: list[pa.RecordBatch] = []
            for batch in batches:
                shards = batch.column("shard").to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
                for a, z in zip(edges, edges[1:]):
                    if parts and z > a and parts[0].column("shard")[0].as_py() != shards[a]:
                        take(parts)
                        parts = []
                    if z > a:
                        parts.append(batch.slice(a, z - a))
            if parts:
                take(parts)
            rows = [(item, -d, s) for item, heap in best.items() for s, d in heap if s > 0]
            types = (pa.array([r[0] for r in rows], pairs_type), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays(list(types), ["item_id", "doc_id", "score"])

        pairs_type = part.limit(0).toArrow().schema.field("item_id").type
        both = lists.unionByName(index.where("term IS NULL")).drop("total")
        dealt = small_batches(both).repartition(1 + total // PART, "shard").sortWithinPartitions("shard")
        found = found.unionByName(dealt.mapInArrow(run, f"item_id {kind}, doc_id long, score long"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each item of benchmark."""
    return search(build(read(spark, sf_dir, "documents")), asked_terms(read(spark, sf_dir, "benchmark")))


ORACLE = r"""
WITH tok AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE doc_id IS NOT NULL
), one AS (SELECT row_number() OVER () AS row, doc_id, coalesce(len(t), 0) AS n, t FROM tok
), st AS (SELECT count(*) FILTER (n > 0) AS docs, CAST(sum(n) AS BIGINT) AS total FROM one
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL
), post AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(t) AS term FROM one) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM post GROUP BY term), st
), added AS (
  SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total))) AS x FROM post JOIN weight USING (term), st
), scored AS (
  SELECT item_id, row, doc_id, CAST(sum(x) AS BIGINT) AS score FROM asked JOIN added USING (term) GROUP BY ALL HAVING sum(x) > 0
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored QUALIFY rank <= 50
"""
