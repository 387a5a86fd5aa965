r"""Substring dedup by level-wise doubling.

A level has a length in words. Windows of the first level (half of the target, rounded up) that start in more than one
document are found; only pairs of them at the right distance are extended to a window of twice that length, at most
the target. A window that does not repeat at one level is never looked at again. At the target, each window learns the
smallest document it starts in; it is a repeat in every other one, and the words that repeats cover are removed.

Documents are dealt into chunks by a hash of their id, and data moves as buffers between chunks and buckets of window
names, not as rows: a chunk sends a bucket its sorted names in one buffer, and the bucket answers with those that
repeat. The first level is a filter: its names have 32 bits beside the bucket's, and two windows that share one are only
let through to the next level. The target's names have 96 bits. Texts cross the network once: all three
uses of a chunk read the same exchange. A chunk and a bucket hold about CHUNK bytes of text and BUCKET names, whatever
the size of the corpus, and a window that very many documents share is one name in each chunk.

Cases: null and empty texts have no words and are returned. A document without an id is returned whole and repeats
nothing; such rows stay where they are and meet no others. Rows that share a doc_id are one document: none is a repeat of another. Long texts are handled whole. Words
are runs without blanks and the characters \x09 to \x0D, as they are. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import read, slices, small_batches, worker_store
from sievework.llm.words import doubled, half_of, joined, names, split, windows

#: Words of a window; bytes of text in a chunk and window names in a bucket, roughly, up to START bytes of text in all;
#: how many times larger both may get beyond.
WINDOW, CHUNK, BUCKET, START, WIDE = 13, 4 << 20, 3_000_000, 8 << 30, 4


def within(values: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Which of values occur in kept (sorted)."""
    if not len(kept):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(kept, values), len(kept) - 1)
    return kept[at] == values


def paired(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the names (a, b) occur among (x, y)."""
    out = np.zeros(len(a), dtype=bool)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    at = np.searchsorted(x, a)
    todo = np.flatnonzero(at < len(x))
    while len(todo):  # once, but for names that share their 64 bits
        todo = todo[x[at[todo]] == a[todo]]
        same = y[at[todo]] == b[todo]
        out[todo[same]] = True
        todo = todo[~same]
        at[todo] += 1
        todo = todo[at[todo] < len(x)]
    return out


def keyed(window: np.ndarray, buckets: int) -> np.ndarray:
    """bucket << 32 | 32 bits of the name, in the order of names: the upper 64 bits of name * buckets, cut to the left of
    the 32 bits that follow the point, for any number of buckets below 2^32."""
    n, low = np.uint64(buckets), np.uint64(0xFFFFFFFF)
    return (window >> np.uint64(32)) * n + (((window & low) * n) >> np.uint64(32))


def folded(values: np.ndarray) -> bytes:
    """Bytes of numbers plane by plane, which the exchange compresses better."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def unfolded(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def steps(values: np.ndarray) -> bytes:
    """Sorted numbers by their differences."""
    return folded(np.diff(values, prepend=values.dtype.type(0)))


def summed(data: bytes, kind: str) -> np.ndarray:
    return np.cumsum(unfolded(data, kind), dtype=kind)


class Chunk:
    """The words of a chunk's documents in one array, documents by id."""

    def __init__(self, table: pa.Table, target: int):
        worker_store("substring")
        ids = table.column("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        self.ids = [ids[i] for i in order]
        self.rest = table.column("rest").take(pa.array(order, pa.int64())) if "rest" in table.column_names else None
        self.edges, self.codes, self.dictionary = split(table.column("text").take(pa.array(order, pa.int64())))
        self.target, self.half = target, half_of(target)
        self.doc = np.repeat(np.arange(len(ids)), np.diff(self.edges))
        known = np.array([i is not None for i in self.ids], dtype=bool)
        self.key = np.array([i or 0 for i in self.ids], dtype=np.int64)[self.doc]
        # Words from each on to the end of its document; none where the document has no id.
        self.room = np.where(known[self.doc], self.edges[self.doc + 1] - np.arange(len(self.doc)), 0)
        self.first, self.second = np.ascontiguousarray(names(self.dictionary)[self.codes].T)
        self.halves = windows(self.first, self.half)

    def halves_sent(self) -> np.ndarray:
        """Sorted names of the first level; one that several documents have is there twice."""
        at = np.flatnonzero(self.room[: len(self.halves)] >= self.half)
        found, doc = self.halves[at], self.key[at]
        order = np.argsort(found, kind="stable")  # documents stay in their order
        found, doc = found[order], doc[order]
        new = np.ones(len(found), dtype=bool)
        new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
        found = found[new]
        third = np.zeros(len(found), dtype=bool)
        third[2:] = found[2:] == found[:-2]
        return found[~third]

    def targets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where windows of the target begin, and their two names."""
        a, b = doubled(self.halves, self.half, self.target), windows(self.second, self.target)
        at = np.flatnonzero(self.room[: len(a)] >= self.target)
        return at, a[at], b[at]

    def survivors(self, kept: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names (64 and 32 bits) of windows of the target whose halves both repeat, and the smallest document of each."""
        at, a, b = self.targets()
        ok = within(keyed(self.halves, buckets), kept)
        keep = ok[at] & ok[at + self.target - self.half]
        a, b, doc = a[keep], (b[keep] >> np.uint64(32)).astype(np.uint32), self.key[at[keep]]
        order = np.lexsort((doc, b, a))
        a, b, doc = a[order], b[order], doc[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return a[new], b[new], doc[new]

    def repeats(self, a_else: np.ndarray, b_else: np.ndarray) -> np.ndarray:
        """Where windows begin that also start in a smaller document: of this chunk, or elsewhere (their two names)."""
        at, a, b = self.targets()
        b = (b >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((b, a))  # documents stay in their order
        x, y, key = a[order], b[order], self.key[at[order]]
        begin = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else np.zeros(0, np.int64)
        lead = np.repeat(begin, np.diff(np.append(begin, len(x))))
        gone = np.zeros(len(a), dtype=bool)
        gone[order] = key > key[lead]
        gone |= paired(a, b, a_else, b_else)
        return at[gone]

    def kept(self, starts: np.ndarray) -> pa.Table:
        cover = np.zeros(len(self.doc) + 1, dtype=np.int64)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + self.target, -1)
        gone = np.cumsum(cover)[:-1] > 0
        left = np.concatenate([[0], np.cumsum(~gone)])[self.edges]
        texts = joined(left, self.codes[~gone], self.dictionary)
        n_words = np.diff(self.edges)
        n_removed = n_words - np.diff(left)
        out = {"doc_id": pa.array(self.ids, pa.int64()), "n_words": pa.array(n_words), "n_removed": pa.array(n_removed), "kept": texts}
        return pa.table(out | ({} if self.rest is None else {"rest": self.rest}))


def by_bucket(bucket: np.ndarray, chunk: int, columns: list, pack: list) -> pa.Table:
    """One row for each bucket; bucket ascends."""
    each, begin = np.unique(bucket, return_index=True)
    edges = np.append(begin, len(bucket))
    cuts = [pa.array([f(c[a:b]) for a, b in zip(edges, edges[1:])], pa.binary()) for c, f in zip(columns, pack)]
    return pa.table([pa.array(each.astype(np.int64)), pa.array(np.full(len(each), chunk, dtype=np.int64)), *cuts], ["bucket", "chunk", *"abc"[: len(cuts)]])


def dedup(docs: DataFrame, target: int = WINDOW, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, bucket: int = BUCKET, carry: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept: every document without the words of windows that start in a smaller one.
    With carry, the other columns come along in the struct `rest`."""
    others = [c for c in docs.columns if c not in (key, text)] if carry else []
    rest = [F.struct(*others).alias("rest")] if others else []
    rows = small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *rest)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one number
    # A chunk sends each bucket one row. Both grow with the square root of the text, up to WIDE times, which keeps the
    # number of rows in proportion to the text until then.
    wide = max(1.0, min(float(WIDE), (size / START) ** 0.5))
    chunks, buckets = 1 + int(size / (chunk * wide)), 1 + int(size / 6 / (bucket * wide))
    named = rows.where("doc_id IS NOT NULL")
    dealt = named.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks))).groupBy("chunk")

    def send_halves(table: pa.Table) -> pa.Table:
        sent = keyed(Chunk(table, target).halves_sent(), buckets)
        return by_bucket(sent >> np.uint64(32), table.column("chunk")[0].as_py(), [sent.astype(np.uint32)], [steps])

    def answer_halves(table: pa.Table) -> pa.Table:
        sent = [summed(x, "<u4") for x in table.column("a").to_pylist()]
        every = np.sort(np.concatenate(sent))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        found = [np.unique(x[within(x, twice)]) for x in sent]
        return pa.table([table.column("chunk"), table.column("bucket"), pa.array([steps(x) for x in found], pa.binary())], ["chunk", "bucket", "a"])

    def kept_halves(table: pa.Table) -> np.ndarray:
        parts = sorted(zip(table.column("bucket").to_pylist(), table.column("a").to_pylist()))
        return np.concatenate([np.zeros(0, np.uint64), *(summed(x, "<u4").astype(np.uint64) + (np.uint64(b) << np.uint64(32)) for b, x in parts)])

    def send_targets(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, doc = Chunk(left, target).survivors(kept_halves(right), buckets)
        return by_bucket(keyed(a, buckets) >> np.uint64(32), left.column("chunk")[0].as_py(), [a, b, doc], [steps, folded, folded])

    def answer_targets(table: pa.Table) -> pa.Table:
        a, b, doc = ([f(x, kind) for x in table.column(c).to_pylist()] for c, kind, f in (("a", "<u8", summed), ("b", "<u4", unfolded), ("c", "<i8", unfolded)))
        edges = np.cumsum([len(x) for x in a])[:-1]
        a, b, doc = np.concatenate(a), np.concatenate(b), np.concatenate(doc)
        order = np.lexsort((doc, b, a))
        x, y = a[order], b[order]
        begin = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        lead = np.repeat(doc[order][begin], np.diff(np.append(begin, len(x))))
        later = np.zeros(len(a), dtype=bool)
        later[order] = doc[order] > lead
        found = [(x[z], y[z]) for x, y, z in zip(np.split(a, edges), np.split(b, edges), np.split(later, edges))]
        return pa.table([table.column("chunk"), table.column("bucket"), *(pa.array(x, pa.binary()) for x in ([steps(x) for x, _ in found], [folded(y) for _, y in found]))], ["chunk", "bucket", "a", "b"])

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = Chunk(left, target)
        a = np.concatenate([np.zeros(0, np.uint64), *(summed(x, "<u8") for x in right.column("a").to_pylist())])
        b = np.concatenate([np.zeros(0, np.uint32), *(unfolded(x, "<u4") for x in right.column("b").to_pylist())])
        return parts.kept(parts.repeats(a, b))

    replies = "chunk long, bucket long, a binary"
    halves = dealt.applyInArrow(send_halves, "bucket long, chunk long, a binary").groupBy("bucket").applyInArrow(answer_halves, replies)
    targets = dealt.cogroup(halves.groupBy("chunk")).applyInArrow(send_targets, "bucket long, chunk long, a binary, b binary, c binary").groupBy("bucket").applyInArrow(answer_targets, f"{replies}, b binary")
    schema = "doc_id long, n_words long, n_removed long, kept string" + (f", rest {rows.schema['rest'].dataType.simpleString()}" if rest else "")
    done = dealt.cogroup(targets.groupBy("chunk")).applyInArrow(remove, schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield from Chunk(pa.Table.from_batches([part]), target).kept(np.zeros(0, np.int64)).to_batches()

    return done.unionByName(rows.where("doc_id IS NULL").mapInArrow(whole, schema))  # they meet no other document


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without repeated 13-word windows."""
    return dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
