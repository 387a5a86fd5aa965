"""N-gram Jaccard join with Bayesian candidate pruning.

Documents with the same words are one class. Each class has a set of word shingles, 128 MinHash values and, of those,
a sketch of one byte each. Classes that share all values of one of 32 bands are candidates: a pair at the threshold of
0.8 is missed with a probability below 5e-8. The sketches of a candidate pair are compared a few values at a time;
after each step the posterior of the similarity, given the number of equal values so far and a uniform prior, tells
how likely it still reaches the threshold, and the pair is dropped when that is below TOLERANCE. What survives
connects classes to clusters, and inside a cluster all pairs go through the same pruning and are then verified exactly
on their shingle sets.

Buckets and clusters of any size are handled: one of more than BLOCK members, or of more than BYTES of shingle sets, is
dealt into blocks, and each pair of blocks is a group of its own, which bounds what a task holds. Pairs stay inside a task; it passes on one row for each
linked class of a group, with its number of links and the least class that it is connected to.

Cases: words are runs without white space. A text of fewer words than a shingle has one shingle, all its words; a null
or empty text has none and no links, though empty texts are copies of each other. Rows without a doc_id are left out;
of rows that share one, the text with the greatest digest counts. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import materialize, read, slices, texts, worker_store
from sievework.llm.components import components
from sievework.llm.words import mix, names, split, windows

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Values compared before each look at the posterior, and members of a bucket or cluster that are compared together.
STEPS, BLOCK = (8, 16, 32, 64, 128), 512
#: Bytes of shingle sets in a block of a cluster, roughly.
BYTES = 8 << 20
SEEDS = np.random.default_rng(11).integers(1, 1 << 63, size=(2, HASHES), dtype=np.uint64) | np.uint64(1)


def sets_of(column: pa.Array, n: int) -> tuple[list[bytes], list[np.ndarray]]:
    """The digest of each text's words and its distinct shingle names, sorted."""
    worker_store("jaccard")
    edges, codes, dictionary = split(column)
    both = names(dictionary)[codes]
    first = np.ascontiguousarray(both[:, 0])
    words = [(a, b) for a, b in zip(edges.tolist(), edges[1:].tolist())]
    digests = [hashlib.blake2b(both[a:b].tobytes(), digest_size=16).digest() for a, b in words]
    # Windows of the whole column at once; those that would cross from one text into the next are left out.
    every = windows(first, n)
    sets = [np.unique(every[a : b - n + 1]) if b - a >= n else windows(first[a:b], b - a) if b > a else first[:0] for a, b in words]
    return digests, sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of each set: (sets, HASHES); empty sets have the greatest value throughout."""
    out = np.full((len(sets), HASHES), np.iinfo(np.uint32).max, dtype=np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = mix(np.concatenate([sets[i] for i in full]))
        at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        for j in range(HASHES):
            out[full, j] = np.minimum.reduceat(flat * SEEDS[0, j] + SEEDS[1, j], at) >> np.uint64(32)
    return out


def limits(threshold: float, tolerance: float) -> np.ndarray:
    """The least number of equal values at each of STEPS with which a pair stays: below it the posterior probability
    that the similarity reaches the threshold is under the tolerance. Bytes are also equal by chance."""
    s = np.linspace(0, 1, 2001)
    p = np.clip(s + (1 - s) / 256, 1e-12, 1 - 1e-12)
    out = []
    for n in STEPS:
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log1p(-p)
        like = np.exp(log - log.max(axis=1, keepdims=True))
        tail = like[:, s >= threshold].sum(axis=1) / like.sum(axis=1)
        out.append(int(np.argmax(tail >= tolerance)))
    return np.array(out)


def prune(left: np.ndarray, right: np.ndarray, sketch: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which pairs (rows of sketch) stay."""
    alive, equal, done = np.arange(len(left)), np.zeros(len(left), dtype=np.int32), 0
    for n, m in zip(STEPS, least):
        equal = equal[:] + (sketch[left[alive], done:n] == sketch[right[alive], done:n]).sum(axis=1, dtype=np.int32)
        keep = equal >= m
        alive, equal, done = alive[keep], equal[keep], n
    return alive


def pairs_of(size: int, first: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a group; of one made of two blocks, only pairs across (first marks the first block, None one block)."""
    if first is None:
        return np.triu_indices(size, 1)
    a, b = np.flatnonzero(first), np.flatnonzero(~first)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def survivors(sketch: np.ndarray, first: np.ndarray | None, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    left, right = pairs_of(len(sketch), first)
    kept = [(left[a : a + 100_000], right[a : a + 100_000]) for a in range(0, len(left), 100_000)]
    kept = [(x[k], y[k]) for x, y in kept for k in (prune(x, y, sketch, least),)]
    return tuple(np.concatenate(z) for z in zip(*kept)) if kept else (left[:0], right[:0])


def roots(nodes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least node that each is connected to."""
    root = np.argsort(np.argsort(nodes, kind="stable"), kind="stable")
    back = np.sort(nodes)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        order = np.argsort(nodes, kind="stable")
        new = np.minimum(new, new[order[new]])
        if (new == root).all():
            return back[root]
        root = new


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold, by their exact intersections."""
    size = np.array([len(s) for s in sets])
    if len(left) <= 64:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right)], dtype=np.int64)
    else:
        used = np.unique(np.concatenate([left, right]))
        place = np.zeros(len(sets), dtype=np.int64)
        place[used] = np.arange(len(used))
        flat = np.concatenate([sets[i] for i in used])
        owner = np.repeat(np.arange(len(used)), size[used])
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = np.cumsum(count > 1) - 1
        keep = count[column] > 1
        owner, column = owner[keep], shared[column[keep]]
        total = np.zeros((len(used), len(used)), dtype=np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
            a, b = np.searchsorted(column, [start, start + 8192])
            part = np.zeros((len(used), 8192), dtype=np.float32)
            part[owner[a:b], column[a:b] - start] = 1
            total += part @ part.T
        both = total[place[left], place[right]].astype(np.int64)
    union = size[left] + size[right] - both
    return (both > 0) & (both >= threshold * union - 1e-9)


# ---- the stages ---------------------------------------------------------------------------------------------------


def described(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, digest, size, signature of every document with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                digests, sets = sets_of(part.column("text"), n)
                sig = signatures(sets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sig], pa.binary())], ["doc_id", "digest", "size", "signature"])

    return docs.mapInArrow(run, "doc_id long, digest binary, size int, signature binary")


def banded(classes: DataFrame) -> DataFrame:
    """key, node: a row for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.full(sig.shape[:2], 1, np.uint64) * np.arange(1, BANDS + 1, dtype=np.uint64)
            for i in range(ROWS):
                key = mix(key * np.uint64(3) + sig[:, :, i])
            node = np.repeat(batch.column("node").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(node)], ["key", "node"])

    return classes.where("size > 0").select("node", "signature").mapInArrow(run, "key long, node long")


def dealt(members: DataFrame, key: str, sizes: DataFrame | None = None) -> DataFrame:
    """members (key, node, ...) of groups of two or more, with i, j, first: a group of more than BLOCK is dealt into
    blocks, and each pair of blocks i <= j is a group; first tells members of block i. With sizes (key, size of each
    member's set), a block has about BYTES of sets at most as well."""
    rows = members if sizes is None else sizes
    blocks = F.ceil(F.count("*") / BLOCK)
    if sizes is not None:
        blocks = F.greatest(blocks, F.least(F.count("*"), F.ceil(F.sum("size") * 8 / BYTES)))
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"), blocks.cast("int").alias("_blocks")).where("_n > 1").select(key, "_blocks")
    at = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    rows = members.join(counts, key).withColumn("_at", at).withColumn("_to", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return rows.select(*members.columns, F.least("_at", "_to").alias("i"), F.greatest("_at", "_to").alias("j"), (F.col("_at") <= F.col("_to")).alias("first"))


def together(rows: DataFrame, key: str) -> DataFrame:
    """Groups (key, i, j) side by side in their partitions."""
    return rows.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the row at which each begins; the last group of a batch waits for the next one."""
    rest: pa.Table | None = None

    def edges(t: pa.Table) -> np.ndarray:
        ids = np.stack([t.column(c).to_numpy() for c in (key, "i", "j")])
        return np.concatenate([[0], np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        at = edges(t)
        if len(at) > 1:
            yield t.slice(0, at[-1]).combine_chunks(), np.append(at[:-1], at[-1])
        rest = t.slice(at[-1])
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), np.array([0, rest.num_rows])


def connected(members: DataFrame, least: np.ndarray) -> DataFrame:
    """a, b: each member of a bucket and the least one that unpruned pairs connect it to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in groups(batches, "key"):
            node, first, i, j = (t.column(c).to_numpy(zero_copy_only=False) for c in ("node", "first", "i", "j"))
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, HASHES)
            size, left, right = np.diff(at), [], []
            for s in np.unique(size[(size > 1) & (size <= 16)]).tolist():  # all groups of one size at once
                begin = at[:-1][size == s]
                a, b = np.triu_indices(s, 1)
                left.append((begin[:, None] + a).ravel())
                right.append((begin[:, None] + b).ravel())
            x, y = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (left, right))
            keep = prune(x, y, sketch, least)
            found = [(x[keep], y[keep])]
            for g in np.flatnonzero(size > 16).tolist():
                span = slice(at[g], at[g + 1])
                a, b = survivors(sketch[span], None if i[at[g]] == j[at[g]] else first[span], least)
                r = roots(node[span], a, b)
                where = np.flatnonzero(r != node[span])
                yield pa.RecordBatch.from_arrays([pa.array(node[span][where]), pa.array(r[where])], ["a", "b"])
            a, b = (np.concatenate(z) for z in zip(*found))
            if len(a):
                pair = np.unique(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 1].copy()), pa.array(pair[:, 0].copy())], ["a", "b"])

    return together(dealt(members, "key"), "key").select("key", "i", "j", "first", "node", "sketch").mapInArrow(run, "a long, b long")


def verified(members: DataFrame, sizes: DataFrame, threshold: float, least: np.ndarray) -> DataFrame:
    """node, links, documents, root: of every linked class in a pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in groups(batches, "cluster"):
            node, first, copies, i, j = (t.column(c).to_numpy(zero_copy_only=False) for c in ("node", "first", "copies", "i", "j"))
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, HASHES)
            sets = [np.frombuffer(b, np.uint64) for b in t.column("set").to_pylist()]
            out = []
            for a, b in zip(at, at[1:]):
                x, y = survivors(sketch[a:b], None if i[a] == j[a] else first[a:b], least)
                ok = linked(sets[a:b], x, y, threshold)
                x, y = x[ok], y[ok]
                if len(x):
                    n = b - a
                    links = np.bincount(x, minlength=n) + np.bincount(y, minlength=n)
                    rows = np.bincount(x, weights=copies[a:b][y], minlength=n) + np.bincount(y, weights=copies[a:b][x], minlength=n)
                    has = links > 0
                    out.append((node[a:b][has], links[has], rows[has].astype(np.int64), roots(node[a:b], x, y)[has]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*out)], ["node", "links", "documents", "root"])

    return together(dealt(members, "cluster", sizes), "cluster").select("cluster", "i", "j", "first", "node", "copies", "sketch", "set").mapInArrow(run, "node long, links long, documents long, root long")


def join(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, tolerance: float = TOLERANCE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id (the least document with the same words), n_copies (rows of the class), n_links (other classes
    within the threshold), n_linked (their rows), group_id (the least class that links lead to, its own without any)."""
    rows = texts(docs, key, text).withColumn("doc_id", F.col("doc_id").cast("long")).where("doc_id IS NOT NULL")
    least = limits(threshold, tolerance)
    told = described(rows, shingle).groupBy("doc_id").agg(F.max(F.struct("digest", "size", "signature")).alias("d")).select("doc_id", "d.*")
    told = materialize(told)
    classes = told.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.max("size").alias("size"), F.max("signature").alias("signature"))
    classes = materialize(classes)

    bands = banded(classes)
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    inside = bands.join(shared, "key", "left_semi")
    sketches = sketched(classes)
    edges = connected(inside.join(sketches, "node").select("key", "node", "sketch"), least)
    clusters = components(edges).withColumnRenamed("root", "cluster")

    chosen = clusters.join(classes.select("node", "copies", "digest"), "node").join(sketches, "node")
    members = with_sets(rows, chosen, shingle)
    sizes = clusters.join(classes.select("node", "size"), "node").select("cluster", "size")
    found = materialize(verified(members, sizes, threshold, least))
    links = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("documents").alias("linked"))
    linked_groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    facts = links.join(linked_groups, "node", "left")
    per_class = classes.select("digest", "node", "copies").join(facts, "node", "left")
    zero = F.lit(0).cast("long")
    return told.select("doc_id", "digest").join(per_class, "digest").select("doc_id", F.col("node").alias("class_id"), F.col("copies").alias("n_copies"), F.coalesce("links", zero).alias("n_links"), F.coalesce("linked", zero).alias("n_linked"), F.coalesce("root", "node").alias("group_id"))


def sketched(classes: DataFrame) -> DataFrame:
    """node and the low byte of each MinHash value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).astype(np.uint8).reshape(-1, HASHES)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([x.tobytes() for x in low], pa.binary())], ["node", "sketch"])

    return classes.where("size > 0").select("node", "signature").mapInArrow(run, "node long, sketch binary")


def with_sets(rows: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """chosen with the shingle set of its class, from the text of its least document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                digests, sets = sets_of(part.column("text"), n)
                same = pa.array([a == b for a, b in zip(digests, part.column("digest").to_pylist())])
                cols = [part.column(c) for c in ("node", "cluster", "copies", "sketch")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "cluster", "copies", "sketch", "set"]).filter(same)

    joined = rows.withColumnRenamed("doc_id", "node").join(chosen, "node").select("node", "cluster", "copies", "digest", "sketch", "text")
    return joined.mapInArrow(run, "node long, cluster long, copies long, sketch binary, set binary").dropDuplicates(["node"])


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents: class and number of links of each."""
    return join(read(spark, sf_dir, "documents"))
