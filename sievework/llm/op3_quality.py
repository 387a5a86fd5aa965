"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled documents (SAMPLE of each label) is turned into hashed term weights: words, and the shapes
of words, where letters of a kind, digits and repeats are folded, and whether a word repeats the one before it. A run
of more than LONG characters without blanks, as in scripts that write none, is a word like any other and gives terms for
each PIECE characters in a row besides, from its beginning to its end. A
truncated singular value decomposition of the sample gives the latent space. Its labelled vectors are broadcast (their
size is fixed by SAMPLE and RANK); every document is folded into the space, its exact cosines with all of them are
computed in blocks, and its nearest neighbours vote with their similarity. Votes are weighted back to the labels'
shares among all labelled documents, since the sample holds both labels alike.

Cases: a document without an id is not held out, and none of its labels is known. A null, empty or blank text has no vector and scores the share of label 1; so does a text without any similar
neighbour. Null labels are not used; of labels for one document the greatest counts. Repeated rows are scored alike.
Without usable labels every score is 0.5. Other columns of the input are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import read, slices, small_batches, texts, worker_store
from sievework.llm.words import split

#: Labelled documents of each label that the model is fitted on, dimensions of the space, neighbours that vote.
SAMPLE, RANK, NEIGHBOURS = 1500, 48, 15
#: Hash buckets of words and of shapes; weight of words beside shapes; votes are similarity to this power.
WORDS, SHAPES, WORD_WEIGHT, SHARPNESS = 4096, 1024, 0.25, 8
CACHE = 300_000
#: Documents whose terms are counted together.
ROWS = 200
#: Characters of a word above which its pieces count besides, and of a piece.
LONG, PIECE = 64, 2
FOLD = ((re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]{2,}"), "B"), (re.compile(r"[A-ZÀ-ÖØ-Þ]"), "A"), (re.compile(r"\d+"), "0"), (re.compile(r"([^\w\s])\1+"), r"\1\1"))
DIM = WORDS + SHAPES + 2


def terms_of(word: str) -> tuple[int, int]:
    """Hash buckets of a word and of its shape."""
    shape = word
    for pattern, sign in FOLD:
        shape = pattern.sub(sign, shape)
    return zlib.crc32(word.lower().strip(".,").encode()) % WORDS, WORDS + zlib.crc32(shape.encode()) % SHAPES


def terms_of_run(run: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the pieces of a long run, with their numbers."""
    pieces = Counter(run[i : i + PIECE] for i in range(len(run) - PIECE + 1))
    terms = np.array([terms_of(p) for p in pieces]).ravel()
    return terms, np.repeat(np.fromiter(pieces.values(), dtype=np.int64, count=len(pieces)), 2)


def weights(column: pa.Array) -> np.ndarray:
    """Term counts of whole texts, damped: (documents, DIM)."""
    edges, codes, dictionary = split(column)
    words = dictionary.to_pylist()
    store = worker_store("quality")
    if len(store) > CACHE:
        store.clear()
    long = [i for i, w in enumerate(words) if len(w) > LONG]
    for w in words:
        if w not in store:
            a, b = terms_of(w)
            store[w] = a * DIM + b
    every = np.fromiter((store[w] for w in words), dtype=np.int64, count=len(words))
    for i in long:  # they are not kept
        store.pop(words[i], None)
    pair = every[codes]
    n = len(edges) - 1
    doc = np.repeat(np.arange(n), np.diff(edges)) * DIM
    out = np.bincount(doc + pair // DIM, minlength=n * DIM) + np.bincount(doc + pair % DIM, minlength=n * DIM)
    if long:
        runs = np.zeros(len(words), dtype=bool)
        runs[long] = True
        at = np.flatnonzero(runs[codes])
        order = at[np.argsort(codes[at], kind="stable")]  # terms of a run that comes again are made once
        last = -1
        for i in order.tolist():
            if codes[i] != last:
                last = codes[i]
                terms, times = terms_of_run(words[last])
            np.add.at(out, doc[i] + terms, times)
    out = out.reshape(n, DIM).astype(np.float32)
    same = np.flatnonzero((codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])) + 1
    repeats = np.bincount(doc[same] // DIM, minlength=n)
    out[:, DIM - 2] = repeats
    out[:, DIM - 1] = np.maximum(np.diff(edges) - repeats, 0)
    return np.sqrt(out)


class Space:
    """The fitted model: term weights, projection, labelled vectors."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, share: float):
        """x: weights() of the sample."""
        self.share = share
        n = max(1, len(x))
        self.idf = np.log((n + 1) / ((x > 0).sum(axis=0) + 1)).astype(np.float32) + 0.1
        self.idf[:WORDS] *= WORD_WEIGHT
        x = x * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        # Randomised range finder with power steps, then an exact decomposition of the small matrix.
        rng = np.random.default_rng(0)
        y = x @ rng.normal(size=(DIM, min(RANK + 16, n))).astype(np.float32)
        for _ in range(3):
            y = x @ (x.T @ np.linalg.qr(y)[0])
        q = np.linalg.qr(y)[0]
        _, _, v = np.linalg.svd(q.T @ x, full_matrices=False)
        self.axes = np.ascontiguousarray(v[:RANK].T)
        z = x @ self.axes
        self.vectors = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        self.labels = labels.astype(np.float32)
        ones = float(labels.mean()) if len(labels) else 0.5
        self.vote = np.where(labels == 1, share / max(ones, 1e-9), (1 - share) / max(1 - ones, 1e-9)).astype(np.float32)

    def score(self, batch: pa.Array) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(batch), 0.5)
        z = (weights(batch) * self.idf) @ self.axes
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        near = (z / np.maximum(norm, 1e-12)) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(near, at, axis=1), 0).astype(np.float64) ** SHARPNESS * self.vote[at]
        total = w.sum(axis=1)
        score = np.where(total > 1e-12, (w * self.labels[at]).sum(axis=1) / np.maximum(total, 1e-12), self.share)
        return np.clip(np.where(norm[:, 0] > 1e-12, score, self.share), 0, 1)


def held_out(key: Column) -> Column:
    """Documents whose labels are never learned."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "quality") -> Space:
    """The model from at most `sample` labelled documents of each label, taken in hash order."""
    spark = docs.sparkSession
    known = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("y")).where("y IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y")).where(~held_out(F.col("doc_id")))
    known = known.join(docs.select(F.col(key).alias("doc_id")), "doc_id", "left_semi")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Space(np.zeros((0, DIM), np.float32), np.zeros(0), 0.5)
    some = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    chosen = some[0].unionByName(some[1])
    found = texts(docs, key, text).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                for a in range(0, part.num_rows, ROWS):
                    some = part.slice(a, ROWS)
                    x = [(np.flatnonzero(w), w) for w in weights(some.column("text"))]
                    at, value = (pa.array(v, pa.binary()) for v in ([i.astype("<u2").tobytes() for i, _ in x], [w[i].tobytes() for i, w in x]))
                    yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("y"), at, value], ["doc_id", "y", "at", "value"])

    # At most 2 * sample rows, each of at most DIM numbers however long its text is.
    rows = found.mapInArrow(run, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, y int, at binary, value binary").orderBy("doc_id").collect()
    x = np.zeros((len(rows), DIM), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["value"], np.float32)
    return Space(x, np.array([r["y"] for r in rows]), counts.get(1, 0) / sum(counts.values()))


def scored(docs: DataFrame, space: Space, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every document."""
    sent = small_batches(docs).sparkSession.sparkContext.broadcast(space)  # fixed by SAMPLE, RANK and DIM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                for a in range(0, part.num_rows, ROWS):
                    some = part.slice(a, ROWS)
                    yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(sent.value.score(some.column("text")).astype(np.float64))], ["doc_id", "score"])

    rows = texts(docs, key, text)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def good(docs: DataFrame, space: Space, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score is at least `least`."""
    sent = small_batches(docs).sparkSession.sparkContext.broadcast(space)  # fixed by SAMPLE, RANK and DIM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 2 << 20):
                for a in range(0, part.num_rows, ROWS):
                    some = part.slice(a, ROWS)
                    scores = sent.value.score(some.column(text))
                    yield some.filter(pa.array(scores >= least))

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document; labels of held-out documents are never seen."""
    docs = read(spark, sf_dir, "documents")
    space = fit(docs, read(spark, sf_dir, "labels"))
    return scored(docs, space).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
