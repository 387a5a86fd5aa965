"""A stored inverted index in segments, with upserts, deletes, merges and top-k search that skips blocks.

A segment is written once. It has `docs` (id, dl, place, block, terms with their counts), `postings` (a row for each term
and block: its documents, the greatest count and the least length among them) and `terms` (df, in one or more rows of a
term, which add up). A block is BLOCK documents of like length of one segment, the same for all its terms, so that what a
block can score at most is a sum over the asked terms, and a frequent term is many rows that lie in many files (bucket by
term, and salt by the task that wrote the block).

An upsert writes a segment of the new documents alone and notes which ones they replace (`gone`: segment, place, id and dl
of them, and the counts of terms that they take along), so that it writes about as much as it is given. A merge rewrites
some segments as one without what is gone; documents with their terms are read file by file and told apart by their places,
and are not shuffled. Which segments and notes hold is said by the rows of the latest version in `manifest`, which are written
last: a write that is cut off changes nothing, and readers of an earlier version stay whole. There is one writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions.text import tokens
from sievework.operators.bm25 import B, K1, asked_terms
from sievework.session import materialize

#: Documents of a block, tokens of a bucket, most buckets, documents for each salt of a bucket, characters and tokens of a task.
BLOCK, BUCKET, BUCKETS, SALTED, CHARS, TOKENS = 128, 250_000, 4096, 1_000_000, 8 << 20, 1_500_000
#: Tokens of a task that writes lists, documents of a task that looks for ids, bytes of a merged segment's documents in a task.
LISTED, DEALT, SCANNED = 500_000, 1_000_000, 4 << 20
#: Lists that Spark is given at a time.
ROWS = 10_000
#: Segments from which an upsert merges the smaller half, question terms that are named to the scan, blocks scored first.
SEGMENTS, NAMED, FIRST = 10, 2000, 16
#: Ids of gone documents, or words of 64 marks at their places, that are sent to every task at most.
SENT = 500_000
MANIFEST = "version long, kind string, name string, segment string, buckets int, n long, total long"
COLUMNS = [c.split()[0] for c in MANIFEST.split(", ")]


def term_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, dl, terms (term, tf) of each document, counted within the row; of rows that share an id the greatest text
    counts, and rows without an id do not. Words of a batch are numbered in their order and counted as numbers. Texts are
    dealt by id, about CHARS to a task."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    dealt = docs.where(F.col(key).isNotNull()).select(F.col(key), F.col(text)).repartition(1 + size // CHARS, key)
    one = dealt.groupBy(F.col(key).alias("id")).agg(F.max(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    rows = one.select("id", tokens(F.col("text")).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column("t")
            words, code = _numbered(t.flatten())
            row = pc.list_parent_indices(t).to_numpy(zero_copy_only=False)
            pair, tf = np.unique(row * max(1, len(words)) + code, return_counts=True)
            row, code = np.divmod(pair, max(1, len(words)))
            starts = np.searchsorted(row, np.arange(len(t) + 1))
            terms = pa.StructArray.from_arrays([words.take(pa.array(code)), pa.array(tf, pa.int32())], ["term", "tf"])
            dl = pc.list_value_length(t).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), dl, pa.ListArray.from_arrays(pa.array(starts, pa.int32()), terms)], ["id", "dl", "terms"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"id {kind}, dl int, terms array<struct<term: string, tf: int>>")


def _numbered(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words in their order, and the place of each word among them."""
    held = words.dictionary_encode()
    order = pc.sort_indices(held.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return held.dictionary.take(pa.array(order)), place[held.indices.to_numpy(zero_copy_only=False)]


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of whole blocks, of about TOKENS tokens or a batch. Documents of a block follow each other."""
    held: list[pa.RecordBatch] = []
    tokens_held = 0
    for batch in batches:
        if not len(batch):
            continue
        block = batch.column("block")
        last = pc.index(block, block[-1]).as_py()  # the last block may go on
        tokens_held += pc.sum(batch.column("dl")).as_py()
        if tokens_held >= TOKENS and (last or (held and held[-1].column("block")[-1] != block[0])):
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held, batch = [], batch.slice(last)
            tokens_held = pc.sum(batch.column("dl")).as_py()
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


@dataclass(frozen=True)
class _Lists:
    """Lists of terms and blocks in the order of salts, buckets, terms and blocks: each one's word (a place in words),
    salt, block and first posting, and the postings' ids, tfs and dls in the order of ids."""

    words: pa.Array
    buckets: np.ndarray  # of words
    word: np.ndarray
    salt: np.ndarray
    block: np.ndarray
    starts: np.ndarray
    ids: pa.Array
    tfs: np.ndarray
    dls: np.ndarray


def _listed(rows: pa.Table, salts: int = 1) -> _Lists:
    """Lists of rows (id, dl, block, terms and, if they count, the buckets of terms)."""
    terms = rows.column("terms").combine_chunks()
    flat = terms.flatten()
    row = pc.list_parent_indices(terms).to_numpy(zero_copy_only=False)
    words, code = _numbered(flat.field("term"))
    buckets = np.zeros(len(words), np.int32)
    if "buckets" in rows.column_names:
        buckets[code] = rows.column("buckets").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(buckets, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    words, buckets, code = words.take(pa.array(order)), buckets[order], place[code]
    block = rows.column("block").to_numpy()
    each, number = np.unique(block, return_inverse=True)
    salt = (block * BLOCK >> 33) % salts  # blocks of a partition go together
    rank = np.empty(len(rows), np.int64)
    rank[pc.sort_indices(rows.column("id")).to_numpy()] = np.arange(len(rows))
    key = (salt[row] * max(1, len(words)) + code) * len(each) + number[row]
    order = np.lexsort((rank[row], key))
    key, row = key[order], row[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    ids = rows.column("id").combine_chunks().take(pa.array(row))
    tfs, dls = flat.field("tf").to_numpy(zero_copy_only=False)[order], rows.column("dl").to_numpy()[row]
    return _Lists(words, buckets, code[order][starts], salt[row[starts]], block[row[starts]], starts, ids, tfs.astype(np.int32), dls.astype(np.int32))


def block_lists(docs: DataFrame) -> DataFrame:
    """term, block, ids, tfs, dls (in the order of ids): a term's documents of each block. Documents
    of a block follow each other, so that lists are made where they are read; a block whose rows two tasks read (a file
    that is cut) has two lists of a term, which is right for searches and counts."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_blocks(batches):
            told = _listed(rows)
            ends = pa.array(np.r_[told.starts, len(told.ids)], pa.int32())
            held = (pa.ListArray.from_arrays(ends, values) for values in (told.ids, pa.array(told.tfs), pa.array(told.dls)))
            yield pa.RecordBatch.from_arrays([told.words.take(pa.array(told.word)), pa.array(told.block), *held], ["term", "block", "ids", "tfs", "dls"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "dl", "block", "terms").mapInArrow(lists, f"term string, block long, ids array<{kind}>, tfs array<int>, dls array<int>")


def _planes(values: np.ndarray) -> bytes:
    """Numbers as their first bytes, then their second ones and so on, which are much alike."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def _numbers(planes: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def dealt_lists(docs: DataFrame, buckets: int, salts: int, tasks: int) -> DataFrame:
    """term, block, docs (id, tf, dl in the order of ids), n, most_tf, least_dl, df, bucket: the lists of blocks, dealt by
    salt and bucket to about that many tasks, in the order of buckets, terms and blocks. What a task sends to another is
    one row of bytes. The first of a term's lists in a task has the df of them all, the others have none."""
    groups = min(buckets, -(-tasks // salts))  # of buckets that go together
    kind = docs.select("id").limit(0).toArrow().schema.field("id").type
    number = kind.to_pandas_dtype() if pa.types.is_integer(kind) else None
    sent = pa.schema([("term", pa.list_(pa.string())), ("id", pa.binary() if number else pa.list_(kind)), *((c, pa.binary()) for c in ("bucket", "lists", "block", "n", "tf", "dl"))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_blocks(batches):
            told = _listed(rows, salts)
            part = told.salt * groups + told.buckets[told.word].astype(np.int64) * groups // buckets
            ends = np.r_[told.starts, len(told.ids)]
            cuts = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)] if len(part) else []
            for low, high in zip(cuts[:-1], cuts[1:]):
                first, last = ends[low], ends[high]
                heads = np.flatnonzero(np.r_[True, told.word[low + 1 : high] != told.word[low : high - 1]])
                words = told.word[low:high][heads]
                ids = told.ids.slice(first, last - first)
                numbers = told.buckets[words], np.diff(np.r_[heads, high - low]).astype(np.int32), told.block[low:high], np.diff(ends[low : high + 1]).astype(np.int32), told.tfs[first:last], told.dls[first:last]
                columns = [
                    pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), told.words.take(pa.array(words))),
                    pa.array([_planes(ids.to_numpy(zero_copy_only=False))]) if number else pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    *(pa.array([_planes(n)]) for n in numbers),
                ]
                data = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, sent)], schema=sent).serialize()
                yield pa.RecordBatch.from_pydict({"part": pa.array([part[low]], pa.int32()), "size": pa.array([data.size]), "packed": [pa.compress(data, codec="zstd", asbytes=True)]})

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [
            pa.ipc.read_record_batch(pa.decompress(packed, decompressed_size=size, codec="zstd"), sent)
            for batch in batches
            for size, packed in zip(batch.column("size").to_pylist(), batch.column("packed").to_pylist())
        ]
        if not every:
            return
        of = lambda c, kind=np.int32: np.concatenate([_numbers(row.column(c)[0].as_py(), kind) for row in every])
        words, word = _numbered(pa.concat_arrays([row.column("term").flatten() for row in every]))
        each, n = of("lists"), of("n")
        word, bucket, block = np.repeat(word, each), np.repeat(of("bucket"), each), of("block", np.int64)
        order = np.lexsort((block, word, bucket))
        starts = np.cumsum(n) - n
        word, bucket, block, n, starts = word[order], bucket[order], block[order], n[order], starts[order]
        ends = np.r_[0, np.cumsum(n)]
        posting = np.repeat(starts - ends[:-1], n) + np.arange(ends[-1])
        tf, dl = of("tf")[posting], of("dl")[posting]
        ids = pa.array(of("id", number)[posting], kind) if number else pa.concat_arrays([row.column("id").flatten() for row in every]).take(pa.array(posting))
        heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        df, rest = np.zeros(len(n), np.int64), np.ones(len(n), bool)
        df[heads], rest[heads] = np.add.reduceat(n, heads, dtype=np.int64), False
        held = pa.StructArray.from_arrays([ids, pa.array(tf), pa.array(dl)], ["id", "tf", "dl"])
        lists = [words.take(pa.array(word)), pa.array(block), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held)]
        sums = pa.array(n, pa.int64()), pa.array(np.maximum.reduceat(tf, ends[:-1])), pa.array(np.minimum.reduceat(dl, ends[:-1])), pa.array(df, mask=rest), pa.array(bucket)
        told = pa.RecordBatch.from_arrays([*lists, *sums], ["term", "block", "docs", "n", "most_tf", "least_dl", "df", "bucket"])
        yield from (told.slice(i, ROWS) for i in range(0, len(told), ROWS))

    rows = docs.select("id", "dl", "block", "terms", F.transform("terms.term", lambda t: bucket_of(t, buckets)).alias("buckets"))
    moved = rows.mapInArrow(pack, "part int, size long, packed binary").repartitionById(groups * salts, "part")
    told = f"array<struct<id: {docs.schema['id'].dataType.simpleString()}, tf: int, dl: int>>"
    return moved.mapInArrow(unpack, f"term string, block long, docs {told}, n long, most_tf int, least_dl int, df long, bucket int")


@contextmanager
def _scans(spark: SparkSession, most: int | None = None) -> Iterator[None]:
    """Scans that run meanwhile read about `most` bytes in a task; without it one file, as it was written, and pack none
    together."""
    size, cost, least = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"
    told = {size: str(most), cost: str(most // 64), least: "1"} if most else {cost: spark.conf.get(size)}
    before = {key: spark.conf.get(key, None) for key in told}
    for key, value in told.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a term's count adds, before its weight; it grows with tf and falls with dl."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


@dataclass(frozen=True)
class Segments:
    """One version of an index. Changes return the next one."""

    spark: SparkSession
    path: str
    rows: tuple[Row, ...] = ()

    @staticmethod
    def open(spark: SparkSession, path: str) -> Segments:
        """The latest version at path; without any, an empty index."""
        try:
            every = spark.read.schema(MANIFEST).json(f"{path}/manifest")
        except AnalysisException:  # nothing has been published
            return Segments(spark, path)
        rows = every.join(every.agg(F.max("version").alias("version")), "version").collect()  # a few for each segment
        return Segments(spark, path, tuple(rows))

    @property
    def version(self) -> int:
        return max((r["version"] for r in self.rows), default=0)

    @property
    def segments(self) -> list[Row]:
        return [r for r in self.rows if r["kind"] == "segment"]

    @property
    def n(self) -> int:
        return sum(r["n"] if r["kind"] == "segment" else -r["n"] for r in self.rows if r["kind"] in ("segment", "gone"))

    @property
    def total(self) -> int:
        return sum(r["total"] if r["kind"] == "segment" else -r["total"] for r in self.rows if r["kind"] in ("segment", "gone"))

    # ---- changes ----------------------------------------------------------------------------------------------------

    def upsert(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> Segments:
        """With docs in place of what there is under their ids."""
        fresh = self._segment(term_counts(docs, key, text))
        gone = self._gone(self._docs([fresh["name"]]).select("id")) if self.rows else []
        after = self._publish([*self.rows, fresh, *gone])
        if len(after.segments) > SEGMENTS:
            after = after.merge([r["name"] for r in sorted(after.segments, key=lambda r: r["n"])[: len(after.segments) // 2 + 1]])
        return after

    def delete(self, ids: DataFrame) -> Segments:
        """Without the documents in ids (id)."""
        return self._publish([*self.rows, *self._gone(ids.select("id").distinct())])

    def merge(self, names: list[str] | None = None) -> Segments:
        """With these segments, or all of them, as one without what is gone."""
        names = names or [r["name"] for r in self.segments]
        if not names:
            return self
        fresh = self._segment(self.documents(names), SCANNED)
        return self._publish([*(r for r in self.rows if r["segment"] not in names and r["name"] not in names), fresh])

    def copy(self, path: str) -> Segments:
        """The documents of this version as one segment at another path."""
        other = Segments.open(self.spark, path)
        fresh = other._segment(self.documents(), SCANNED)
        return other._publish([fresh])

    def _segment(self, counts: DataFrame, scanned: int | None = None) -> dict:
        """A segment of counts, whose scans read so many bytes in a task."""
        name = uuid.uuid4().hex
        base = f"{self.path}/segments/{name}"
        # Blocks are cut within partitions, where documents stand by length; nothing is moved for them.
        placed = counts.sortWithinPartitions("dl", "id").withColumn("place", F.monotonically_increasing_id()).withColumn("block", F.floor(F.col("place") / BLOCK))
        with _scans(self.spark, scanned) if scanned else nullcontext():
            placed.write.option("compression", "zstd").parquet(f"{base}/docs")
        docs = self.spark.read.parquet(f"{base}/docs")
        n, total = docs.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        buckets, salts = min(BUCKETS, 1 + total // BUCKET), 1 + n // SALTED
        moved = dealt_lists(docs, buckets, salts, 1 + total // LISTED).sortWithinPartitions("bucket", "term", "block")
        with _scans(self.spark):  # a task's lists take many times the bytes of its files
            moved.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{base}/postings")
        lists = self.spark.read.parquet(f"{base}/postings") if n and total else self.spark.createDataFrame([], "bucket int, term string, df long")
        lists.where("df IS NOT NULL").select("bucket", "term", "df").write.option("compression", "zstd").parquet(f"{base}/terms")
        return {"kind": "segment", "name": name, "segment": name, "buckets": buckets, "n": n, "total": total}

    def _gone(self, ids: DataFrame) -> list[dict]:
        """Notes that the documents in ids are gone from the segments that hold them."""
        if not self.segments:
            return []
        name = uuid.uuid4().hex
        base = f"{self.path}/gone/{name}"
        live, few = self._live().select("segment", "place", "id", "dl"), ids.limit(SENT + 1).count() <= SENT
        # Ids are looked for without the documents' terms: few are sent to all tasks, for more both sides are dealt.
        live = live if few else live.repartition(1 + sum(r["n"] for r in self.segments) // DEALT, "id")
        live.join(F.broadcast(ids) if few else ids, "id", "left_semi").write.option("compression", "zstd").parquet(f"{base}/docs")
        lost = self.spark.read.parquet(f"{base}/docs")
        sums = lost.groupBy("segment").agg(F.count("*").alias("n"), F.sum("dl").alias("total")).collect()  # one for each segment
        if not sums:
            return []
        found = self._marked(self._docs([r["segment"] for r in sums]), lost, sum(r["n"] for r in sums)).where("marked")
        found.select("segment", F.explode("terms.term").alias("term")).groupBy("segment", "term").agg(F.count("*").alias("df")).write.option("compression", "zstd").parquet(f"{base}/terms")
        return [{"kind": "gone", "name": name, "segment": r["segment"], "buckets": 0, "n": r["n"], "total": r["total"]} for r in sums]

    def _marked(self, docs: DataFrame, places: DataFrame, n: int) -> DataFrame:
        """docs with marked: whether they stand at one of the n places (segment, place). A place is a bit of a word of 64,
        so that words are few; where they are not, documents are shuffled to them."""
        bits = F.bit_or(F.expr("shiftleft(1L, int(place % 64))")).alias("bits")
        words = places.groupBy("segment", F.shiftright("place", 6).alias("word")).agg(bits)
        least = sum(r["n"] // 64 + r["total"] // TOKENS + 1 for r in self.segments)
        words = F.broadcast(words) if min(n, least) <= SENT else words
        held = docs.withColumn("word", F.shiftright("place", 6)).join(words, ["segment", "word"], "left")
        return held.withColumn("marked", F.getbit(F.coalesce("bits", F.lit(0).cast("long")), F.expr("int(place % 64)")) == 1).drop("word", "bits")

    def _publish(self, rows: list) -> Segments:
        """The next version; it holds once its one file is there."""
        version = Segments.open(self.spark, self.path).version + 1
        told = [(r | {"version": version}) if isinstance(r, dict) else (r.asDict() | {"version": version}) for r in rows] or [{"version": version, "kind": "empty", "name": "", "segment": "", "buckets": 0, "n": 0, "total": 0}]
        self.spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in told], MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        return Segments(self.spark, self.path, tuple(Row(**r) for r in told))

    # ---- what it holds ----------------------------------------------------------------------------------------------

    def _read(self, table: str, buckets: dict[str, list[int]] | None = None) -> DataFrame | None:
        """Postings or terms of all segments, with the segment's name; of some buckets of each."""
        rows = [r for r in self.segments if r["total"]]
        parts = [self.spark.read.parquet(f"{self.path}/segments/{r['name']}/{table}").withColumn("segment", F.lit(r["name"])) for r in rows]
        if buckets is not None:
            parts = [p.where(F.col("bucket").isin(buckets[r["name"]])) for r, p in zip(rows, parts)]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _docs(self, names: list[str]) -> DataFrame:
        """Documents of some segments, with the segment's name; one scan, which packs small files of all of them together."""
        docs = self.spark.read.parquet(*(f"{self.path}/segments/{n}/docs" for n in names))
        return docs.withColumn("segment", F.regexp_extract("_metadata.file_path", "/segments/([^/]+)/docs/", 1))

    def _notes(self, table: str) -> DataFrame | None:
        """Notes on segments that are there."""
        names = sorted({r["name"] for r in self.rows if r["kind"] == "gone"})
        if not names:
            return None
        return self.spark.read.parquet(*(f"{self.path}/gone/{n}/{table}" for n in names)).where(F.col("segment").isin([r["name"] for r in self.segments]))

    def _without_gone(self, rows: DataFrame) -> DataFrame:
        """rows (segment, id, ..) of documents that are not gone."""
        notes = self._notes("docs")
        return rows if notes is None else rows.join(notes.select("segment", "id"), ["segment", "id"], "left_anti")

    def _live(self, names: list[str] | None = None) -> DataFrame:
        """Documents of some segments, or all of them, that are not gone, with the segment's name."""
        docs, notes = self._docs(names or [r["name"] for r in self.segments]), self._notes("docs")
        if notes is None:
            return docs
        return self._marked(docs, notes, sum(r["n"] for r in self.rows if r["kind"] == "gone")).where("NOT marked").drop("marked")

    def documents(self, names: list[str] | None = None) -> DataFrame:
        """id, dl and terms of the documents that are there."""
        if not self.segments:
            return self.spark.createDataFrame([], "id long, dl int, terms array<struct<term: string, tf: int>>")
        return self._live(names).select("id", "dl", "terms")

    def terms(self, wanted: list[str] | None = None, buckets: dict[str, list[int]] | None = None) -> DataFrame:
        """term, df over all documents that are there."""
        parts = self._read("terms", buckets=buckets)
        if parts is None:
            return self.spark.createDataFrame([], "term string, df long")
        rows, notes = parts.select("term", "df"), self._notes("terms")
        if notes is not None:
            rows = rows.unionByName(notes.select("term", (-F.col("df")).alias("df")))
        rows = rows if wanted is None else rows.where(F.col("term").isin(wanted) if wanted else F.lit(False))
        return rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def statistics(self) -> DataFrame:
        """What the index holds, field by field: name and n."""
        terms = self.terms().agg(F.coalesce(F.sum("df"), F.lit(0)).alias("postings"), F.count("*").alias("terms"), F.coalesce(F.sum(F.length("term")), F.lit(0)).cast("long").alias("chars"))
        every = F.array(*(F.struct(F.lit(name).alias("name"), n.cast("long").alias("n")) for name, n in (("documents", F.lit(self.n)), ("tokens", F.lit(self.total)), ("postings", F.col("postings")), ("terms", F.col("terms")), ("term characters", F.col("chars")))))
        return terms.select(F.explode(every).alias("s")).select("s.name", "s.n")

    def sizes(self) -> DataFrame:
        """segment, part (docs, postings, terms), bucket (null but in postings), files, bytes of each segment that is there."""
        folders = [f"{self.path}/segments/{r['name']}" for r in self.segments]
        if not folders:
            return self.spark.createDataFrame([], "segment string, part string, bucket int, files long, bytes long")
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folders).select("path", "length")
        place = lambda pattern: F.regexp_extract("path", pattern, 1)
        rows = found.select(place("/segments/([^/]+)/").alias("segment"), place("/segments/[^/]+/([^/]+)/").alias("part"), F.try_to_number(place("/bucket=([0-9]+)/"), F.lit("99999")).cast("int").alias("bucket"), "length")
        return rows.groupBy("segment", "part", "bucket").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))

    # ---- search -----------------------------------------------------------------------------------------------------

    def search(self, queries: DataFrame, k: int | None, kept: DataFrame | None = None) -> DataFrame:
        """query_id, id, score of documents that may be among each query's k best (ties at the kth place included), those
        of blocks that can hold one; without k, of all documents with a term. kept (id) takes all other documents away,
        without a change of what terms weigh. Repeated query terms count again, scores are rounded to 9 digits."""
        plan = self.blocks(queries, k, kept)
        if plan is None:
            kind = queries.schema["query_id"].dataType.simpleString()
            return self.spark.createDataFrame([], f"query_id {kind}, id long, score double")
        lists, weighed, blocks = plan
        return self._scores(lists, weighed, blocks.where("wins"), kept)

    def blocks(self, queries: DataFrame, k: int | None, kept: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame] | None:
        """The asked terms' postings, their weights, and query_id, segment, block, bound (what a document of it can score
        at most) and wins (whether that reaches the kth best score among the blocks with the greatest bounds)."""
        asked = asked_terms(queries).withColumn("hash", F.xxhash64("term"))
        lists = self._read("postings")
        few = asked.limit(NAMED + 1).collect()
        if not few or lists is None:
            return None
        idf = F.log(1 + (F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        if len(few) <= NAMED:  # few questions: their terms are named to the scans, and their weights are sent with the plan
            wanted = sorted({r["term"] for r in few})
            buckets = {r["name"]: sorted({a["hash"] % r["buckets"] for a in few}) for r in self.segments}
            weights = {r["term"]: r["idf"] for r in self.terms(wanted, buckets).select("term", idf.alias("idf")).collect()}
            weighed = self.spark.createDataFrame([(r["query_id"], r["term"], r["qtf"] * weights[r["term"]]) for r in few if r["term"] in weights], f"query_id {queries.schema['query_id'].dataType.simpleString()}, term string, w double")
            lists = self._read("postings", buckets=buckets).where(F.col("term").isin(wanted))
        else:
            asked = materialize(asked)
            lists = lists.join(asked.select("term").distinct(), "term", "left_semi")
            weighed = materialize(asked.join(self.terms(), "term").select("query_id", "term", (F.col("qtf") * idf).alias("w")))
        avgdl = F.lit(self.total / max(1, self.n))
        bounds = lists.select("segment", "block", "term", "most_tf", "least_dl").join(weighed, "term")
        blocks = bounds.groupBy("query_id", "segment", "block").agg(F.sum(F.col("w") * weight(F.col("most_tf"), F.col("least_dl"), avgdl)).alias("bound"))
        if k is None:
            return lists, weighed, blocks.withColumn("wins", F.lit(True))
        blocks = materialize(blocks)
        first = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block")
        tried = blocks.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= max(FIRST, 2 * -(-k // BLOCK))).drop("_r")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"))
        least = self._scores(lists, weighed, tried, kept).withColumn("_r", F.row_number().over(order)).where(F.col("_r") == k).select("query_id", F.col("score").alias("least"))
        # Bounds and scores are sums in an order of their own; a bound a hair below counts as reached.
        return lists, weighed, blocks.join(materialize(least), "query_id", "left").withColumn("wins", F.col("bound") + 1e-6 >= F.coalesce("least", F.lit(0.0)))

    def _scores(self, lists: DataFrame, weighed: DataFrame, blocks: DataFrame, kept: DataFrame | None) -> DataFrame:
        avgdl = F.lit(self.total / max(1, self.n))
        held = lists.join(blocks.select("query_id", "segment", "block"), ["segment", "block"]).join(weighed, ["query_id", "term"])
        rows = self._without_gone(held.select("query_id", "segment", "w", F.explode("docs").alias("d")).select("query_id", "segment", "w", "d.id", "d.tf", "d.dl"))
        rows = rows if kept is None else rows.join(kept.select("id"), "id", "left_semi")
        return rows.groupBy("query_id", "id").agg(F.round(F.sum(F.col("w") * weight(F.col("tf"), F.col("dl"), avgdl)), 9).alias("score"))
