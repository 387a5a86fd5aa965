"""Recursive chunking by separators, with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import normalize

#: Separators from the strongest to the weakest, and sizes in characters (four to a token).
SEPARATORS = ("\n\n\n", "\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", "")
SIZE, OVERLAP = 3200, 600


def pieces(text: str, separator: str) -> list[str]:
    """Cut before each separator, which stays with the piece after it."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in (head, *(separator + r for r in rest)) if p]


def packed(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Neighbours joined up to size; a new chunk starts with as much of the last as the overlap allows."""
    held: list[str] = []
    length = 0
    for part in parts:
        if held and length + len(part) > size:
            yield "".join(held)
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.pop(0))
        held.append(part)
        length += len(part)
    if held:
        yield "".join(held)


def split(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks as they are cut, white space around them included."""
    at = next(i for i, s in enumerate(separators) if not s or s in text)
    out: list[str] = []
    short: list[str] = []
    for part in pieces(text, separators[at]):
        if len(part) < size:
            short.append(part)
            continue
        out.extend(packed(short, size, overlap))
        short = []
        weaker = separators[at + 1 :]
        out.extend(split(part, size, overlap, weaker) if weaker else [part])
    return [*out, *packed(short, size, overlap)]


def chunks_of(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[dict]:
    """index, text, start and end, tokens. White space around a chunk is no part of it, and blank ones are none. `start` is
    searched from the end of the chunk before, so that it drifts with overlap; `true_start` is where the chunk begins."""
    out, last, near = [], 0, 0
    for i, chunk in enumerate(filter(None, map(str.strip, split(text, size, overlap) if text.strip() else []))):
        found = text.find(chunk, last)
        start = found if found >= 0 else last
        true = text.find(chunk, near)
        near = true + 1 if true >= 0 else near
        last = start + len(chunk)
        out.append({"chunk_index": i, "chunk_text": chunk, "start_char_index": start, "end_char_index": last, "true_start": true, "token_count": max(1, len(chunk) // 4)})
    return out


CHUNK = "array<struct<chunk_index:int,chunk_text:string,start_char_index:int,end_char_index:int,true_start:int,token_count:int>>"
_ARROW = pa.list_(pa.struct([("chunk_index", pa.int32()), ("chunk_text", pa.string()), ("start_char_index", pa.int32()), ("end_char_index", pa.int32()), ("true_start", pa.int32()), ("token_count", pa.int32())]))


#: Texts whose chunks a worker holds at a time.
HELD = 64


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most HELD."""
    for b in batches:
        for i in range(0, len(b), HELD):
            yield b.slice(i, HELD)


def chunk(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """A row for each chunk of the normalised text: key and the fields of chunks_of(). Texts that fit one chunk never
    leave the JVM."""
    rows = docs.select(F.col(key), normalize(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    # A text under the size is one piece whatever its separators.
    whole = F.struct(F.lit(0).alias("chunk_index"), F.col("_t").alias("chunk_text"), F.lit(0).alias("start_char_index"), F.length("_t").alias("end_char_index"), F.lit(0).alias("true_start"), F.greatest(F.lit(1), F.floor(F.length("_t") / 4)).cast("int").alias("token_count"))
    short = rows.where((F.length("_t") < size) & (F.col("_t") != "")).select(key, whole.alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([chunks_of(t, size, overlap) for t in b.column("_t").to_pylist()], _ARROW)], [key, "cs"])

    long = rows.where(F.length("_t") >= size).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, cs {CHUNK}").select(key, F.explode("cs").alias("c"))
    return short.unionByName(long).select(key, "c.*")


def register(spark, name: str = "text_chunks") -> None:
    """The chunker as a table function of SQL: SELECT c.* FROM t, LATERAL text_chunks(t.text) AS c."""
    from pyspark.sql.functions import udtf

    class Chunks:
        def eval(self, text: str):
            for c in chunks_of(plain(text or "")):
                yield tuple(c[f] for f in ("chunk_index", "chunk_text", "start_char_index", "end_char_index", "true_start", "token_count"))

    spark.udtf.register(name, udtf(Chunks, returnType="chunk_index int, chunk_text string, start_char_index int, end_char_index int, true_start int, token_count int"))


def plain(text: str) -> str:
    """What functions.text.normalize() gives, for the table function."""
    return re.sub(r"[ \t]+", " ", re.sub(r"\r\n?", "\n", text)).strip(" \t\n\x0b\x0c\r")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Counts and sizes over all chunks, in tokens and characters; zeros without any."""
    n, t = F.count("*"), F.coalesce(F.sum("token_count"), F.lit(0))
    return chunks.agg(
        n.alias("total_chunks"),
        t.cast("long").alias("total_tokens"),
        F.when(n > 0, F.floor(t / n)).otherwise(0).cast("long").alias("avg_tokens"),
        F.coalesce(F.min("token_count"), F.lit(0)).alias("min_tokens"),
        F.coalesce(F.max("token_count"), F.lit(0)).alias("max_tokens"),
        F.coalesce(F.sum(F.length("chunk_text")), F.lit(0)).cast("long").alias("total_characters"),
    )
