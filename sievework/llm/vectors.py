"""Vectors in blocks: every query block meets every block of candidates in some task, as one matrix product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors in a block of candidates and of queries.
ROWS, QUERIES = 4096, 512


def sound(vector: Column) -> Column:
    """True for a vector that is not null or empty and holds finite numbers only."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def clean(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v (array<double>) of sound vectors; of rows that share an id the one with the greatest vector counts."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & sound(F.col("v"))).groupBy("id").agg(F.max("v").alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def blocks(df: DataFrame, rows: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows (dim, n, ids, data, extra...): buffers of up to `rows` vectors of one dimension, ids and extras as 64-bit
    integers, data as doubles. The input has id, v and the extra columns."""
    names = ["id", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            *numbers, data = (np.concatenate(x) for x in zip(*held.pop(dim)))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(data)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (numbers[0], data, *numbers[1:]))], ["dim", "n", "ids", "data", *extra])

        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim)) if (sizes != dim).any() else batch
                for a in range(0, part.num_rows, rows):
                    piece = part.slice(a, rows)
                    held.setdefault(dim, []).append([*(piece.column(c).to_numpy(zero_copy_only=False) for c in names), matrix(piece.column("v"))])
                    if sum(len(x[0]) for x in held[dim]) >= rows:
                        yield out(dim)
        for dim in list(held):
            yield out(dim)

    columns = "".join(f", {c} binary" for c in extra)
    return df.select(*names, "v").mapInArrow(run, f"dim int, n int, ids binary, data binary{columns}")


def meet(queries: DataFrame, candidates: DataFrame, parts: int) -> DataFrame:
    """Each block of queries (columns q_...) with each block of candidates: candidates are dealt into parts, queries are
    copied to every part."""
    dealt = candidates.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))
    copied = queries.select(*(F.col(c).alias(c if c == "dim" else f"q_{c}") for c in queries.columns)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(copied, ["dim", "part"])
