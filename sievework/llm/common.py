"""Helpers shared by the corpus operators: shared folders, packing and worker-lifetime caches."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the cluster names none, it is set here for a local master, as in
    tests; elsewhere that is an error, since the driver's own folders are not seen by executors."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: this cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_store(operator: str, arrays: bool = True, block: int = 1 << 18) -> dict:
    """A dict that lives as long as the Python worker, across tasks of one operator. Functions are sent by value, so
    their own globals last one task only. What another operator has left goes, and freed memory back to the system; an
    operator that works on large arrays also has those of a block or more mapped alone."""
    import pyspark

    kept = pyspark.__dict__.setdefault("_worker_store", {})
    fresh = operator not in kept
    if fresh:
        kept.clear()
        kept[operator] = {}
    # Functions that came by value are cycles of their own globals, and work on arrays makes too few objects for the
    # collector to start by itself, so that what tasks leave would pile up.
    if fresh or time.monotonic() - kept.get("collected", 0.0) > 2:
        gc.collect()
        trim(arrays, block)
        kept["collected"] = time.monotonic()
    return kept[operator]


def trim(arrays: bool, block: int) -> None:
    """Give freed memory back to the system and, with arrays, large blocks from now on as soon as they are freed, where
    the C library knows how: a worker runs beside a heap that does not shrink."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if arrays:
        pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        # Fixed values of the C library: -3 sets the size from which blocks are mapped alone, -1 the free top it keeps.
        if arrays:
            libc.mallopt(-3, block)
            libc.mallopt(-1, 8 * block)
        libc.malloc_trim(0)
    except (AttributeError, OSError):
        pass


def release(spark: SparkSession) -> None:
    """Executors collect their heaps and give what is free back to the system. A heap grows with what tasks leave and is
    not given back by itself, so that a long run of many jobs would hold the largest heap beside the Python workers of
    each. A task for each core; where an executor gets none, its heap stays as it is."""
    every = spark.sparkContext.defaultParallelism
    freed = F.reflect(F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, every, 1, every).select(freed.alias("gc")).write.format("noop").mode("overwrite").save()


#: Rows and bytes of an Arrow batch at most, where the session has Spark's defaults.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session sends Python batches of a few megabytes, since texts are long and workers are small."""
    conf = df.sparkSession.conf
    for key, (default, own) in BATCH.items():
        if conf.get(key, None) == default:
            conf.set(key, own)
    return df


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about max_bytes of the column, or one row: long texts stay bounded."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // max_bytes
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns, a null text as an empty one."""
    return small_batches(df).select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: its own, or the next free one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


#: Ids that are sent to every task at most; more are matched by a shuffled join.
SENT = 500_000


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs whose key is not in ids (one column of that name). Few ids are broadcast, so that texts stay where they are."""
    ids = materialize(ids.where(F.col(key).isNotNull()).distinct())
    few = ids.limit(SENT + 1).count() <= SENT
    return docs.join(F.broadcast(ids) if few else ids, key, "left_anti")
