"""Counter rates of a stream: the steps of each series, with its samples in the order of their time, whatever the order in
which they arrive."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# The processor goes to executors by value, as functions do.
register_pickle_by_value(sys.modules[__name__])

#: Provider of states that transformWithState needs.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
HOUR = 3_600_000_000
#: A span of a series is one group of rows; no group has more of it.
SPAN = 24 * HOUR
#: In place of a span: rows that have the first and last samples of all spans of a series.
ENDS = -(2**63)
#: Samples of a task that are packed at a time.
PACK = 1 << 18
#: Samples go between tasks and to states as bytes: Spark hands each row of a group to Python by itself.
SAMPLE = np.dtype([("at", "<i8"), ("nr", "<i8"), ("value", "<f8")])


def _ordered(samples: np.ndarray) -> np.ndarray:
    return np.lexsort((samples["nr"], samples["at"]))


def _unpacked(rows: Iterator[pd.DataFrame]) -> np.ndarray:
    return np.frombuffer(b"".join(s for frame in rows for s in frame["samples"]), SAMPLE)


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _rows(series: pa.Array, code: np.ndarray, part: np.ndarray, samples: np.ndarray) -> pa.RecordBatch:
    heads = _heads(code, part)
    places = np.append(heads, len(samples)).astype(np.int32) * np.int32(SAMPLE.itemsize)
    packed = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(places), pa.py_buffer(samples.tobytes())])
    return pa.RecordBatch.from_arrays([series.take(pa.array(code[heads])), pa.array(part[heads]), packed], ["series", "span", "samples"])


def _pack(held: list[pa.RecordBatch], span: int | None) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held).combine_chunks()
    series = table["series"].chunk(0).dictionary_encode()
    code, samples = series.indices.to_numpy(), np.empty(len(table), SAMPLE)
    for name in SAMPLE.names:
        samples[name] = table[name].to_numpy()
    order = np.lexsort((samples["nr"], samples["at"], code))
    code, samples = code[order], samples[order]
    part = samples["at"] // span if span else np.zeros(len(samples), np.int64)
    yield _rows(series.dictionary, code, part, samples)
    if span:
        heads = _heads(code, part)
        edges = np.union1d(heads, np.append(heads[1:], len(samples)) - 1)
        yield _rows(series.dictionary, code[edges], np.full(len(edges), ENDS), samples[edges])


def packer(span: int | None):
    """Samples as one row for each series and span of some batches, and one for each series with the ends of its spans;
    without a span, as one row for each series."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, PACK):
                held.append(batch.slice(i, PACK))
                n += held[-1].num_rows
                if n >= PACK:
                    yield from _pack(held, span)
                    held, n = [], 0
        if n:
            yield from _pack(held, span)

    return packed


def _step(before: np.ndarray, sample: np.ndarray, idle: int | None) -> np.ndarray:
    """What samples add to their counter after those before them: the whole value after a reset."""
    with np.errstate(invalid="ignore"):
        size = np.where(sample["value"] >= before["value"], sample["value"] - before["value"], sample["value"])
    return size if idle is None else np.where(sample["at"] - before["at"] > idle, 0.0, size)


def _change(now: np.ndarray, was: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return np.where(now == was, 0.0, now - was)  # infinite steps may stay


def _told(series, at: np.ndarray, delta: np.ndarray, late: bool = False) -> pd.DataFrame:
    # As Arrow, since a NaN of pandas would be null.
    delta = pd.arrays.ArrowExtensionArray(pa.nulls(len(at), pa.float64()) if late else pa.array(delta, pa.float64()))
    return pd.DataFrame({"series": [series] * len(at), "at": at, "delta": delta, "late": late})


class Steps(StatefulProcessor):
    """The samples of a series and span by hour. A new sample gives its own step and corrects the step of the one after it;
    the first sample of all has none. The state of ENDS has the first and the last sample of each span of a series: it
    gives the step of a span's first sample, and what corrects it.

    Hours that end more than `horizon` microseconds before the latest sample leave the state; the last sample of them
    stays, as the floor. A sample before the floor can't be placed any more and is passed on as late. With `idle`
    (microseconds), a sample that comes so long after the one before it starts the series anew."""

    def __init__(self, span: int | None = None, horizon: int | None = None, idle: int | None = None):
        self.span, self.horizon, self.idle = span, horizon, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ends = handle.getValueState("ends", "samples binary")
        self.hours = handle.getMapState("hours", "hour long", "samples binary")
        self.floor = handle.getValueState("floor", "sample binary")

    def _hour(self, hour: int) -> np.ndarray:
        return np.frombuffer(self.hours.getValue((int(hour),))[0], SAMPLE)

    def _steps(self, samples: np.ndarray) -> np.ndarray:
        out = np.zeros(len(samples))
        out[1:] = _step(samples[:-1], samples[1:], self.idle)
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from (self._between if key[1] == ENDS else self._inside)(key[0], _unpacked(rows))

    def _inside(self, series, new: np.ndarray) -> Iterator[pd.DataFrame]:
        floor = np.empty(0, SAMPLE)
        if self.horizon is not None and self.floor.exists():
            floor = np.frombuffer(self.floor.get()[0], SAMPLE)
            late = (new["at"] < floor["at"]) | ((new["at"] == floor["at"]) & (new["nr"] <= floor["nr"]))
            if late.any():
                yield _told(series, new["at"][late], None, late=True)
            new = new[~late]
        if not len(new):
            return
        fresh = np.unique(new["at"] // HOUR)
        known = np.sort(np.fromiter((k[0] for k in self.hours.keys()), np.int64))
        # Hours with new samples and, on either side of each, the nearest one that is known. Others do not change, and
        # what seems to come before their first sample seems so both before and after.
        left, right = np.searchsorted(known, fresh) - 1, np.searchsorted(known, fresh, "right")
        near = np.unique(np.concatenate([known[left[left >= 0]], known[right[right < len(known)]], np.intersect1d(known, fresh)]))
        old = np.concatenate([floor, *(self._hour(h) for h in near)])
        samples = np.concatenate([old, new])
        order = _ordered(samples)
        samples, added = samples[order], order >= len(old)
        was = np.zeros(len(samples))
        was[~added] = self._steps(old)
        delta = _change(self._steps(samples), was)
        told = added | (delta != 0)
        yield _told(series, samples["at"][told], delta[told])
        samples = samples[len(floor) :]
        hour = samples["at"] // HOUR
        for h, low, high in zip(fresh, np.searchsorted(hour, fresh), np.searchsorted(hour, fresh, "right")):
            self.hours.updateValue((int(h),), (samples[low:high].tobytes(),))
        if self.horizon is not None:
            every = np.union1d(known, fresh)
            gone = every[(every + 1) * HOUR <= self._hour(every[-1])["at"][-1] - self.horizon]
            if len(gone):
                self.floor.update((self._hour(gone[-1])[-1:].tobytes(),))
            for h in gone:
                self.hours.removeKey((int(h),))

    def _seams(self, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ends))
        out[1:] = _step(ends[:-1, 1], ends[1:, 0], self.idle)
        return out

    def _between(self, series, fresh: np.ndarray) -> Iterator[pd.DataFrame]:
        old = np.frombuffer(self.ends.get()[0] if self.ends.exists() else b"", SAMPLE).reshape(-1, 2)
        samples = np.concatenate([old.ravel(), fresh])
        samples = samples[_ordered(samples)]
        heads = _heads(samples["at"] // self.span)
        new = np.stack([samples[heads], samples[np.append(heads[1:], len(samples)) - 1]], axis=1)
        self.ends.update((new.tobytes(),))
        # First samples of spans as they were and as they are; one that is both counts once, with both its steps.
        first = np.concatenate([old[:, 0], new[:, 0]])
        was, now = np.zeros(len(first)), np.zeros(len(first))
        was[: len(old)], now[len(old) :] = self._seams(old), self._seams(new)
        order = _ordered(first)
        first = first[order]
        heads = _heads(first["at"], first["nr"])
        delta = _change(np.add.reduceat(now[order], heads), np.add.reduceat(was[order], heads))
        told = delta != 0
        if told.any():
            yield _told(series, first["at"][heads][told], delta[told])

    def close(self) -> None:
        pass


def steps(samples: DataFrame, by: str, nr: str, ts: str = "ts", value: str = "value", horizon: int | None = None, idle: int | None = None) -> DataFrame:
    """series, at (microseconds), delta, late for a stream of samples; nr tells samples of one time apart and is unique in
    its series. Deltas of a sample add up to its step: sums of them over any windows are right whatever came when.

    A series goes to tasks by span, and only ends of spans meet. With a horizon, which its latest sample moves, a series
    is one task's at a time."""
    rows = samples.where(F.col(by).isNotNull() & F.col(ts).isNotNull() & F.col(value).isNotNull())
    rows = rows.select(F.col(by).alias("series"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.coalesce(F.col(nr).cast("long"), F.lit(2**63 - 1)).alias("nr"), F.col(value).cast("double").alias("value"))
    kind = rows.schema["series"].dataType.simpleString()
    span = SPAN if horizon is None else None
    packed = rows.mapInArrow(packer(span), f"series {kind}, span long, samples binary")
    return packed.groupBy("series", "span").transformWithStateInPandas(Steps(span, horizon, idle), f"series {kind}, at long, delta double, late boolean", "Append", "None")


def by_batch(stream: DataFrame, path: str, checkpoint: str, aggregate) -> StreamingQuery:
    """Each batch's aggregate(batch), in a folder of the batch's number: a batch that is done again writes the same folder,
    so that nothing counts twice over a restart, and no row is too late. Sums over all folders are those of the stream."""

    def write(batch: DataFrame, number: int) -> None:
        aggregate(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
