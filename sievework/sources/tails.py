"""Lines of growing text files, as a batch or a stream, and metrics in the text exposition format.

Spark's own file stream takes whole files once; a log or a metrics dump that is appended to needs offsets within files.
The data source `tail` keeps one offset for each file: a batch of a stream is the byte ranges between two sets of offsets,
which Spark logs before it runs them, so that a batch that is done again reads the same bytes. A line counts once its line
end is there. Files are found and read by Arrow's file systems (local or mounted paths, and URIs such as s3:// or hdfs://)."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Classes go to executors by value, as functions do.
register_pickle_by_value(sys.modules[__name__])

#: Bytes of a range that one task reads, and of a read.
RANGE, READ = 64 << 20, 4 << 20
LINES = "file string, offset long, value string"


@dataclass
class Range(InputPartition):
    """The lines of a file that begin in [start, end); with `cut`, start may be within a line of the range before."""

    file: str
    start: int
    end: int
    cut: bool


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def whole_lines(path: str, suffix: str) -> dict[str, int]:
    """Files below path and the end of the last whole line in each."""
    fs, top = _open(path)
    out = {}
    for info in fs.get_file_info(pafs.FileSelector(top, recursive=True, allow_not_found=True)):
        if info.type != pafs.FileType.File or not info.path.endswith(suffix) or "/_" in info.path[len(top) :] or "/." in info.path[len(top) :]:
            continue
        with fs.open_input_file(info.path) as f:
            at = f.size()
            while at:
                low = max(0, at - READ)
                f.seek(low)
                found = f.read(at - low).rfind(b"\n")
                if found >= 0:
                    out[info.path] = low + found + 1
                    break
                at = low
    return out


def ranges(start: dict[str, int], end: dict[str, int], size: int = RANGE) -> list[Range]:
    return [Range(f, a, min(a + size, z), a > start.get(f, 0)) for f, z in sorted(end.items()) for a in range(start.get(f, 0), z, size)]


def read_range(path: str, part: Range) -> Iterator[pa.RecordBatch]:
    """Batches of LINES."""
    with _open(path)[0].open_input_file(part.file) as f:
        at = part.start - 1 if part.cut else part.start
        f.seek(at)
        rest, skip = b"", part.cut  # the line that the range begins in belongs to the one before
        while at < part.end or rest:
            block = f.read(READ)
            lines = (rest + block).split(b"\n")
            rest = lines.pop()
            offsets, values = [], []
            for line in lines:
                if skip:
                    skip = False
                elif at < part.end:
                    offsets.append(at)
                    values.append(line.decode("utf-8", "replace").removesuffix("\r"))
                at += len(line) + 1
            if values:
                yield pa.RecordBatch.from_arrays([pa.array([part.file] * len(values)), pa.array(offsets, pa.int64()), pa.array(values)], ["file", "offset", "value"])
            if not block or at >= part.end:
                return


class Tail(DataSource):
    """Options: path (a folder), suffix (of file names, any if empty), range (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return TailReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailStream(dict(self.options))


class _Ranges:
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix, self.size = options["path"], options.get("suffix", ""), int(options.get("range", RANGE))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from read_range(self.path, partition)


class TailReader(_Ranges, DataSourceReader):
    def partitions(self) -> list[Range]:
        return ranges({}, whole_lines(self.path, self.suffix), self.size) or [Range("", 0, 0, False)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from read_range(self.path, partition)


class TailStream(_Ranges, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return whole_lines(self.path, self.suffix)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(start, end, self.size)


def lines(spark: SparkSession, path: str, suffix: str = "", stream: bool = False, size: int = RANGE) -> DataFrame:
    """file, offset and value of each line of the files below path."""
    spark.dataSource.register(Tail)
    reader = (spark.readStream if stream else spark.read).format("tail")
    return reader.option("path", path).option("suffix", suffix).option("range", str(size)).load()


# ---- text exposition ----------------------------------------------------------------------------------------------

SAMPLE = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)\s*(\{.*\})?\s+(\S+)(?:\s+(-?\d+))?\s*$"
LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"'


def _escaped(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))


def _plain(value: Column) -> Column:
    # A backslash of its own goes through a character that text does not hold.
    return F.replace(F.replace(F.replace(F.replace(value, F.lit("\\\\"), F.lit("\0")), F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\0"), F.lit("\\"))


def exposed(name: Column, labels: Column, value: Column, ts: Column | None = None) -> Column:
    """A sample as a line: name{label="value",...} value [milliseconds]."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), _escaped(e["value"]), F.lit('"')))
    number = F.when(F.isnan(value), "NaN").when(value == float("inf"), "+Inf").when(value == float("-inf"), "-Inf").otherwise(value.cast("string"))
    parts = [F.concat(name, F.when(F.size(labels) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")), number]
    return F.concat_ws(" ", *parts, *([F.unix_millis(ts.cast("timestamp")).cast("string")] if ts is not None else []))


def samples(rows: DataFrame, line: str = "value") -> DataFrame:
    """rows with name, labels, value and ts (null if the line has none) of each sample; comments, blank lines and lines
    that are no samples go."""
    told = rows.where(F.col(line).rlike(SAMPLE)).withColumn("_line", F.col(line))
    body = F.regexp_extract("_line", SAMPLE, 2)
    labels = F.map_from_arrays(F.regexp_extract_all(body, F.lit(LABEL), 1), F.transform(F.regexp_extract_all(body, F.lit(LABEL), 2), _plain))
    number = F.regexp_extract("_line", SAMPLE, 3).try_cast("double")
    at = F.regexp_extract("_line", SAMPLE, 4).try_cast("long")
    return told.withColumns({"name": F.regexp_extract("_line", SAMPLE, 1), "labels": labels, "value": number, "ts": F.timestamp_millis(at)}).where("value IS NOT NULL").drop("_line")
