"""Windowed analytics of metrics and logs. Every aggregation takes a batch or a stream; streams come with a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

LATE = "10 minutes"


def watched(events: DataFrame, ts: str = "ts", late: str = LATE) -> DataFrame:
    """A stream drops what is later than the watermark; a batch is left as it is."""
    if not events.isStreaming:
        return events
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)  # watermarks need a zone


def _bounds(df: DataFrame) -> DataFrame:
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in df.columns if c != "window"])


def over_time(events: DataFrame, width: str, *aggregates: Column, slide: str | None = None, by: tuple[str, ...] = (), ts: str = "ts") -> DataFrame:
    """Tumbling or, with slide, sliding windows."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return _bounds(watched(events, ts).groupBy(w.alias("window"), *by).agg(*aggregates))


def counter_rate(samples: DataFrame, width: str = "5 minutes", slide: str = "1 minute", by: tuple[str, ...] = (), seconds: int = 300, ts: str = "ts", value: str = "value", order: tuple[str, ...] = ()) -> DataFrame:
    """Increase of a counter a second: sums of positive steps (a reset starts from zero) over sliding windows. Steps need
    the sample before, so this is for batches; a stream of steps goes through over_time()."""
    if by:
        before = F.lag(value).over(Window.partitionBy(*by).orderBy(ts, *order))
    else:
        # One counter for all: its samples are numbered by hour, and an hour's first one follows the last of the hour
        # before that has any.
        hour = F.date_trunc("hour", F.col(ts))
        samples = samples.withColumn("_hour", hour)
        last = samples.groupBy("_hour").agg(F.max_by(value, F.struct(ts, *order)).alias("_last"))
        last = last.select("_hour", F.lag("_last").over(Window.orderBy("_hour")).alias("_last"))  # a row for each hour
        samples = samples.join(F.broadcast(last), "_hour")
        before = F.coalesce(F.lag(value).over(Window.partitionBy("_hour").orderBy(ts, *order)), F.col("_last"))
    step = F.when(before.isNull(), 0.0).when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value))
    return over_time(samples.withColumn("step", step).drop("_hour", "_last"), width, (F.sum("step") / seconds).alias("rate"), slide=slide, by=by, ts=ts)


def bucket_quantile(events: DataFrame, bounds: list[float], q: float, by: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """Quantile from cumulative bucket counts with linear interpolation; beyond the last bound it is that bound."""
    counts = events.groupBy(*by).agg(F.count(value).alias("n"), *(F.count_if(F.col(value) <= b).alias(f"c{i}") for i, b in enumerate(bounds)))
    rank = F.col("n") * q
    out = F.lit(float(bounds[-1]))
    for i in range(len(bounds) - 1, -1, -1):
        low, under = (float(bounds[i - 1]), F.col(f"c{i - 1}")) if i else (0.0, F.lit(0))
        inside = F.col(f"c{i}") - under
        at = F.lit(low) + (float(bounds[i]) - low) * (rank - under) / F.when(inside > 0, inside).otherwise(1)
        out = F.when(F.col(f"c{i}") >= rank, at).otherwise(out)
    return counts.select(*by, F.when(F.col("n") > 0, out).alias("quantile"), "n")


def error_ratio(events: DataFrame, bad: Column, by: tuple[str, ...] = ()) -> DataFrame:
    return events.groupBy(*by).agg((100.0 * F.count_if(bad) / F.count("*")).alias("error_percent"), F.count("*").alias("n"))


def grouped_ratio(events: DataFrame, top: Column, bottom: Column, by: tuple[str, ...]) -> DataFrame:
    return events.groupBy(*by).agg((F.sum(top) / F.sum(bottom)).alias("ratio"))


def lifetime(events: DataFrame, ts: str = "ts", value: str = "value") -> DataFrame:
    """Mean of all events, and events a second since the first."""
    seconds = F.unix_timestamp(F.max(ts)) - F.unix_timestamp(F.min(ts))
    return events.agg((F.sum(value) / F.count(value)).alias("mean"), (F.count("*") / F.greatest(seconds, F.lit(1))).alias("per_second"))


def sessions(events: DataFrame, gap: str, by: tuple[str, ...], *aggregates: Column, ts: str = "ts") -> DataFrame:
    return _bounds(watched(events, ts).groupBy(F.session_window(ts, gap).alias("window"), *by).agg(*aggregates))


def label_matches(column: Column, pattern: str) -> Column:
    """A label matcher: the whole value."""
    return column.rlike(f"^(?:{pattern})$")


def parse_logs(lines: DataFrame, line: str = "value", fields: str = "timestamp string, level string, message string, correlation_id string", seen: str | None = None) -> DataFrame:
    """Log lines as rows: blank ones go, malformed ones keep their text as the message, the time falls back to when the
    line was seen."""
    rows = lines.where(F.col(line).rlike(r"\S"))
    told = rows.withColumn("_j", F.from_json(line, fields, {"mode": "PERMISSIVE"}))
    when = F.coalesce(F.try_to_timestamp(F.col("_j.timestamp")), F.col(seen) if seen else F.lit(None).cast("timestamp"))
    return told.select(when.alias("ts"), F.coalesce(F.lower("_j.level"), F.lit("unknown")).alias("level"), F.coalesce("_j.message", line).alias("message"), F.col("_j.correlation_id").alias("correlation_id"))


def relabel(rows: DataFrame, source: str, pattern: str, target: str, fallback: Column | None = None, keep: str | None = None) -> DataFrame:
    """A label from the first group of a pattern, else the fallback; with keep, only rows whose label matches it."""
    found = F.regexp_extract(source, pattern, 1)
    rows = rows.withColumn(target, F.coalesce(F.when(found != "", found), fallback if fallback is not None else F.lit(None)))
    return rows.where(label_matches(F.col(target), keep)) if keep else rows


def relevance(hits: DataFrame, by: str = "query_id", most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Scores cut to [0, 1]: mean by query and source, and the first `most` ranks of each."""
    cut = hits.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))))
    w = Window.partitionBy(by, "source").orderBy(F.desc("score"), "chunk_id")
    return cut.groupBy(by, "source").agg(F.avg("score").alias("avg_score"), F.count("*").alias("n")), cut.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def to_table(df: DataFrame, path: str, checkpoint: str, merge: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Finished windows to Parquet, or to merge(batch, number), which must be idempotent for a batch's number."""
    writer = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(merge).start() if merge else writer.format("parquet").option("path", path).start()


def emitted(requests: DataFrame, bounds: list[float], by: tuple[str, ...] = ("method", "endpoint", "status"), seconds: str = "seconds") -> DataFrame:
    """What a service would export of its requests: name, labels, le, value: a counter, and a histogram of durations with
    cumulative buckets (le is null but in buckets), its sum and count."""
    groups = requests.groupBy(*by).agg(F.count("*").cast("double").alias("_n"), F.sum(seconds).alias("_s"), *(F.count_if(F.col(seconds) <= b).cast("double").alias(f"_b{i}") for i, b in enumerate(bounds)))
    labels = F.create_map(*(x for c in by for x in (F.lit(c), F.col(c).cast("string"))))
    sample = lambda name, le, value: F.struct(F.lit(name).alias("name"), F.lit(le).cast("string").alias("le"), value.alias("value"))
    buckets = [sample("http_request_duration_seconds_bucket", str(b), F.col(f"_b{i}")) for i, b in enumerate(bounds)]
    every = [sample("http_requests_total", None, F.col("_n")), *buckets, sample("http_request_duration_seconds_bucket", "+Inf", F.col("_n")), sample("http_request_duration_seconds_sum", None, F.col("_s")), sample("http_request_duration_seconds_count", None, F.col("_n"))]
    return groups.select(labels.alias("labels"), F.explode(F.array(*every)).alias("m")).select("m.name", "labels", "m.le", "m.value")
