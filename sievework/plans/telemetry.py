"""Windowed analytics over events, as batches and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievework.plans.common import read
from sievework.session import shared_folder
from sievework.sources import tails
from sievework.streaming import counters, telemetry

#: Bucket bounds of the quantile query.
BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0]
#: Rows of a file of events that arrive.
ARRIVING = 500_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events")


def _start(df: DataFrame) -> Column:
    return F.unix_timestamp("window_start").alias("window_start")


def rate_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type's value read as a counter that resets, over 5 minutes every minute."""
    out = telemetry.counter_rate(_events(spark, sf_dir), by=("event_type",), order=("event_id",))
    return out.select(_start(out), "event_type", F.round("rate", 6).alias("rate"))


def window_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = telemetry.over_time(_events(spark, sf_dir), "1 hour", F.avg("value").alias("mean"), F.count("*").alias("n"), by=("event_type",))
    return out.select(_start(out), "event_type", F.round("mean", 6).alias("mean"), "n")


def bucket_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p95 = telemetry.bucket_quantile(_events(spark, sf_dir), BOUNDS, 0.95, by=("event_type",)).select("event_type", F.round("quantile", 6).alias("p95"), "n")
    p50 = telemetry.bucket_quantile(_events(spark, sf_dir), BOUNDS, 0.5, by=("event_type",)).select("event_type", F.round("quantile", 6).alias("p50"))
    return p95.join(p50, "event_type")


def error_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = telemetry.error_ratio(_events(spark, sf_dir), F.col("event_type") == "error", by=("user_id",))
    return out.select("user_id", F.round("error_percent", 6).alias("error_percent"), "n")


def group_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.round(F.sum("value"), 4).alias("total"))


def grouped_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = telemetry.grouped_ratio(_events(spark, sf_dir), F.col("value"), F.lit(1), ("user_id", "event_type"))
    return out.select("user_id", "event_type", F.round("ratio", 6).alias("ratio"))


def lifetime_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.lifetime(_events(spark, sf_dir)).select(F.round("mean", 6).alias("mean"), F.round("per_second", 9).alias("per_second"))


def label_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where(telemetry.label_matches(F.col("event_type"), "cl.*|err..")).groupBy("event_type").agg(F.count("*").alias("n"))


def count_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = telemetry.over_time(_events(spark, sf_dir), "5 minutes", F.count("*").alias("n"), by=("event_type",))
    return out.select(_start(out), "event_type", "n")


def log_rate_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = telemetry.over_time(_events(spark, sf_dir), "1 minute", (F.count("*") / 60).alias("rate"))
    return out.select(_start(out), F.round("rate", 9).alias("rate"))


def log_json_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines: some are blank, some malformed, some without a time."""
    e = _events(spark, sf_dir)
    line = F.when(F.pmod("event_id", F.lit(11)) == 0, "  ").when(F.pmod("event_id", F.lit(13)) == 0, F.concat(F.lit("{broken "), "event_type")).otherwise(F.to_json(F.struct(F.when(F.pmod("event_id", F.lit(7)) > 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"), F.upper("event_type").alias("level"), F.concat(F.lit("took "), F.col("value").cast("string")).alias("message"), F.col("user_id").cast("string").alias("correlation_id"))))
    out = telemetry.parse_logs(e.select(line.alias("value"), F.date_trunc("day", "ts").alias("seen")), seen="seen")
    return out.where(F.col("message").contains("took") | F.col("message").contains("error")).groupBy("level", "correlation_id").agg(F.count("*").alias("n"), F.max(F.unix_timestamp("ts")).alias("last"))


def relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = telemetry.relabel(_events(spark, sf_dir), "props", r'"k": (\d)\d', "decade", F.lit("none"), keep="[1-4]|none")
    return out.groupBy("decade").agg(F.count("*").alias("n"))


def session_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events with less than 6 hours between them."""
    out = telemetry.sessions(_events(spark, sf_dir), "6 hours", ("user_id",), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select("user_id", _start(out), "n", "total")


def correlation_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.min(F.unix_timestamp("ts")).alias("first"), F.max(F.unix_timestamp("ts")).alias("last"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"))
    return w


def _arriving(spark: SparkSession, sf_dir: str, parts: int = 4) -> tuple[str, StructType, int]:
    """A folder of events that arrive in falling order of time, in parts of as many files as make about ARRIVING rows each."""
    folder = f"{shared_folder(spark)}/arriving"
    events = _events(spark, sf_dir)
    first, last, n = events.agg(F.unix_micros(F.min(F.col("ts").cast("timestamp"))), F.unix_micros(F.max(F.col("ts").cast("timestamp"))), F.count("*")).first()
    part = F.least(F.lit(parts - 1), F.floor(parts * (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(first)) / F.lit(max(1, last - first))))
    files = 1 + n // (parts * ARRIVING)
    for i in reversed(range(parts)):
        rows = events.where(part == i)
        # By hour, so that a file has whole hours; one file needs no shuffle.
        rows = rows.coalesce(1) if files == 1 else rows.repartition(files, F.date_trunc("hour", "ts"))
        rows.write.mode("append").parquet(folder)
    return folder, events.schema, files


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """count_over_time as a stream of files that arrive in falling order of time: batches are counted by themselves, and
    their counts add up."""
    source, schema, files = _arriving(spark, sf_dir)
    folder = shared_folder(spark)
    counts = lambda events: telemetry.over_time(events, "5 minutes", F.count("*").alias("n"), by=("event_type",))
    counters.by_batch(telemetry.stream(spark, source, schema, files), f"{folder}/table", f"{folder}/checkpoint", counts).awaitTermination()
    every = spark.read.parquet(f"{folder}/table")
    return every.groupBy(_start(every), "event_type").agg(F.sum("n").alias("n"))


def stream_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rate_5m as a stream of files that arrive in falling order of time."""
    source, schema, files = _arriving(spark, sf_dir)
    return streamed_rate(spark, source, schema, shared_folder(spark), files)


def streamed_rate(spark: SparkSession, source: str, schema: StructType, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """The rates of what has arrived in source so far; called again with the same folder, it goes on where it was."""
    before = {k: spark.conf.get(k, None) for k in counters.ROCKS}
    for key, value in counters.ROCKS.items():
        spark.conf.set(key, value)
    try:
        deltas = counters.steps(telemetry.stream(spark, source, schema, files_per_trigger), "event_type", "event_id")
        rates = lambda rows: telemetry.over_time(rows.withColumn("ts", F.timestamp_micros("at")), "5 minutes", F.sum("delta").alias("increase"), slide="1 minute", by=("series",))
        counters.by_batch(deltas, f"{folder}/table", f"{folder}/checkpoint", rates).awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    every = spark.read.parquet(f"{folder}/table")
    return every.groupBy(_start(every), F.col("series").alias("event_type")).agg(F.round(F.sum("increase") / 300, 6).alias("rate"))


def exposed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_sum over events that are written as exposition text and read back as a stream of growing files, in two runs
    of one query: the second goes on at the offsets of the first."""
    folder = shared_folder(spark)
    labels = F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("")))
    lines = tails.exposed(F.lit("event_value"), labels, F.col("value"), F.col("ts"))
    sums = lambda rows: tails.samples(rows).groupBy(F.col("labels")["type"].alias("event_type"), F.col("labels")["k"].try_cast("int").alias("k")).agg(F.sum("value").alias("total"))
    for half in (0, 1):
        rows = _events(spark, sf_dir).where((F.col("event_id") % 2 == half) & F.col("value").isNotNull())
        rows.select(lines.alias("value")).write.mode("append").text(f"{folder}/lines")
        counters.by_batch(tails.lines(spark, f"{folder}/lines", ".txt", stream=True), f"{folder}/table", f"{folder}/checkpoint", sums).awaitTermination()
    return spark.read.parquet(f"{folder}/table").groupBy("event_type", "k").agg(F.round(F.sum("total"), 4).alias("total"))


def metric_emission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: types are endpoints, odd users get errors, values are seconds."""
    e = _events(spark, sf_dir).select(F.lit("GET").alias("method"), F.col("event_type").alias("endpoint"), F.when(F.pmod("user_id", F.lit(2)) == 1, "500").otherwise("200").alias("status"), F.col("value").alias("seconds"))
    out = telemetry.emitted(e, [10.0, 100.0])
    return out.select("name", F.element_at("labels", "endpoint").alias("endpoint"), F.element_at("labels", "status").alias("status"), "le", F.round("value", 4).alias("value"))


def rate_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one counter that resets."""
    out = telemetry.counter_rate(_events(spark, sf_dir), order=("event_id",))
    return out.select(_start(out), F.round("rate", 6).alias("rate"))


QUERIES = {f.__name__: f for f in (rate_5m, window_mean, bucket_quantile, error_ratio, group_sum, grouped_ratio, lifetime_rate, label_regex, count_over_time, log_rate_1m, log_json_filter, relabel, session_trace, correlation_trace, stream_counts, stream_rate, exposed_metrics, metric_emission, rate_of_all)}

_COUNTS = "SELECT CAST(floor(epoch(ts) / 300) * 300 AS BIGINT) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"


def _quantile(q: float) -> str:
    cases = []
    for i, b in enumerate(BOUNDS):
        low, under = (BOUNDS[i - 1], f"count(*) FILTER (value <= {BOUNDS[i - 1]})") if i else (0.0, "0")
        cases.append(f"WHEN count(*) FILTER (value <= {b}) >= count(value) * {q} THEN {low} + ({b - low}) * (count(value) * {q} - {under}) / greatest(1, count(*) FILTER (value <= {b}) - {under})")
    return f"round(CASE {' '.join(cases)} ELSE {BOUNDS[-1]} END, 6)"


ORACLES = {
    "rate_5m": """WITH s AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS b FROM events),
d AS (SELECT event_type, epoch(ts) AS t, CASE WHEN b IS NULL THEN 0 WHEN value >= b THEN value - b ELSE value END AS step FROM s),
w AS (SELECT event_type, step, CAST(floor(t / 60) * 60 AS BIGINT) - 60 * k AS window_start FROM d, range(0, 5) AS r(k))
SELECT window_start, event_type, round(sum(step) / 300, 6) AS rate FROM w GROUP BY ALL""",
    "rate_of_all": """WITH s AS (SELECT *, lag(value) OVER (ORDER BY ts, event_id) AS b FROM events),
d AS (SELECT epoch(ts) AS t, CASE WHEN b IS NULL THEN 0 WHEN value >= b THEN value - b ELSE value END AS step FROM s),
w AS (SELECT step, CAST(floor(t / 60) * 60 AS BIGINT) - 60 * k AS window_start FROM d, range(0, 5) AS r(k))
SELECT window_start, round(sum(step) / 300, 6) AS rate FROM w GROUP BY ALL""",
    "metric_emission": """WITH r AS (SELECT event_type AS endpoint, CASE WHEN user_id % 2 = 1 THEN '500' ELSE '200' END AS status, value FROM events),
g AS (SELECT endpoint, status, CAST(count(*) AS DOUBLE) AS n, round(sum(value), 4) AS s, CAST(count(*) FILTER (value <= 10) AS DOUBLE) AS b0, CAST(count(*) FILTER (value <= 100) AS DOUBLE) AS b1 FROM r GROUP BY ALL)
SELECT 'http_requests_total' AS name, endpoint, status, NULL::VARCHAR AS le, n AS value FROM g
UNION ALL SELECT 'http_request_duration_seconds_bucket', endpoint, status, '10.0', b0 FROM g UNION ALL SELECT 'http_request_duration_seconds_bucket', endpoint, status, '100.0', b1 FROM g
UNION ALL SELECT 'http_request_duration_seconds_bucket', endpoint, status, '+Inf', n FROM g
UNION ALL SELECT 'http_request_duration_seconds_sum', endpoint, status, NULL, s FROM g UNION ALL SELECT 'http_request_duration_seconds_count', endpoint, status, NULL, n FROM g""",
    "window_mean": "SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS window_start, event_type, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY ALL",
    "bucket_quantile": f"SELECT event_type, CAST({_quantile(0.95)} AS DOUBLE) AS p95, count(value) AS n, CAST({_quantile(0.5)} AS DOUBLE) AS p50 FROM events GROUP BY event_type",
    "error_ratio": "SELECT user_id, CAST(round(100.0 * count(*) FILTER (event_type = 'error') / count(*), 6) AS DOUBLE) AS error_percent, count(*) AS n FROM events GROUP BY user_id",
    "group_sum": "SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "grouped_ratio": "SELECT user_id, event_type, round(sum(value) / count(*), 6) AS ratio FROM events GROUP BY ALL",
    "lifetime_rate": "SELECT round(avg(value), 6) AS mean, round(count(*) / greatest(floor(epoch(max(ts))) - floor(epoch(min(ts))), 1), 9) AS per_second FROM events",
    "label_regex": "SELECT event_type, count(*) AS n FROM events WHERE regexp_full_match(event_type, 'cl.*|err..') GROUP BY event_type",
    "count_over_time": _COUNTS,
    "log_rate_1m": "SELECT CAST(floor(epoch(ts) / 60) * 60 AS BIGINT) AS window_start, round(count(*) / 60, 9) AS rate FROM events GROUP BY 1",
    "log_json_filter": """WITH l AS (SELECT *, event_id % 13 = 0 AS broken FROM events WHERE event_id % 11 <> 0),
p AS (SELECT CASE WHEN broken THEN 'unknown' ELSE event_type END AS level, CASE WHEN broken THEN NULL ELSE CAST(user_id AS VARCHAR) END AS correlation_id,
  CASE WHEN broken THEN '{broken ' || event_type ELSE 'took ' END AS message, CASE WHEN broken OR event_id % 7 = 0 THEN epoch(date_trunc('day', ts)) ELSE floor(epoch(ts)) END AS t FROM l)
SELECT level, correlation_id, count(*) AS n, CAST(max(t) AS BIGINT) AS last FROM p WHERE contains(message, 'took') OR contains(message, 'error') GROUP BY ALL""",
    "relabel": """WITH d AS (SELECT coalesce(nullif(regexp_extract(props, '"k": (\\d)\\d', 1), ''), 'none') AS decade FROM events) SELECT decade, count(*) AS n FROM d WHERE regexp_full_match(decade, '[1-4]|none') GROUP BY decade""",
    "session_trace": """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""",
    "correlation_trace": "SELECT user_id, count(*) AS n, CAST(floor(epoch(min(ts))) AS BIGINT) AS first, CAST(floor(epoch(max(ts))) AS BIGINT) AS last, arg_min(event_type, (ts, event_id)) AS first_type FROM events GROUP BY user_id",
    "stream_counts": _COUNTS,
}
ORACLES["exposed_metrics"] = ORACLES["group_sum"]
ORACLES["stream_rate"] = ORACLES["rate_5m"]
