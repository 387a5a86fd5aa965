"""Cases of findings that the third round left open."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

from pyspark.sql import functions as F

from sievework.operators import entities, graph, grams, segments
from sievework.plans import telemetry
from sievework.session import shared_folder
from sievework.streaming import counters


def test_no_text_goes_by_its_question(spark):
    """texts were shuffled by question, so that one task read all that a frequent word is in."""
    chunks = spark.createDataFrame([(i, f"the w{i} text") for i in range(40)] + [(40, None)], "chunk_id long, content string")
    queries = spark.createDataFrame([("a", ["the", "w17"]), ("b", ["none"]), ("c", ["w11"])], "query_id string, keywords array<string>")
    found = graph.by_content(chunks, queries, index=grams.build(chunks, shared_folder(spark)))
    assert not re.search(r"hashpartitioning\(query_id#\d+, \d+\)", found._jdf.queryExecution().toString())
    rows = lambda df: sorted(map(tuple, df.select("query_id", "chunk_id", "content", "match_count", "graph_score").collect()))
    assert rows(found) == rows(graph.by_content(chunks, queries)) and found.count() == 41


def test_tasks_count_a_bounded_number_of_pairs(spark, monkeypatch):
    """shuffles were cut by bytes of rows, and a task counted all pairs of its rows."""
    monkeypatch.setattr(entities, "DEALT", 50, raising=False)
    rows = [(c, (c * 7 + i * i) % 60) for c in range(40) for i in range(8)]
    found = entities.related(spark.createDataFrame([*rows, *rows[:9], (None, 1), (None, 2), (3, None)], "src long, dst long"))
    held = {c: {e for d, e in rows if d == c} for c in range(40)} | {None: {1, 2}}
    want = Counter(p for e in held.values() for p in permutations(e, 2))
    assert {(r["src"], r["dst"]): r["n_chunks"] for r in found.collect()} == want
    parts = [int(n) for n in re.findall(r"hashpartitioning\(a#\d+L, b#\d+L, (\d+)\), REPARTITION_BY_NUM", found._jdf.queryExecution().toString())]
    assert parts and min(parts) >= sum(want.values()) / 2 / 50


def test_gone_documents_are_found_whether_few_or_many(spark, monkeypatch):
    """rows with all their terms were sorted in tasks as large as the session cuts them."""
    monkeypatch.setattr(segments, "TOKENS", 50, raising=False)
    monkeypatch.setattr(segments, "CHARS", 200, raising=False)
    docs = spark.createDataFrame([(i, f"the w{i} text {'x ' * (i % 5)}") for i in range(200)] + [(None, "no id"), (200, None)], "doc_id long, text string")
    plan = segments.term_counts(docs)._jdf.queryExecution().toString()
    parts = re.findall(r"hashpartitioning\(doc_id#\d+L, (\d+)\), REPARTITION_BY_NUM", plan)
    assert parts and int(parts[0]) > 10
    index = segments.Segments(spark, shared_folder(spark)).upsert(docs)
    gone = spark.range(0, 201, 3)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    told = []
    for sent in (1_000, 10):  # ids are sent, or rows are dealt
        monkeypatch.setattr(segments, "SENT", sent, raising=False)
        left = segments.Segments(spark, index.path, index.rows).delete(gone)
        told.append((left.n, left.total, sorted(map(tuple, left.terms().collect())), sorted(r["id"] for r in left.merge().documents().collect())))
    assert told[0] == told[1] and told[0][3] == [i for i in range(201) if i % 3] and told[0][0] == 134
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before


def test_spans_of_a_series_go_to_tasks_by_themselves(spark, tmp_path, monkeypatch):
    """a series was one group of rows, which Python took one by one."""
    hour = counters.HOUR
    monkeypatch.setattr(counters, "SPAN", 6 * hour, raising=False)
    monkeypatch.setattr(counters, "PACK", 7, raising=False)
    rng = random.Random(14)
    # Times before and after 1970, some of them equal, in spans of which many have none, in any order.
    samples = [(rng.randrange(3), rng.choice((-9, -2, -1, 0, 1, 5, 6, 30)) * 6 * hour + rng.randrange(13) * hour // 2, i, float(rng.randrange(9))) for i in range(240)]
    samples += [(7, 0, 1000, 3.0), (7, 6 * hour, 1001, float("nan")), (7, 13 * hour, 1002, 4.0), (8, 6 * hour, 1003, float("inf")), (8, 0, 1004, 1.0), (8, 20 * hour, 1005, 2.0)]
    odd = [(None, 0, 1, 1.0), (1, None, 2, 1.0), (1, 0, 3, None)]
    schema, where = "series int, ts timestamp, nr long, value double", str(tmp_path / "in")
    for part in range(3):
        rows = spark.createDataFrame(samples[part::3] + odd, "series int, at long, nr long, value double")
        rows.select("series", F.timestamp_micros("at").alias("ts"), "nr", "value").coalesce(1).write.mode("append").parquet(where)

    def want(idle):
        out, before = defaultdict(float), {}
        for series, at, _, value in sorted(samples, key=lambda r: r[:3]):
            b = before.get(series)
            out[series, at] += 0.0 if b is None or (idle and at - b[0] > idle) else value - b[1] if value >= b[1] else value
            before[series] = at, value
        return out

    before = {k: spark.conf.get(k, None) for k in counters.ROCKS}
    for key, value in counters.ROCKS.items():
        spark.conf.set(key, value)
    try:
        for idle in (None, 8 * hour):
            told = counters.steps(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(where), "series", "nr", idle=idle)
            # Two columns of a group, series and span; before it was the series alone.
            assert re.search(r"TransformWithState\w* \w+\([^)]*\)#\d+, 2,", told._jdf.queryExecution().analyzed().toString())
            counters.by_batch(told, str(tmp_path / f"out{idle}"), str(tmp_path / f"check{idle}"), lambda b: b).awaitTermination()
            got = defaultdict(float)
            for r in spark.read.parquet(str(tmp_path / f"out{idle}")).collect():
                got[r["series"], r["at"]] += r["delta"]
            assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in want(idle).items()}
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_events_arrive_in_files_of_bounded_size(spark, monkeypatch):
    """a quarter of the events was one file, written and read by one task."""
    monkeypatch.setattr(telemetry, "ARRIVING", 50, raising=False)
    folder = telemetry._arriving(spark, "/root/testdata/sf0.001")[0]
    rows = spark.read.parquet(folder)
    assert rows.count() == 1000 and len(rows.inputFiles()) > 8
    rate = lambda df: sorted(map(tuple, df.collect()))
    assert rate(telemetry.stream_rate(spark, "/root/testdata/sf0.001")) == rate(telemetry.rate_5m(spark, "/root/testdata/sf0.001"))
    assert rate(telemetry.stream_counts(spark, "/root/testdata/sf0.001")) == rate(telemetry.count_over_time(spark, "/root/testdata/sf0.001"))
