"""Cases of the fourth round's findings."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sievework.operators import segments
from sievework.session import shared_folder

WORDS = ["Été", "the", "x_1", "ßa", *(f"w{i}" for i in range(300))]


def texts(n, seed, key=lambda i: i):
    rng = random.Random(seed)
    return {key(i): " ".join(rng.choices(WORDS, weights=[200, 300, *range(len(WORDS) - 2, 0, -1)], k=rng.choice((0, 1, 5, 40)))) for i in range(n)}


def counts(rows):
    return {k: Counter(re.findall(r"\w+", (t or "").lower())) for k, t in rows.items()}


@pytest.fixture
def small(spark, monkeypatch):
    """Small tasks, of which there are many, and small Arrow batches."""
    for name, value in {"TOKENS": 300, "CHARS": 3000, "LISTED": 200, "BUCKET": 400, "SALTED": 150, "DEALT": 40, "SCANNED": 1 << 16}.items():
        monkeypatch.setattr(segments, name, value, raising=False)
    told = {"spark.sql.execution.arrow.maxRecordsPerBatch": "30", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in told}
    for key, value in told.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", [lambda i: i - 40, lambda i: f"d{i:03}"])
@pytest.mark.parametrize("sent", [1_000, 1])
def test_a_merge_moves_no_documents_and_notes_hold_none(spark, small, monkeypatch, key, sent):
    """documents with their terms were written again for each note, and shuffled to be told from gone ones and for a merge."""
    monkeypatch.setattr(segments, "SENT", sent, raising=False)
    kind = "long" if isinstance(key(0), int) else "string"
    table = lambda rows: spark.createDataFrame(list(rows.items()), f"doc_id {kind}, text string")
    rows = texts(400, 1, key) | {key(401): None, key(402): ""}
    index = segments.Segments(spark, shared_folder(spark)).upsert(table(rows))
    new = {k: t for i, (k, t) in enumerate(texts(420, 2, key).items()) if i % 3}
    index, rows = index.upsert(table(new)), rows | new
    lost = [key(i) for i in (*range(0, 420, 7), 5000)]
    index = index.delete(spark.createDataFrame([(k,) for k in lost], f"id {kind}"))
    rows = {k: t for k, t in rows.items() if k not in lost}
    notes = spark.read.parquet(*(f"{index.path}/gone/{n}/docs" for n in {r["name"] for r in index.rows if r["kind"] == "gone"}))
    assert "terms" not in notes.columns and notes.count() == sum(r["n"] for r in index.rows if r["kind"] == "gone")
    if sent > 1:
        assert "SortMergeJoin" not in plan(index.documents()) and "ShuffledHashJoin" not in plan(index.documents())
    held = counts(rows)
    df = Counter(w for c in held.values() for w in c)
    want = {"documents": len(rows), "tokens": sum(sum(c.values()) for c in held.values()), "postings": sum(map(len, held.values())), "terms": len(df), "term characters": sum(map(len, df))}
    names = ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum")
    before = [spark.conf.get(c, None) for c in names]
    for state in (index, index.merge(), index.copy(shared_folder(spark)), index.merge([index.segments[0]["name"]])):
        assert {r["name"]: r["n"] for r in state.statistics().collect()} == want
        assert {r["id"]: ({t["term"]: t["tf"] for t in r["terms"]}, r["dl"]) for r in state.documents().collect()} == {k: (dict(c), sum(c.values())) for k, c in held.items()}
        assert {r["term"]: r["df"] for r in state.terms().collect()} == df
    assert [spark.conf.get(c, None) for c in names] == before


@pytest.mark.parametrize("key", [lambda i: (i - 40) << 33, lambda i: f"d{i:03}"])
def test_lists_are_moved_as_bytes_and_arrive_whole(spark, small, key):
    """each list of a term and block was a row of a shuffle, with three arrays of its own."""
    rows = texts(500, 3, key)
    kind = "long" if isinstance(key(0), int) else "string"
    index = segments.Segments(spark, shared_folder(spark)).upsert(spark.createDataFrame(list(rows.items()), f"doc_id {kind}, text string"))
    (segment,) = index.segments
    docs = spark.read.parquet(f"{index.path}/segments/{segment['name']}/docs")
    block = {r["id"]: r["block"] for r in docs.collect()}
    assert len(set(block.values())) > 5 and segment["buckets"] > 5
    dealt = segments.dealt_lists(docs, segment["buckets"], 3, 12)
    assert plan(dealt).count("Exchange") == 1 and re.search(r"Exchange [^\n]*part#\d+[^\n]*\n[^\n]*MapInArrow pack[^\n]*\[part#\d+, size#\d+L, packed#\d+\]", plan(dealt))
    held = defaultdict(list)
    for k, c in counts(rows).items():
        for term, tf in c.items():
            held[term, block[k]].append((k, tf, sum(c.values())))
    bucket = {r["term"]: r["b"] for r in spark.createDataFrame([(w,) for w, _ in held], "term string").select("term", segments.bucket_of(F.col("term"), segment["buckets"]).alias("b")).collect()}
    for lists in (dealt, spark.read.parquet(f"{index.path}/segments/{segment['name']}/postings")):
        got = defaultdict(list)
        for r in lists.collect():
            assert r["n"] == len(r["docs"]) and r["most_tf"] == max(d["tf"] for d in r["docs"]) and r["least_dl"] == min(d["dl"] for d in r["docs"]) and r["bucket"] == bucket[r["term"]]
            got[r["term"], r["block"]] += map(tuple, r["docs"])
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in held.items()}
        first = lists.where("df IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df")).collect()
        assert {r["term"]: r["df"] for r in first} == Counter(w for c in counts(rows).values() for w in c) and lists.where("df IS NULL").count() > 0
    assert segments.dealt_lists(docs.where("false"), 1, 1, 1).isEmpty()
