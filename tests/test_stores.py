"""Stored indexes, automaton, blocks of pairs, frontier search, tails and counters against plain models."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import bm25, clusters, dense, entities, grams, graph
from sievework.operators.segments import BLOCK, Segments
from sievework.session import shared_folder
from sievework.sources import tails
from sievework.streaming import counters

WORDS = [f"w{i}" for i in range(60)]


def texts(n, seed=1, size=40):
    rng = random.Random(seed)
    return {i: " ".join(rng.choices(WORDS, weights=range(60, 0, -1), k=rng.randrange(1, size))) for i in range(n)}


def table(spark, rows):
    return spark.createDataFrame(list(rows.items()), "doc_id long, text string")


def scores(rows, queries):
    """BM25 of each (query, document) by hand."""
    counts = {i: Counter(re.findall(r"[\w]+", (t or "").lower())) for i, t in rows.items()}
    n, avg = len(rows), sum(sum(c.values()) for c in counts.values()) / max(1, len(rows))
    df = Counter(w for c in counts.values() for w in c)
    out = {}
    for q, words in queries.items():
        for i, c in counts.items():
            s = sum(log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / avg)) for w in words.split() if c[w])
            if s:
                out[q, i] = round(s, 6)
    return out


def best(found, k):
    ranked = defaultdict(list)
    for (q, i), s in found.items():
        ranked[q].append((-s, i))
    return {q: sorted(r)[:k] for q, r in ranked.items()}


QUERIES = {"a": "w1 w2 w59", "b": "w58 w58", "c": "w0 w3 w5 w7", "d": "absent"}


def asked(spark):
    return spark.createDataFrame(list(QUERIES.items()), "query_id string, query string")


def found(index, spark, k=5, **more):
    rows = bm25.top(index.search(asked(spark), k, **more).withColumn("score", F.round("score", 6)), k)
    return best({(r["query_id"], r["id"]): r["score"] for r in rows.collect()}, k)


# ---- segments -----------------------------------------------------------------------------------------------------


def test_index_over_changes_equals_scores_by_hand(spark):
    rows = texts(700) | {700: None, 701: "", 702: "W1 w1  W59"}
    index = Segments(spark, shared_folder(spark)).upsert(table(spark, rows))
    assert found(index, spark) == best(scores(rows, QUERIES), 5)
    new = {i: f"w59 w{i % 7}" for i in range(0, 700, 50)} | {900: "w58", 3: ""}
    second = index.upsert(table(spark, new))
    rows2 = rows | new
    assert found(second, spark) == best(scores(rows2, QUERIES), 5)
    third = second.delete(spark.createDataFrame([(i,) for i in (*range(0, 90), 5555)], "id long"))
    rows3 = {i: t for i, t in rows2.items() if i >= 90}
    assert found(third, spark) == best(scores(rows3, QUERIES), 5) and third.n == len(rows3)
    for merged in (third.merge(), third.merge([third.segments[0]["name"]])):
        assert found(merged, spark) == best(scores(rows3, QUERIES), 5) and merged.n == len(rows3)
        assert sorted(map(tuple, merged.statistics().collect())) == sorted(map(tuple, third.statistics().collect()))
    # Earlier versions stay whole, and the folder opens at the one published last.
    assert found(index, spark) == best(scores(rows, QUERIES), 5)
    assert Segments.open(spark, index.path).n == len(rows3)
    kept = spark.createDataFrame([(i,) for i in range(100, 200)], "id long")
    want = {k: s for k, s in scores(rows3, QUERIES).items() if 100 <= k[1] < 200}
    assert found(third, spark, kept=kept) == best(want, 5)
    assert found(third, spark, k=10_000) == best(scores(rows3, QUERIES), 10_000)


def test_upsert_of_a_hundredth_writes_about_as_much(spark):
    rows = texts(6000, size=200)
    index = Segments(spark, shared_folder(spark)).upsert(table(spark, rows))
    size = lambda x: x.sizes().agg(F.sum("bytes")).first()[0]
    before = size(index)
    after = index.upsert(table(spark, {i: rows[i] + " w7" for i in range(0, 6000, 100)}))
    assert 0 < size(after) - before < 0.1 * before  # file footers weigh on tables this small
    assert {r["part"] for r in after.sizes().collect()} == {"docs", "postings", "terms"} and after.sizes().where("part = 'postings' AND bucket IS NULL").isEmpty()


def test_search_reads_only_blocks_that_can_win(spark):
    rows = texts(100 * BLOCK, size=6) | {i: "w59 w59 w1 rare" for i in range(20_000, 20_008)}
    index = Segments(spark, shared_folder(spark)).upsert(table(spark, rows).coalesce(1))
    queries = spark.createDataFrame([("a", "w1 rare")], "query_id string, query string")
    lists, _, blocks = index.blocks(queries, 5)
    told = blocks.agg(F.count("*").alias("n"), F.count_if("wins").alias("wins")).first()
    assert told["n"] >= 50 and told["wins"] <= 3
    assert {r["id"] for r in bm25.top(index.search(queries, 5), 5).collect()} == {20_000, 20_001, 20_002, 20_003, 20_004}
    assert lists.agg(F.max("n")).first()[0] <= BLOCK


def test_a_write_that_is_cut_off_changes_nothing(spark):
    rows = texts(50)
    index = Segments(spark, shared_folder(spark)).upsert(table(spark, rows))
    index._segment(index.documents())  # written, not published
    assert found(Segments.open(spark, index.path), spark) == best(scores(rows, QUERIES), 5)


def test_empty_index(spark):
    index = Segments.open(spark, shared_folder(spark))
    assert index.search(asked(spark), 5).isEmpty() and index.statistics().agg(F.sum("n")).first()[0] == 0
    none = index.upsert(table(spark, {1: "w1"}).where("false"))
    assert none.search(asked(spark), 5).isEmpty() and none.merge().n == 0
    many = none
    for i in range(11):
        many = many.upsert(table(spark, {i: f"w{i} w1"}))
    assert len(many.segments) <= 10 and found(many, spark) == best(scores({i: f"w{i} w1" for i in range(11)}, QUERIES), 5)


def test_rewritten_tables_are_indexed_anew(spark):
    from sievework.plans.retrieval import bm25_index

    folder = shared_folder(spark)
    for rows in ({1: "apache license", 2: "the"}, {1: "the of"}):
        spark.createDataFrame(list(rows.items()), "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
        assert {r["doc_id"] for r in bm25_index(spark, folder).collect()} == set(rows)


# ---- trigrams -----------------------------------------------------------------------------------------------------


def test_content_search_by_grams(spark):
    rows = texts(300, 3) | {300: None, 301: "", 302: "ab", 303: "ÄÖÜ Straße xyzxyz", 304: "xyz"}
    chunks = spark.createDataFrame(list(rows.items()), "chunk_id long, content string")
    index = grams.build(chunks, shared_folder(spark))
    queries = spark.createDataFrame([("a", ["w59", "W1 W2"]), ("b", ["äöü", "yzx"]), ("c", ["ab", "nowhere"]), ("d", ["zzzz"])], "query_id string, keywords array<string>")
    plain = graph.by_content(chunks, queries)
    fast = graph.by_content(chunks, queries, index=index)
    rows_of = lambda df: sorted(map(tuple, df.select("query_id", "chunk_id", "match_count", F.round("graph_score", 9)).collect()))
    assert rows_of(fast) == rows_of(plain) and len(rows_of(fast)) > 20
    assert "NestedLoop" not in graph.by_content(chunks, queries.where("query_id <> 'c'"), index=index)._jdf.queryExecution().toString()
    near = grams.candidates(index, spark.createDataFrame([("w59",), ("straße",), ("none",)], "w string"))
    assert {(r["w"], r["id"]) for r in near.collect()} == {("w59", i) for i, t in rows.items() if t and "w59" in t} | {("straße", 303)}
    assert graph.by_content(chunks, queries.where("false"), index=index).isEmpty()
    assert grams.candidates(grams.build(chunks.where("false"), shared_folder(spark)), spark.createDataFrame([("abc",)], "w string")).isEmpty()


# ---- entities -----------------------------------------------------------------------------------------------------


def test_names_found_by_automaton(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(entities, "TOGETHER", 5)
    monkeypatch.setattr(entities, "PART", 20)
    chunks = [(i, i % 3, "".join(rng.choices("aab ", k=rng.randrange(0, 60)))) for i in range(60)] + [(60, 9, "aaa"), (61, None, "aa"), (62, 0, None), (63, 1, "AAA BA")]
    names = [(d, n) for d in (0, 1) for n in ("aa", "aab", "b a", "a", "ba", "")] + [(2, "zz"), (7, "aa")] + [(1, f"x{i}") for i in range(10_000)]
    found = entities.mentions(spark.createDataFrame(chunks, "chunk_id long, document_id long, chunk_text string"), spark.createDataFrame(names, "document_id long, normalized_name string"))
    want = {(c, n, (t or "").lower().count(n)) for c, d, t in chunks for e, n in names if n and d == e and n in (t or "").lower()}
    assert {(r["src"], r["dst"], r["frequency"]) for r in found.collect()} == want and found.count() == len(want)


@pytest.mark.parametrize("block", [1, 3, 256])
def test_pairs_of_blocks(spark, block):
    rng = random.Random(block)
    rows = [(f"c{c}", f"e{rng.randrange(30)}") for c in range(12) for _ in range(rng.choice([0, 1, 2, 20]))] + [("c1", "e1"), ("c1", "e1"), (None, "e1")]
    got = {(r["src"], r["dst"], r["n_chunks"]) for r in entities.related(spark.createDataFrame(rows, "src string, dst string"), block).collect()}
    held = defaultdict(set)
    for c, e in rows:
        held[c].add(e)
    n = Counter(p for s in held.values() for p in itertools.permutations(s, 2))
    assert got == {(a, b, k) for (a, b), k in n.items()}


def test_a_chunk_of_many_entities(spark):
    m = 3000
    rows = spark.range(m).select(F.lit("c").alias("src"), F.concat(F.lit("e"), "id").alias("dst"))
    told = entities.related(rows).agg(F.count("*").alias("n"), F.min("n_chunks").alias("a"), F.max("n_chunks").alias("b")).first()
    assert tuple(told) == (m * (m - 1), 1, 1)


# ---- frontier -----------------------------------------------------------------------------------------------------


def test_hops_past_a_hub(spark):
    chain = [("s", "h")] + [(f"l{i}", f"l{i + 1}") for i in range(8)]
    edges = spark.createDataFrame([*chain, ("h", "l0")], "src string, dst string").union(spark.range(100_000).select(F.lit("h"), F.concat(F.lit("n"), "id")))
    starts = spark.createDataFrame([("q", "s"), ("q", "l8"), ("r", "absent")], "query_id string, name string")
    rows = graph.entity_hops(edges, starts, 8)
    got = {r["hops"]: r["n"] for r in rows.where("start = 's'").groupBy("hops").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 1, 2: 100_001, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1}
    assert rows._jdf.queryExecution().toString().count("Scan") < 8  # one table, whatever the hops
    near = graph.Adjacency.of(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), hub=1000)
    assert near.hubs.first()["salts"] == 101 and near.step(spark.createDataFrame([("x", "h")], "k string, node string"), "node").count() == 100_001


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_shared_entities_by_hand(spark, hops):
    rng = random.Random(hops)
    pairs = sorted({(f"c{rng.randrange(40)}", f"e{rng.randrange(45)}") for _ in range(70)})
    of = lambda x: {e for c, e in pairs if c == x}
    seen, frontier, want = {"c1", "c2"}, {"c1", "c2"}, set()
    for hop in range(1, hops + 1):
        shared = set().union(*map(of, frontier)) if frontier else set()
        frontier = {c for c, e in pairs if e in shared} - seen
        seen |= frontier
        want |= {("q", c, len(of(c) & shared), hop) for c in frontier}
    seeds = spark.createDataFrame([("q", "c1"), ("q", "c2")], "query_id string, chunk_id string")
    got = graph.shared_entities(spark.createDataFrame(pairs * 2, "src string, dst string"), seeds, hops)
    assert set(map(tuple, got.select("query_id", "chunk_id", "shared_entities", "hop").collect())) == want


# ---- tails and counters -------------------------------------------------------------------------------------------


def test_tail_of_growing_files(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("one\ntwo\r\nhalf")
    (folder / "b.log").write_text("")
    (folder / "c.txt").write_text("not this\n")
    out, counted = str(tmp_path / "out"), lambda rows: rows.select("file", "offset", "value")

    def run(size=4):
        counters.by_batch(tails.lines(spark, str(folder), ".log", stream=True, size=size), out, str(tmp_path / "check"), counted).awaitTermination()
        return sorted(r["value"] for r in spark.read.parquet(out).collect())

    assert run() == ["one", "two"]
    with open(folder / "a.log", "a") as f:
        f.write(" done\n\nlong line of many ranges\n")
    (folder / "b.log").write_text("b\n")
    assert run() == sorted(["one", "two", "half done", "", "long line of many ranges", "b"])
    assert run() == sorted(["one", "two", "half done", "", "long line of many ranges", "b"])
    for size in (1, 3, 7, 1000):
        batch = tails.lines(spark, str(folder), ".log", size=size).where("file LIKE '%a.log'")
        assert [r["value"] for r in batch.orderBy("offset").collect()] == ["one", "two", "half done", "", "long line of many ranges"]
    assert tails.lines(spark, str(tmp_path / "nowhere")).isEmpty()


def test_exposition_round_trip(spark):
    labels = {"a": 'x"y\\n\n,}{', "b": ""}
    rows = spark.createDataFrame([("m_total", labels, 1.5, "2024-01-02 03:04:05"), ("up", {}, float("inf"), None), ("nan", {}, float("nan"), None)], "name string, labels map<string,string>, v double, at string")
    lines = rows.select(tails.exposed(F.col("name"), F.col("labels"), F.col("v"), F.to_timestamp("at")).alias("value"))
    more = spark.createDataFrame([("# HELP up Is it up",), ("",), ("bad line here x",), ("http:x 3 # no",), ("plain 7 12",)], "value string")
    got = {r["name"]: r for r in tails.samples(lines.union(more)).collect()}
    assert set(got) == {"m_total", "up", "nan", "plain"}
    assert got["m_total"]["labels"] == labels and got["m_total"]["value"] == 1.5 and got["m_total"]["ts"] is not None
    assert got["up"]["value"] == float("inf") and got["nan"]["value"] != got["nan"]["value"] and got["plain"]["ts"] is not None and got["up"]["ts"] is None


def steps_of(samples):
    out, before = {}, {}
    for series, at, nr, v in sorted(samples):
        b = before.get(series)
        out[series, at] = out.get((series, at), 0) + (0 if b is None else v - b if v >= b else v)
        before[series] = v
    return out


def test_steps_of_samples_in_any_order(spark, tmp_path):
    rng = random.Random(21)
    samples = [(f"s{i % 2}", rng.randrange(40) * 900, i, float(rng.randrange(20))) for i in range(160)]
    schema = "series string, at long, nr long, value double"
    write = lambda rows, mode="append": spark.createDataFrame(rows, schema).select("series", F.timestamp_seconds("at").alias("ts"), "nr", "value").coalesce(1).write.mode(mode).parquet(str(tmp_path / "in"))
    for key, value in counters.ROCKS.items():
        spark.conf.set(key, value)

    def run(folder, **bounds):
        source = spark.readStream.schema("series string, ts timestamp, nr long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        counters.by_batch(counters.steps(source, "series", "nr", **bounds), str(tmp_path / folder), str(tmp_path / f"{folder}-check"), lambda b: b).awaitTermination()
        return spark.read.parquet(str(tmp_path / folder)).collect()

    try:
        for part in range(3):
            write(samples[part * 40 : part * 40 + 40])
        run("out")
        write(samples[120:])
        rows = run("out")  # goes on where the first run ended
        total = defaultdict(float)
        for r in rows:
            total[r["series"], r["at"] // 1_000_000] += r["delta"]
        assert {k: v for k, v in total.items()} == steps_of(samples) and not any(r["late"] for r in rows)
        # With a horizon what is too late is passed on as such, and nothing is lost.
        short = run("short", horizon=1)
        assert sum(1 for r in short if r["late"]) > 0
        assert len({(r["series"], r["at"]) for r in short}) == len(steps_of(samples))
        idle = run("idle", idle=1)
        assert sum(r["delta"] for r in idle) < sum(steps_of(samples).values())
    finally:
        for key in counters.ROCKS:
            spark.conf.unset(key)


# ---- vectors ------------------------------------------------------------------------------------------------------


def planted(n=4000, groups=40, dim=16, seed=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return centres[rng.integers(0, groups, n)] + 0.2 * rng.normal(size=(n, dim))


def test_lists_of_planted_clusters(spark):
    x = planted()
    odd = [(9001, None), (9002, [1.0]), (9003, [float("nan")] * 16), (9004, [float("inf")] + [0.0] * 15), (None, [1.0] * 16)]
    rows = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(i, v, 0) for i, v in odd], "vec_id long, embedding array<double>, label int")
    path = shared_folder(spark)
    lists = clusters.build(rows, path, lists=40)
    assert lists.recall >= 0.95 and lists.probes <= 10 and lists.rows.count() == len(x)
    queries = spark.createDataFrame([(i, x[i * 30].tolist()) for i in range(100)] + [(999, [1.0]), (998, None)], "query_id long, vector array<double>")
    key = lambda df: {(r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect()}
    exact = key(dense.search(rows, queries.where("query_id < 998"), 10))
    assert key(lists.search(queries, 10, probes=40)) == exact and len(exact) == 1000
    near = key(clusters.load(spark, path).search(queries, 10))
    assert len({(q, i) for q, _, i, _ in near} & {(q, i) for q, _, i, _ in exact}) >= 900
    assert key(lists.search(queries, 10, where=F.col("label") == 1, probes=40)) == key(dense.search(rows.where("label = 1"), queries, 10))
    one = lists.search(queries.where("query_id = 0"), 10, probes=1)
    files = one._jdf.queryExecution().optimizedPlan().toString()
    assert "list" in files and len({r["list"] for r in lists.rows.select("list").distinct().collect()}) == 40
    with pytest.raises(ValueError):
        clusters.build(rows.where("false"), shared_folder(spark))


def test_vectors_that_are_not_finite_take_no_part(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [float("inf"), 1.0]), (4, [float("nan"), 1.0]), (5, [0.0, 0.0])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([("a", [1.0, 0.1])], "query_id string, vector array<double>")
    for k in (2, 10):
        assert [r["id"] for r in dense.search(rows, queries, k).orderBy("rank").collect()] == [1, 2, 5][:k]
