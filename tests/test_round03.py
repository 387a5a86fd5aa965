"""Cases of the third round's findings."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from sievework.functions import text
from sievework.operators import chunking, entities, graph, segments
from sievework.plans import pages, texts
from sievework.sources import files


def test_a_name_of_many_entities_is_found_once(spark):
    """each mention came once for each entity that bears the name."""
    mention = spark.createDataFrame([("c1", "hot bolt", 1.0), ("c2", "hot bolt", 2.0), ("c3", "ring", 3.0)], "src string, dst string, importance double")
    parts = spark.createDataFrame([("hot bolt", "Hot Bolt")] * 50 + [("ring", "Ring")], "normalized_name string, entity_name string")
    names = spark.createDataFrame([("q1", "Hot Bolt"), ("q1", "Hot Bolt"), ("q2", "ring")], "query_id string, entity_name string")
    assert sorted(map(tuple, graph.by_entity(mention, parts, names).collect())) == [("q1", "c1", 1.0), ("q1", "c2", 2.0)]


def test_topic_phrases_equal_sql_where_words_begin_with_sharp_s(spark, tmp_path):
    """initcap made two letters of a first ß, which made a word of a phrase and moved what is cut at 500."""
    rows = [(i, "src0", t) for i, t in enumerate(["engeau ßheitte pfung der ßstadt heute", "engeau ßheitte pfung der ßstadt heute", "ß " * 245 + "hamburger hafenstadt", "ß " * 245 + "hamburger hafenstadt", "", None, " über ALLEN gipfeln ist ruh ", "über allen Gipfeln ist ruh"])]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got, want = texts.topic_phrases(spark, str(tmp_path)), duck.execute(texts.ORACLES["topic_phrases"]).df()
    assert want["n"].sum() > 0
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.itertuples(index=False, name=None))
    assert [r[0] for r in spark.createDataFrame([("ßein ŉa ﬁn aİB ÉCOLE",), ("",), (None,)], "t string").select(text.titled(F.col("t"))).collect()] == ["ẞein ŉa ﬁn Aib École", "", None]


def test_topics_of_a_title_are_counted_without_their_edges(spark):
    """counts of blocks add up to those of the edges, however titles and topics are dealt."""
    words = ["alpha", "alphabet", "beta", "gamma", "delta", "été"]
    rows = [(i, f"d{i % 2}" if i % 31 else None, " ".join(words[(i * k) % 6] for k in (1, 2, 5)).title() if i % 7 else "") for i in range(60)]
    sections = spark.createDataFrame(rows, "section_id long, document_id string, title string")
    topics = entities.topics_of_titles(sections, "document_id").select("document_id", "normalized_name", "keywords")
    topics = topics.union(spark.createDataFrame([("d0", "any", [""]), ("d1", "none", []), ("d3", "x", ["alpha"])], topics.schema))
    chunks = sections.select((F.col("section_id") + 100).alias("chunk_id"), "section_id")
    want = sorted(map(tuple, entities.topic_links(sections, topics, chunks).groupBy("src").agg(F.count("*")).collect()))
    for held in (2, 1000):
        assert sorted(map(tuple, entities.topic_counts(sections, topics, chunks, titles_held=held, topics_held=held).select("src", "topics").collect())) == want
    assert len(want) > 40


def test_lists_of_blocks_are_those_of_their_documents(spark):
    """F8: lists are made where blocks are read, over borders of batches, of any text and kind of id."""
    docs = [(f"d{i:03}", None if i % 50 == 9 else " ".join(["Été", "the", f"w{i % 7}", "x_1", "été"][: i % 6])) for i in range(300)]
    counts = segments.term_counts(spark.createDataFrame([*docs, ("d000", "zz zz a"), (None, "no id")], "doc_id string, text string").repartition(3))
    want = {k: Counter(re.findall(r"\w+", (t or "").lower())) for k, t in [*docs, ("d000", "zz zz a")]}
    assert {r["id"]: ([(t["term"], t["tf"]) for t in r["terms"]], r["dl"]) for r in counts.collect()} == {k: (sorted(c.items()), sum(c.values())) for k, c in want.items()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        placed = counts.coalesce(1).sortWithinPartitions("dl", "id").withColumn("block", F.floor(F.monotonically_increasing_id() / 16))
        block = {r["id"]: r["block"] for r in placed.collect()}
        lists = segments.block_lists(placed).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len({(r["term"], r["block"]) for r in lists}) == len(lists)  # no list is cut
    held = {}
    for k, c in want.items():
        for term, tf in c.items():
            held.setdefault((term, block[k]), []).append((k, tf, sum(c.values())))
    assert {(r["term"], r["block"]): list(zip(r["ids"], r["tfs"], r["dls"])) for r in lists} == {key: sorted(rows) for key, rows in held.items()}


def test_a_worker_holds_chunks_of_few_texts(spark):
    """chunks of a whole Arrow batch were held at once."""
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(150))})
    parts = list(chunking.sliced([batch, batch.slice(0, 0)]))
    assert [len(p) for p in parts] == [64, 64, 22] and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    docs = spark.createDataFrame([(i, f"w{i} " * 900) for i in range(150)], "doc_id long, text string").coalesce(1)
    got = {}
    for r in chunking.chunk(docs).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk_text"])
    assert got == {i: [c["chunk_text"] for c in chunking.chunks_of(chunking.plain(f"w{i} " * 900))] for i in range(150)}


def test_a_worker_reads_few_files_at_a_time(spark, monkeypatch):
    """files and texts of a whole batch were held at once."""
    rows = spark.createDataFrame([(i,) for i in range(150)], "i long").select(F.concat("i", F.lit(".pdf")).alias("path"), F.lit(pages.pdf_file([pages._page("x", [], False)])).alias("content")).coalesce(1)
    made = []
    mapped = DataFrame.mapInPandas
    monkeypatch.setattr(DataFrame, "mapInPandas", lambda self, run, schema: made.append(run) or mapped(self, run, schema))
    assert files.extract(rows).where("page_count = 1").count() == 150
    frame = rows.select("path", F.lit("pdf").alias("file_type"), "content").toPandas()
    assert [len(f) for f in made[0](iter([frame]))] == [64, 64, 22]
