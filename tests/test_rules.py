"""Hand-computed cases of single rules."""

from __future__ import annotations

import io
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.functions import images, tables, text
from sievework.operators import bm25, chunking, context, entities, fusion, graph, lifecycle, sections
from sievework.sources import files, plugins, stores
from sievework.streaming import telemetry


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id string, source string, rank int, chunk_id string, score double")


def scores(df):
    return {r["chunk_id"]: round(r["score"], 6) for r in df.collect()}


def test_lone_hit_normalises_to_zero(spark):
    assert scores(fusion.fuse(hits(spark, [("q", "sparse", 1, "a", 7.3)]))) == {"a": 0.0}


def test_two_sources(spark):
    rows = [("q", "sparse", 1, "a", 4.0), ("q", "sparse", 2, "b", 2.0), ("q", "dense", 1, "b", 0.9), ("q", "dense", 2, "c", 0.5)]
    assert scores(fusion.fuse(hits(spark, rows))) == {"a": 0.25, "b": 0.25, "c": 0.0}
    assert scores(fusion.fuse(hits(spark, rows), normalized=False)) == {"a": 4.0, "b": 1.45, "c": 0.5}
    assert [r["chunk_id"] for r in fusion.fuse(hits(spark, rows)).orderBy("final_rank").collect()] == ["a", "b", "c"]  # ties: the sparse list first


def test_chunk_type_of_merged_hits(spark):
    rows = hits(spark, [("q", s, 1, "a", 1.0) for s in ("sparse", "table", "image")] + [("q", "table", 2, "b", 1.0), ("q", "graph", 1, None, 1.0)]).withColumn("chunk_type", F.lit("text"))
    assert {r["chunk_id"]: r["chunk_type"] for r in fusion.merge(rows).collect()} == {"a": "image", "b": "table"}


def model(rows, normalized):
    """Merge, normalise and combine in plain Python."""
    best = {}
    for _, s, _, c, x in rows:
        best.setdefault(c, {})[s] = max(x, best.get(c, {}).get(s, x))
    out = {}
    for c, have in best.items():
        top = under = 0.0
        for s, w in fusion.WEIGHTS.items():
            if normalized:
                every = [h[s] for h in best.values() if s in h]
                low, high = (min(every), max(every)) if every else (0, 1)
                top += w * ((have[s] - low) / ((high - low) or 1.0) if s in have else 0)
                under += w
            elif s in have:
                top += w * have[s]
                under += w
        out[c] = top / under if under else 0.0
    return out


@pytest.mark.parametrize("seed", range(4))
def test_fusion_equals_model_in_any_order(spark, seed):
    rng = random.Random(seed)
    rows = [("q", rng.choice(fusion.SOURCES), i, f"c{rng.randrange(12)}", round(rng.random() * 5, 3)) for i in range(40)]
    for normalized in (True, False):
        want = model(rows, normalized)
        for some in (rows, rng.sample(rows, len(rows))):
            got = scores(fusion.fuse(hits(spark, some), 100, normalized=normalized))
            assert got == pytest.approx(want, abs=1e-5)


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([("q", "A a zz")], "query_id string, query string")
    import math

    idf, tf, avg = math.log(1 + (3 - 1 + 0.5) / 1.5), 2, 5 / 3
    want = 2 * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * 3 / avg))
    for got in (bm25.search_texts(docs, q), bm25.search(bm25.build(docs), q)):
        assert [(r["id"], round(r["score"], 9)) for r in got.collect()] == [(1, round(want, 9))]


def test_filters(spark):
    df = spark.createDataFrame([("a", {"x": "1"}), ("b", {})], "k string, metadata map<string,string>")
    assert bm25.exact_filter(df, {"metadata.x": "1"}).count() == 1
    assert bm25.exact_filter(df, {"nope": "1"}).count() == 0
    assert bm25.exact_filter(df, {"nope": "1"}, strict=False).count() == 2


@pytest.mark.parametrize(("value", "want"), [("", 1), ("abc", 1), ("x" * 9, 2)])
def test_token_estimate(spark, value, want):
    assert one(spark, text.token_estimate(F.lit(value))) == (want,)


def test_keywords(spark):
    assert one(spark, text.keywords(F.lit("What is the Data-Lake of X2, and me?"))) == (["data-lake"],)


def test_tables(spark):
    h, r = F.array(F.lit("A"), F.lit("B")), F.array(F.array(F.lit("1"), F.lit("")), F.array(F.lit("2"), F.lit("3")))
    assert one(spark, tables.flat_text(h, r), tables.markdown(h, r)) == ("A: 1\nA: 2, B: 3", "| A | B |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |")
    assert one(spark, tables.is_valid(F.array(h, h))) == (False,)
    assert one(spark, tables.is_valid(F.array(h, h, h))) == (True,)


@pytest.mark.parametrize(("w", "h", "want"), [(1000, 400, "diagram"), (600, 600, "chart"), (400, 400, "screenshot"), (2500, 1500, "photo"), (300, 200, "screenshot"), (5, 0, "unknown")])
def test_image_type(spark, w, h, want):
    assert one(spark, images.image_type(F.lit(w), F.lit(h))) == (want,)


def test_sections(spark):
    for texts, want in ((["body", "1 Alpha", "body", "2 Beta"], [0, 1, 1, 2]), (["1 Alpha", "x"], [0, 0])):
        df = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "d string, i int, t string")
        got = sections.titled(df, sections.heading(F.col("t")), "d", "i").orderBy("i").collect()
        assert [r["section_index"] for r in got] == want
    assert got[0]["section_title"] == "1 Alpha"


def test_importance_and_cooccurrence(spark):
    chunks = spark.createDataFrame([("d", str(n), "foo " * n) for n in (1, 3, 9)], "document_id string, chunk_id string, chunk_text string")
    names = spark.createDataFrame([("d", "foo")], "document_id string, normalized_name string")
    got = {r["frequency"]: round(r["importance"], 6) for r in entities.mentions(chunks, names).collect()}
    assert got == {1: 0.6, 3: 0.8, 9: 0.9}
    m = spark.createDataFrame([(str(i), e) for i in range(5) for e in ("a", "b")] + [("0", "c")], "src string, dst string")
    got = {(r["src"], r["dst"]): r["confidence"] for r in entities.related(m).collect()}
    assert got["a", "b"] == got["b", "a"] == 1.0
    assert got["a", "c"] == pytest.approx(1 / 3)


def test_metric_entities(spark):
    df = spark.createDataFrame([("1", "5% of 7 million people saw Big Blue Sky")], "chunk_id string, chunk_text string")
    assert sorted((r["entity_name"], r["entity_type"]) for r in entities.by_pattern(df).collect()) == [("7 million", "PERCENT"), ("Big Blue Sky", "CONCEPT")]


@pytest.mark.parametrize(("hops", "want"), [(1, 0.7), (2, 0.6), (3, 0.6)])
def test_hop_score(spark, hops, want):
    assert round(one(spark, graph.hop_score(F.lit(hops)))[0], 9) == want


def test_content_score(spark):
    chunks = spark.createDataFrame([("c", "Foo bar foo")], "chunk_id string, content string")
    q = spark.createDataFrame([("q", ["foo", "BAR"])], "query_id string, keywords array<string>")
    assert round(graph.by_content(chunks, q).first()["graph_score"], 9) == 1.15


def test_context_budget(spark):
    parts = spark.createDataFrame([("q", i, "x" * n) for i, n in enumerate((5000, 4000, 100))] + [("r", 0, "x" * 9000)], "query_id string, rank int, part string")
    got = context.within_budget(parts).groupBy("query_id").count()
    assert {r["query_id"]: r["count"] for r in got.collect()} == {"q": 1, "r": 1}


def test_citation_fallback(spark):
    h = spark.createDataFrame([("q", "c1", "A.txt", 0), ("q", "c2", "b.txt", 1)], "query_id string, chunk_id string, filename string, chunk_index int")
    cited = spark.createDataFrame([("q", "see [document: a.TXT, chunk: 0]")], "query_id string, answer string")
    none = spark.createDataFrame([("q", "nothing")], "query_id string, answer string")
    assert [r["chunk_id"] for r in context.sources(cited, h).collect()] == ["c1"]
    assert context.sources(none, h).count() == 2


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n!?;,é", max_size=400), st.integers(20, 60))
def test_chunks_cover_text(value, size):
    parts = chunking.split(value, size, size // 4) if value else []
    assert all(len(p) <= size for p in parts)
    at = 0
    for p in parts:  # each chunk begins inside or right after what the ones before covered
        found = value.find(p, max(0, at - size))
        assert 0 <= found <= at
        at = max(at, found + len(p))
    assert at == len(value)


def splitter(text, size, overlap, separators=chunking.SEPARATORS):
    """The rules of the splitter by places in the text: the strongest separator that occurs cuts, parts that are too long
    are cut by weaker ones, the others are gathered, and what the overlap leaves of a chunk begins the next."""
    out, waiting = [], []

    def gather():
        first = 0
        for i in range(len(waiting) + 1):
            if i == len(waiting) or waiting[i][1] - waiting[first][0] > size and i > first:
                if i > first:
                    out.append((waiting[first][0], waiting[i - 1][1]))
                while i < len(waiting) and first < i and (waiting[i - 1][1] - waiting[first][0] > overlap or waiting[i][1] - waiting[first][0] > size):
                    first += 1
        waiting.clear()

    def cut(a, b, weight):
        nonlocal waiting
        level = next(i for i in range(weight, len(separators)) if separators[i] in text[a:b])
        mark = separators[level]
        places, at = [a], text.find(mark, a, b) if mark else a + 1
        while a <= at < b:
            if at > a:
                places.append(at)
            at = text.find(mark, at + len(mark), b) if mark else at + 1
        outer, waiting = waiting, []
        for x, y in zip(places, [*places[1:], b]):
            if y - x < size:
                waiting.append((x, y))
            else:
                gather()
                cut(x, y, level + 1)
        gather()
        waiting = outer

    cut(0, len(text), 0)
    return [c for x, y in out if (c := text[x:y].strip())]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n!?;,é", max_size=400), st.integers(20, 60), st.integers(0, 15))
def test_chunks_equal_the_splitter(value, size, overlap):
    text = chunking.plain(value)
    got = chunking.chunks_of(text, size, overlap)
    assert [c["chunk_text"] for c in got] == (splitter(text, size, overlap) if text else [])
    assert [c["chunk_index"] for c in got] == list(range(len(got)))
    assert all(c["token_count"] == max(1, len(c["chunk_text"]) // 4) for c in got)


def test_chunking_of_blank_and_null(spark):
    df = spark.createDataFrame([(1, None), (2, "  \n "), (3, "x y")], "doc_id long, text string")
    assert [(r["doc_id"], r["chunk_text"]) for r in chunking.chunk(df).collect()] == [(3, "x y")]


def test_round_robin(spark):
    df = spark.createDataFrame([("q", d, f"{d}{i}", 10 - i) for d in "ab" for i in range(3)], "query_id string, document_id string, chunk_id string, s int")
    got = graph.round_robin(df, 4, "document_id", F.desc("s"), "chunk_id").orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["a0", "b0", "a1", "b1"]


def small_graph(spark):
    g = graph.empty(spark)
    doc = spark.createDataFrame([("d1", "x"), ("d2", "y")], "document_id string, title string")
    g.nodes |= {
        "Document": doc,
        "Section": spark.createDataFrame([("s1", "d1", "Alpha", 0), ("s2", "d2", "Beta", 0)], "section_id string, document_id string, title string, section_index int"),
        "Chunk": spark.createDataFrame([("c1", "d1", "foo", 0), ("c2", "d2", "foo bar", 0)], "chunk_id string, document_id string, content string, chunk_index int"),
        "Entity": spark.createDataFrame([("foo", "foo"), ("bar", "bar"), ("only", "only")], "normalized_name string, entity_name string"),
        "Media": spark.createDataFrame([("m1",), ("m2",)], "media_id string"),
        "Topic": spark.createDataFrame([("alpha", "Alpha", ["alpha"])], "normalized_name string, topic_name string, keywords array<string>"),
    }
    e = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    g.edges |= {"HAS_SECTION": e([("d1", "s1"), ("d2", "s2")]), "HAS_CHUNK": e([("s1", "c1"), ("s2", "c2")]), "MENTIONS": e([("c1", "foo"), ("c2", "foo"), ("c1", "only"), ("c2", "bar")]), "RELATED_TO": e([("foo", "only"), ("foo", "bar")]), "HAS_MEDIA": e([("c1", "m1"), ("c2", "m2")]), "HAS_TOPIC": spark.createDataFrame([("c1", "alpha", 0.8)], "src string, dst string, relevance double")}
    return g


def test_delete_from_graph(spark):
    g = lifecycle.delete_from_graph(small_graph(spark), spark.createDataFrame([("d1",)], "document_id string"))
    names = lambda label, c: sorted(r[c] for r in g.nodes[label].collect())
    assert names("Entity", "normalized_name") == ["bar", "foo"]
    assert names("Media", "media_id") == ["m2"]
    assert names("Topic", "normalized_name") == []
    assert names("Chunk", "chunk_id") == ["c2"]
    assert [(r["src"], r["dst"]) for r in g.edges["RELATED_TO"].collect()] == [("foo", "bar")]
    assert {r["name"]: r["n"] for r in graph.census(g).collect()}["Document"] == 1


def test_cascade(spark):
    g = small_graph(spark)
    q = spark.createDataFrame([("q", ["alpha", "foo"])], "query_id string, keywords array<string>")
    got = graph.cascade(g.chunks_in_order(), g, q, 5).orderBy("rank").collect()
    assert [(r["chunk_id"], r["retrieval_method"]) for r in got] == [("c1", "section_title_match"), ("c2", "entity_mention")]


def test_graph_retrieval(spark):
    g = small_graph(spark)
    q = spark.createDataFrame([("q", ["alpha"])], "query_id string, keywords array<string>")
    got = graph.retrieve(g.chunks_in_order(), g, q, 4).orderBy("rank").collect()
    assert [(r["chunk_id"], r["retrieval_method"], r["score"]) for r in got] == [("c1", "section_title_match", 0.9), ("c2", "graph_traversal", 0.8)]


def test_verify(spark):
    t = spark.createDataFrame([(1, "a")], "id long, name string")
    assert lifecycle.verify({"t": t}, {"t": "id long, name string", "u": "x int"}) == ["u: no table"]
    assert lifecycle.verify({"t": t}, {"t": "id string, more int"}) == ["t.id: bigint, not string", "t.more: missing, not int"]


def test_pictures_and_status(spark, tmp_path):
    import struct

    from sievework.sources import rich

    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 1000, 400)
    data = io.BytesIO(docx(["One"], [["h", "k"], ["1", "2"], ["3", "4"]]))
    with zipfile.ZipFile(data, "a") as z:
        z.writestr("word/media/image1.png", png)
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no")
    found = files.scan(spark, str(tmp_path))
    assert [(r["image_index"], r["width"], r["image_type"]) for r in rich.images(found).collect()] == [(1, 1000, "diagram")]
    assert {r["path"][-6:]: (r["status"], r["n_tables"], r["n_images"]) for r in rich.extract_all(found).collect()} == {"a.docx": ("ok", 1, 1), "b.docx": ("failed", 0, 0)}


def test_upserts(spark):
    old = spark.createDataFrame([("a", "1", "x")], "normalized_name string, entity_id string, entity_name string")
    new = spark.createDataFrame([("a", "2", "y"), ("b", "3", "z")], old.schema)
    got = {r[0]: (r[1], r[2]) for r in graph.upsert_nodes(old, new, "normalized_name", keep=("entity_id",)).collect()}
    assert got == {"a": ("1", "y"), "b": ("3", "z")}
    v = spark.createDataFrame([("c", [1.0, 2.0])], "chunk_id string, vector array<double>")
    assert lifecycle.checked_vectors(v, 2).count() == 1
    with pytest.raises(Exception, match="dimensions"):
        lifecycle.checked_vectors(v, 3).collect()


def docx(paragraphs, rows):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(map(p, paragraphs))}{table}</w:body></w:document>")
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\r\n\r\n\r\n\r\nx".encode())
    (tmp_path / "b.md").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "c.docx").write_bytes(docx(["One", " "], [["a", "b"], ["1", "2"]]))
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / "e.zip").write_bytes(b"x")
    got = {r["path"][-5]: r for r in files.extract(files.scan(spark, str(tmp_path))).collect()}
    got = {r["path"].rsplit("/", 1)[1]: r for r in got.values()} if len(got) == 5 else {r["path"].rsplit("/", 1)[1]: r for r in files.extract(files.scan(spark, str(tmp_path))).collect()}
    assert got["a.txt"]["text"] == "é\n\nx"
    assert got["b.md"]["text"] == "café"
    assert got["c.docx"]["text"] == "One\n\na | b\n1 | 2".replace("\n1", "\n\n1")
    assert got["c.docx"]["tables"] == [[["a", "b"], ["1", "2"]]]
    assert got["d.docx"]["error"].startswith("BadZipFile")
    assert got["e.zip"]["error"] == "unsupported file type"


def test_object_keys(spark):
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    key = files.object_key(F.lit("web"), F.lit("pdf"), F.lit("a.b.pdf"), at)
    assert one(spark, key) == ("raw_documents/web/pdf/a.b_20240102_030405.pdf",)
    assert one(spark, *files.object_parts(F.lit("raw/x/pdf/n.pdf"))) == ("x", "pdf", "n.pdf")
    assert one(spark, *files.object_parts(F.lit("n.pdf"))) == ("unknown", "unknown", "n.pdf")


def test_embedding_plugin(spark):
    class Counting:
        dimension = 2

        def embed(self, texts):
            return [[len(t), 0.0] for t in texts]

    df = spark.createDataFrame([("a", "hello"), ("b", " "), ("c", None)], "chunk_id string, chunk_text string")
    got = {r["chunk_id"]: r["vector"] for r in plugins.embed(df, Counting, prefix="passage: ").collect()}
    assert got == {"a": [1.0, 0.0], "b": [0.0, 0.0], "c": [0.0, 0.0]}


def test_answer_plugin(spark):
    from sievework.operators.context import NO_CONTEXT

    class Echo:
        def answer(self, questions, contexts):
            return [f"{q}: {c}" for q, c in zip(questions, contexts)]

    q = spark.createDataFrame([("a", "why"), ("b", "who")], "query_id string, query string")
    c = spark.createDataFrame([("a", "so")], "query_id string, context string")
    assert {r["query_id"]: r["answer"] for r in plugins.answers(q, c, Echo).collect()} == {"a": "why: so", "b": NO_CONTEXT}


def test_captions_and_entities(spark):
    class Eye:
        def describe(self, images):
            return [None if i is None else f"{len(i)} bytes" for i in images]

    class Names:
        def extract(self, texts):
            return [[("Ann", "PERSON"), ("5", "MONEY")] if t else [] for t in texts]

    df = spark.createDataFrame([("x", bytearray(b"abc"), "t"), ("y", None, None)], "chunk_id string, content binary, chunk_text string")
    assert {r["chunk_id"]: r["caption"] for r in plugins.captions(df, Eye).collect()} == {"x": "3 bytes", "y": None}
    assert {(r["entity_name"], r["entity_value"]) for r in plugins.entities(df, Names).collect()} == {("Ann", None), ("5", "5")}


def test_overwrite_of_what_is_read(spark, tmp_path):
    path = str(tmp_path / "t")
    stores.append(spark.range(5), path)
    stores.overwrite(spark.read.parquet(path).where("id > 2"), path)
    assert spark.read.parquet(path).count() == 2


def test_stream_closes_windows(spark, tmp_path):
    schema = "ts timestamp, event_type string"
    rows = [(f"2024-01-01 00:{m:02d}:00", "a") for m in (1, 2, 7, 40)]
    spark.createDataFrame(rows, "t string, event_type string").selectExpr("cast(t as timestamp) ts", "event_type").coalesce(1).write.parquet(str(tmp_path / "in"))
    from pyspark.sql.types import _parse_datatype_string

    events = telemetry.stream(spark, str(tmp_path / "in"), _parse_datatype_string(schema))
    out = telemetry.over_time(events, "5 minutes", F.count("*").alias("n"))
    q = telemetry.to_table(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = sorted((r["window_start"].minute, r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, 2), (5, 1)]  # the last window is still open


def test_engine_end_to_end(spark, tmp_path):
    from sievework.api import Engine

    docs = spark.createDataFrame([("d1", "a.txt", "txt", "web/a", "1 Alpha Topic\nBig Blue Sky is here. Big Blue Sky."), ("d2", "b.txt", "txt", "web/b", "Some other text of Big Blue Sky and Red Old Barn.")], "document_id string, filename string, document_type string, source_path string, text string")
    e = Engine(docs).ingest().save(str(tmp_path / "store"))
    q = spark.createDataFrame([("q", "blue sky"), ("blank", "  ")], "query_id string, query string")
    got = e.query(q, 5).collect()
    assert {r["query_id"] for r in got} == {"q"}
    assert {r["document_id"] for r in got} == {"d1", "d2"}
    assert {r["document_id"] for r in e.query(q, 5, {"filename": "b.txt"}).collect()} == {"d2"}
    left = e.delete_documents(spark.createDataFrame([("d1",)], "document_id string"))
    assert {r["document_id"] for r in left.query(q, 5).collect()} == {"d2"}
    with pytest.raises(ValueError, match="retriever"):
        e.query(q, sparse=False, dense_text=False, dense_table=False, dense_image=False, by_graph=False)
