"""Queries over stored rows, files, models and the engine as one object."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework import schemas
from sievework.api import Engine
from sievework.functions import tables, text, vectors
from sievework.operators import bm25, chunking, context, dense, graph, lifecycle, sections
from sievework.operators.segments import Segments
from sievework.plans.common import questions, read
from sievework.plans.retrieval import BM25_SQL, vectors_asked
from sievework.session import shared_folder
from sievework.sources import files, plugins, rich, stores


# ---- retrieval ----------------------------------------------------------------------------------------------------


def _collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("text_chunks"), F.lit("table_chunks"), F.lit("image_chunks")), (F.col("label") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "embeddings").withColumn("collection", kind)


def table_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bm25.exact_filter(_collections(spark, sf_dir), {"collection": "table_chunks"})
    return dense.search(rows, vectors_asked(spark, sf_dir), 10).select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def image_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text queries of half the dimension, padded to the space of images."""
    asked = vectors_asked(spark, sf_dir).select("query_id", vectors.padded(F.transform(F.slice("vector", 1, 32), lambda x: x.cast("double")), 64).alias("vector"))
    rows = bm25.exact_filter(_collections(spark, sf_dir), {"collection": "image_chunks"})
    return dense.search(rows, asked, 10).select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    """Documents of one chunk each."""
    d = read(spark, sf_dir, "documents")
    docs = d.select(F.col("doc_id").alias("document_id"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("filename"), F.col("lang").alias("document_type"), F.concat_ws("/", F.lit("raw"), "source", "lang", F.col("doc_id").cast("string")).alias("source_path"), "text")
    chunks = d.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("chunk_text"), F.lit("text").alias("chunk_type"), F.lit("").alias("section_title"), F.lit(0).alias("section_index"))
    return Engine(docs, chunks)


def _hits(found: DataFrame) -> DataFrame:
    return found.select("query_id", "final_rank", "chunk_id", F.round("score", 6).alias("score"))


def query_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(_engine(spark, sf_dir).query_type(questions(spark), "de", 10))


def query_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question against one document: a lone hit normalises to zero."""
    return _hits(_engine(spark, sf_dir).query_document(questions(spark), "7", 10))


def engine_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions over text, table and image vectors beside BM25; vector i belongs to document i, its collection to its
    label."""
    e = _engine(spark, sf_dir)
    vectors_ = _collections(spark, sf_dir).select("collection", F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("document_id"), F.col("embedding").alias("vector"))
    return _hits(Engine(e.documents, e.chunks, vectors_).query(questions(spark).join(vectors_asked(spark, sf_dir), "query_id"), 10))


def engine_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An engine that has just ingested texts, tables and pictures answers from all five sources."""
    asked = questions(spark).union(spark.createDataFrame([("q5", "Turn Role bars chart")], "query_id string, query string")).withColumn("vector", F.array(*(F.lit(x) for x in (0.5, 0.4, 0.3, 0.2))))
    return _small(spark, sf_dir).query(asked, 10).select("query_id", "final_rank", "chunk_id", "chunk_type", F.round("score", 6).alias("score"))


def engine_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each question with a filter, with one on a field that is not there, strictly and not, and of a blank one."""
    e = _engine(spark, sf_dir)
    asked = questions(spark).union(spark.createDataFrame([("blank", "  ")], "query_id string, query string"))
    runs = {"type": e.query(asked, 10, {"document_type": "fr"}), "strict": e.query(asked, 10, {"colour": "red"}), "lenient": e.query(asked, 10, {"colour": "red"}, strict=False)}
    parts = [r.groupBy("query_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("run"), "query_id", "n") for name, r in runs.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def bm25_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index of the languages, with half the documents replaced by their texts and one source deleted."""
    d = read(spark, sf_dir, "documents")
    index = Segments(spark, shared_folder(spark)).upsert(d.select("doc_id", F.col("lang").alias("text"))).upsert(d.where("doc_id % 2 = 0"))
    return index.delete(d.where("source = 'src1'").select(F.col("doc_id").alias("id"))).statistics()


# ---- rows ---------------------------------------------------------------------------------------------------------


def _rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks tables: orders are documents, their lines chunks."""
    docs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("filename"), F.col("o_orderstatus").alias("document_type"), F.concat(F.lit("p/"), F.col("o_orderkey").cast("string")).alias("source_path"))
    chunks = read(spark, sf_dir, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_orderkey").cast("string").alias("document_id"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("chunk_text"), F.col("l_linenumber").cast("int").alias("chunk_index"))
    return docs, chunks


def chunk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with what their chunk and document say; some have no text, some no chunk."""
    docs, chunks = _rows(spark, sf_dir)
    hits = chunks.select(F.col("id").alias("chunk_id"), F.when(F.col("chunk_index") % 2 == 0, "own").otherwise("").alias("chunk_text")).union(spark.createDataFrame([("none", "")], "chunk_id string, chunk_text string"))
    return stores.with_document(hits, chunks, docs.where("document_type <> 'P'")).select("chunk_id", "chunk_text", "document_id", "filename", "document_type")


def document_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = _rows(spark, sf_dir)
    return stores.document(docs, id="7").unionByName(stores.document(docs, source_path="p/33")).unionByName(stores.document(docs, id="none"))


def chunks_of_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, chunks = _rows(spark, sf_dir)
    return stores.chunks_of(chunks, "7").withColumn("part", F.lit("all")).unionByName(stores.chunks_of(chunks, "32", 2).withColumn("part", F.lit("first")))


def stored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all tables appended in two batches and read again."""
    docs, chunks = _rows(spark, sf_dir)
    path = shared_folder(spark)
    data = F.struct(F.array(F.lit("a")).alias("headers"), F.array(F.array("chunk_text")).alias("rows"))
    parts = {
        "documents": docs.select("id", F.col("id").alias("document_id"), "filename"),
        "chunks": chunks.select("id", "document_id", "chunk_text"),
        "tables": chunks.where("chunk_index = 1").select("id", "document_id", data.alias("table_data"), tables.markdown(data["headers"], data["rows"]).alias("table_markdown")),
        "images": chunks.where("chunk_index = 2").select("id", "document_id", F.concat(F.lit("img/"), "id").alias("image_path")),
    }
    out = []
    for name, rows in parts.items():
        for odd in (0, 1):
            stores.append(rows.where(F.pmod(F.col("document_id").cast("long"), F.lit(2)) == odd), f"{path}/{name}")
        back = spark.read.parquet(f"{path}/{name}")
        out.append(back.agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("documents"), F.min("id").alias("first")).select(F.lit(name).alias("name"), "n", "documents", "first"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk rows with ids of what they are about, offsets and tokens in their metadata."""
    rows = read(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("document_id"), "text")
    out = stores.chunk_rows(chunking.chunk(rows, "document_id", "text"))
    return out.select("id", "document_id", "chunk_index", "chunk_type", F.col("metadata")["end_char_index"].alias("end_char_index"), F.col("metadata")["token_count"].alias("token_count"), F.md5("chunk_text").alias("text_md5"))


def upload_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw files by key, stored and read again by their source; keys of pictures."""
    o = read(spark, sf_dir, "orders")
    name = F.concat(F.lit("order."), F.col("o_orderkey").cast("string"), F.lit(".pdf"))
    rows = o.select(F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("document_type"), files.object_key(F.col("o_orderpriority"), F.col("o_orderstatus"), name, F.col("o_orderdate")).alias("key"), F.col("o_orderpriority").cast("binary").alias("content"), files.image_key(F.col("o_orderkey").cast("string"), F.lit(3), F.col("o_orderdate"), F.col("o_orderstatus").cast("binary"), F.lit("png")).alias("image"))
    path = shared_folder(spark)
    files.store_raw(rows, path)
    back = spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("stored"))
    return rows.join(back, "source").select("key", "image", "stored")


def vector_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the right size without those of some labels, by label."""
    rows = lifecycle.checked_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector")), 64)
    gone = rows.where("label IN (1, 4)").select("vec_id")
    return lifecycle.delete_by_keys(rows, gone, "vec_id").groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("size"))


def blob_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that deleted orders leave behind."""
    docs, chunks = _rows(spark, sf_dir)
    images = chunks.select("document_id", F.when(F.col("chunk_index") < 3, F.concat(F.lit("img/"), "document_id", F.lit("/"), (F.col("chunk_index") % 2).cast("string"))).alias("image_path"))
    gone = docs.where("document_type = 'F'").select(F.col("id").alias("document_id"))
    return lifecycle.blobs_of(gone, (docs.withColumnRenamed("id", "document_id"), "source_path"), (images, "image_path"))


def schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and vectors stored with their schemas, what another set lacks, and rows of each before and after a rebuild."""
    folder = shared_folder(spark)
    none = lambda *columns: [F.lit(None).cast(kind).alias(name) for name, kind in columns]
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), *none(("created_at", "timestamp"), ("updated_at", "timestamp")), F.col("source").alias("source_path"), F.concat("lang", F.lit(".txt")).alias("filename"), F.lit("txt").alias("document_type"), F.col("text").alias("extracted_text"), *none(("metadata", schemas.METADATA)))
    near = read(spark, sf_dir, "embeddings").select(F.lit("text_chunks").alias("collection"), F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("string").alias("document_id"), F.col("embedding").cast("array<float>").alias("vector"), *none(("payload", schemas.METADATA)))
    stored = {"documents": docs, "vectors": near}
    for name, rows in stored.items():
        rows.write.parquet(f"{folder}/{name}")
    stored = {name: spark.read.parquet(f"{folder}/{name}") for name in stored}
    asked = {"documents": schemas.DOCUMENTS.replace("filename string", "filename int"), "vectors": schemas.VECTORS, "chunks": schemas.CHUNKS}
    assert not lifecycle.verify(stored, {"documents": schemas.DOCUMENTS, "vectors": schemas.VECTORS})
    wrong = spark.createDataFrame([(x, None) for x in lifecycle.verify(stored, asked)], "name string, rows long")
    counted = lambda tables, when: [t.agg(F.count("*").alias("rows")).select(F.lit(f"{n} {when}").alias("name"), "rows") for n, t in tables.items()]
    made = lifecycle.rebuild(spark, {"documents": schemas.DOCUMENTS, "vectors": schemas.VECTORS}, shared_folder(spark))
    for part in counted(stored, "before") + counted(made, "after"):
        wrong = wrong.unionByName(part)
    return wrong


# ---- texts, tables and files --------------------------------------------------------------------------------------


def chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.col("text").alias("chunk_text"), text.token_estimate(F.col("text")).alias("token_count"))
    return chunking.chunk_stats(rows)


def chunk_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunker as a table function of SQL: documents that are one chunk."""
    chunking.register(spark)
    read(spark, sf_dir, "documents").createOrReplaceTempView("_chunked")
    every = spark.sql("SELECT doc_id, count(*) AS n, max(chunk_text) AS t, max(token_count) AS tokens FROM _chunked, LATERAL text_chunks(text) GROUP BY doc_id")
    return every.where((F.col("n") == 1) & (F.length("t") < chunking.SIZE)).select("doc_id", F.md5("t").alias("chunk_md5"), "tokens")


def _region_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    return n.select("n_regionkey", F.concat(F.array(F.array(F.lit("Key"), F.lit("Name"))), F.transform("r", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))).alias("data"))


def table_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as JSON, and the facts that are kept beside them."""
    t = _region_tables(spark, sf_dir).withColumn("t", tables.split_header(F.col("data")))
    f = tables.facts(F.col("t.headers"), F.col("t.rows"), F.lit("lattice"), F.lit(0.9), F.lit(3))
    return t.withColumn("f", f).select("n_regionkey", tables.as_json(F.col("t")).alias("json"), "f.row_count", "f.col_count", F.array_join("f.headers", ",").alias("headers"), "f.method", "f.accuracy", "f.page")


def chunk_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order: small ones are its text, the next its tables, which go on after it, large ones pictures after both."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") < 20, "text").when(F.col("l_quantity") < 40, "table").otherwise("image").alias("kind"))
    first = rows.where("kind = 'text'").withColumn("chunk_index", F.col("l_linenumber").cast("int"))
    second = stores.continued(rows.where("kind = 'table'"), first, "l_orderkey", "l_linenumber")
    both = first.unionByName(second)
    return both.unionByName(stores.continued(rows.where("kind = 'image'"), both, "l_orderkey", "l_linenumber"))


def metadata_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload entries that are no fields of their own, under what a document says."""
    c = read(spark, sf_dir, "customer")
    payload = F.create_map(F.lit("chunk_id"), F.col("c_custkey").cast("string"), F.lit("segment"), F.lower("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    own = F.create_map(F.lit("nation"), F.lit("x"), F.lit("name"), F.col("c_name"))
    both = text.merged(F.when(F.col("c_custkey") % 2 == 0, own), text.spread(payload, ("chunk_id", "text")))
    return c.select("c_custkey", F.array_join(F.array_sort(F.transform(F.map_entries(both), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ";").alias("metadata"))


def content_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks in the graph hold 50,000 characters at most."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.repeat("text", F.lit(20)).alias("t"))
    inner = F.array(F.struct(F.col("document_id").alias("chunk_id"), F.col("t").alias("content"), F.lit(0).alias("chunk_index"), F.lit("text").alias("chunk_type")))
    nested = d.select("document_id", F.array(F.struct(F.lit("s").alias("section_id"), F.lit("T").alias("title"), F.lit(0).alias("section_index"), inner.alias("chunks"))).alias("sections"))
    return graph.sections_to_rows(nested)[1].select("chunk_id", F.length("content").alias("length"), F.md5("content").alias("content_md5"))


def spaced_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names spelled with blanks between their capitals are headings when they are long enough without them."""
    spelled = F.array_join(F.split(F.upper("n_name"), ""), " ")
    rows = read(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("x\n"), F.regexp_replace(spelled, r"\s+", " ")).alias("t"))
    return rows.select("n_nationkey", sections.heading(F.col("t")).alias("heading"))


def _docx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word-processor file for each region: its name, a table of its nations, and two pictures, the second by name shown
    first; and a broken one."""
    import io
    import struct
    import zipfile

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        for frame in frames:
            out = []
            for key, name, data in frame.itertuples(index=False):
                cell = lambda c: f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>"
                body = f"<w:p><w:r><w:t>{name}</w:t></w:r></w:p><w:tbl>" + "".join(f"<w:tr>{''.join(map(cell, row))}</w:tr>" for row in data) + "</w:tbl>"
                body += "".join(f'<w:p><w:r><a:blip r:embed="p{i}"/></w:r></w:p>' for i in (2, 1))
                kinds = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
                rels = "".join(f'<Relationship Id="p{i}" Type="{kinds}/image" Target="media/image{i}.png"/>' for i in (1, 2))
                packed = io.BytesIO()
                with zipfile.ZipFile(packed, "w") as z:
                    z.writestr("word/document.xml", f'<w:document xmlns:w="{w}" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="{kinds}"><w:body>{body}</w:body></w:document>')
                    z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
                    for i in (1, 2):
                        z.writestr(f"word/media/image{i}.png", b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 300 * i * (key + 1), 600) + b"\0" * 8)
                out.append((f"in/r{key}.docx", packed.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    rows = _region_tables(spark, sf_dir).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_regionkey").cast("long").alias("key"), "r_name", "data")
    broken = spark.createDataFrame([("in/broken.docx", bytearray(b"no zip")), ("in/a.txt", bytearray("caf\xe9\r\n\r\n\r\n\r\nx ".encode("latin-1"))), ("in/b.md", bytearray("# caf\xe9".encode())), ("in/c.gz", bytearray(b"z"))], "path string, content binary")
    return rows.mapInPandas(run, "path string, content binary").unionByName(broken)


def file_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of files of each kind; what cannot be read has an error."""
    return Engine.extract(_docx(spark, sf_dir)).select("path", "file_type", "text", F.col("error").isNotNull().alias("failed"), F.size("tables").alias("n_tables"))


def file_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rich.tables(_docx(spark, sf_dir)).select("path", "table_index", "method", F.size("data").alias("n_rows"), F.element_at(F.element_at("data", 2), 2).alias("first_name"))


def file_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rich.images(_docx(spark, sf_dir)).select("path", "image_index", "extension", "width", "height", "image_type")


def extraction_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rich.extract_all(_docx(spark, sf_dir)).select("path", "n_tables", "n_images", "status")


# ---- models that a caller brings ----------------------------------------------------------------------------------


class Letters:
    """An embedder: how often a, e, i and o occur."""

    dimension = 4

    def embed(self, texts):
        return [[float(t.count(x)) for x in "aeio"] for t in texts]


class LongWords:
    """An extractor of words of ten letters or more."""

    def extract(self, texts):
        import re

        return [[(w, "DATE" if len(w) % 2 else "ORG") for w in re.findall(r"[A-Za-z]{10,}", t)] for t in texts]


class Sizes:
    """A captioner that says the size, a reader of lines and an answerer."""

    def describe(self, images):
        return [f"{len(b)} bytes" if len(b) % 2 else None for b in images]

    def read(self, images):
        return [b.decode().split("\n") + [" "] for b in images]

    def answer(self, questions_, contexts):
        return [f"{q}: {len(c)}" for q, c in zip(questions_, contexts)]


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), F.col("conv_id").alias("query_id"), F.col("turn").cast("int").alias("chunk_index"), "role", F.col("text").alias("chunk_text"))


def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plugins.embed(_turns(spark, sf_dir).select("chunk_id", F.when(F.col("chunk_index") != 1, F.col("chunk_text")).alias("chunk_text")), Letters, prefix="aa ")
    return out.select("chunk_id", *(F.round(F.get("vector", F.lit(i)).cast("double"), 5).alias(x) for i, x in enumerate("aeio")))


def model_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = plugins.distinct_entities(plugins.entities(_turns(spark, sf_dir), LongWords))
    return found.select("chunk_id", "normalized_name", "entity_name", "entity_type", "entity_value", "confidence")


def captioned_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).select("chunk_id", F.col("chunk_text").cast("binary").alias("content"))
    return plugins.recognized(plugins.captions(rows, Sizes), Sizes).select("chunk_id", "caption", F.md5("extracted_text").alias("text_md5"))


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers from contexts of conversations; those without a context get a fixed sentence."""
    t = _turns(spark, sf_dir)
    asked = t.where("chunk_index = 0").select("query_id", F.left("chunk_text", F.lit(10)).alias("query"))
    told = t.where("chunk_index > 0 AND query_id % 3 > 0").groupBy("query_id").agg(F.max("chunk_text").alias("context"))
    return plugins.answers(asked, told, Sizes).select("query_id", "answer")


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).select("query_id", "chunk_id", F.col("query_id").alias("document_id"), F.col("role").alias("filename"), "chunk_index", "chunk_text", F.lit(0.5).alias("score"))
    return context.source_rows(rows)


# ---- the engine ---------------------------------------------------------------------------------------------------


def _small(spark: SparkSession, sf_dir: str) -> Engine:
    """Turns as documents, some with a table and some with two pictures."""
    t = _turns(spark, sf_dir)
    docs = t.select(F.col("chunk_id").alias("document_id"), F.concat("chunk_id", F.lit(".txt")).alias("filename"), F.col("role").alias("document_type"), F.concat_ws("/", F.lit("raw"), F.lit("web"), "role", "chunk_id").alias("source_path"), F.col("chunk_text").alias("text"))
    data = F.array(F.array(F.lit("Turn"), F.lit("Role")), F.array(F.col("chunk_index").cast("string"), "role"), F.array(F.lit("z"), F.lit("z")))
    given = t.where("chunk_index % 2 = 0").select(F.col("chunk_id").alias("document_id"), F.lit(1).alias("table_index"), data.alias("data"))
    pictures = t.where("chunk_index % 3 = 0").select(F.col("chunk_id").alias("document_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("image_index"), F.lit("chart").alias("image_type"), F.lit(None).cast("string").alias("extracted_text"))
    pictures = pictures.withColumns({"image_path": F.concat_ws("/", "document_id", F.col("image_index").cast("string")), "caption": F.when(F.col("image_index") == 2, F.lit("Two bars"))})
    return Engine(docs).ingest(given, pictures, Letters)


def engine_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each kind with their numbers, vectors of each collection, and nodes and edges of documents and media."""
    e = _small(spark, sf_dir)
    chunks = e.chunks.groupBy(F.col("chunk_type").alias("name")).agg(F.count("*").alias("n"), F.sum("chunk_index").alias("total")).withColumn("kind", F.lit("chunk"))
    held = e.vectors.groupBy(F.col("collection").alias("name")).agg(F.count("*").alias("n")).withColumns({"total": F.lit(None).cast("long"), "kind": F.lit("vector")})
    some = graph.census(graph.Graph({n: e.graph.nodes[n] for n in ("Document", "Media")}, {n: e.graph.edges[n] for n in ("HAS_MEDIA", "HAS_CHUNK")})).withColumn("total", F.lit(None).cast("long"))
    return chunks.unionByName(held).unionByName(some)


def engine_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as they are searched and as they are read."""
    return _small(spark, sf_dir).chunks.where("chunk_type = 'table'").select("document_id", "chunk_text", "table_markdown", "chunk_index")


def engine_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir)
    one = e.get_document("raw/src1/en/none").unionByName(e.get_document(f"raw/{_first(spark, sf_dir)}"))
    listed = e.list_documents(source="src1", document_type="en", limit=5).select("key", F.lit("listed").alias("kind"))
    return listed.unionByName(one.select(F.col("source_path").alias("key"), F.lit("found").alias("kind")))


def _first(spark: SparkSession, sf_dir: str) -> str:
    r = read(spark, sf_dir, "documents").orderBy("doc_id").select("source", "lang", "doc_id").first()  # one row
    return f"{r['source']}/{r['lang']}/{r['doc_id']}"


def engine_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left in each store when a language goes."""
    e = _engine(spark, sf_dir)
    e = Engine(e.documents, e.chunks, read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), F.col("embedding").alias("vector")), index=Segments(spark, shared_folder(spark)).upsert(e.chunks, "chunk_id", "chunk_text"))
    left = e.delete_documents(e.documents.where("document_type = 'de'").select("document_id"))
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return count("documents", left.documents).unionByName(count("chunks", left.chunks)).unionByName(count("vectors", left.vectors)).unionByName(count("indexed", left.index.documents()))


QUERIES = {
    f.__name__: f
    for f in (
        table_vectors, image_vectors, query_by_type, query_by_document, engine_sources, engine_query, engine_filters, bm25_upsert, chunk_lookup, document_lookup, chunks_of_document, stored_rows, stored_chunks, upload_keys, vector_delete, blob_paths, schema_check,
        chunk_statistics, chunk_function, table_json, chunk_numbering, metadata_spread, content_cut, spaced_headings, file_texts, file_tables, file_images, extraction_status,
        embedded_chunks, model_entities, captioned_images, model_answers, source_rows, engine_ingest, engine_markdown, engine_listing, engine_delete,
    )
}

_ASKED = "dq AS (SELECT 'q' || CAST(vec_id + 1 AS VARCHAR) AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id < 4)"
_NEAR = "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS vec_id, round(score, 6) AS score FROM dn QUALIFY rank <= 10"
_FUSED = """s AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM bm WHERE id IN (SELECT doc_id FROM documents WHERE {where}) QUALIFY r <= 20),
n AS (SELECT *, round(0.25 * (score - min(score) OVER q) / CASE WHEN max(score) OVER q > min(score) OVER q THEN max(score) OVER q - min(score) OVER q ELSE 1 END, 9) AS f FROM s WINDOW q AS (PARTITION BY query_id)),
z AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY f DESC, r, id) AS INTEGER) AS final_rank, id AS chunk_id, round(f, 6) AS score FROM n QUALIFY final_rank <= 10)"""
_CHUNKS = "k AS (SELECT l_orderkey || '-' || l_linenumber AS id, CAST(l_orderkey AS VARCHAR) AS document_id, 'part ' || l_partkey AS chunk_text, CAST(l_linenumber AS INTEGER) AS chunk_index FROM lineitem)"
_NORMAL = "regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', E'\\n', 'g'), '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
_T = "t AS (SELECT conv_id || '-' || turn AS chunk_id, conv_id AS query_id, CAST(turn AS INTEGER) AS chunk_index, role, text AS chunk_text FROM conversations)"
_LETTER = "CAST(length({t}) - length(replace({t}, '{x}', '')) AS DOUBLE)"


def _letters(t: str) -> str:
    return ", ".join(f"{_LETTER.format(t=t, x=x)} AS {x}" for x in "aeio")


ORACLES = {
    "table_vectors": f"WITH {_ASKED}, dn AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(v, CAST(embedding AS DOUBLE[])), 12) AS score FROM dq, embeddings WHERE label % 3 = 1) {_NEAR}",
    "image_vectors": f"WITH {_ASKED}, dn AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(list_concat(v[1:32], list_transform(range(32), lambda x: CAST(0 AS DOUBLE))), CAST(embedding AS DOUBLE[])), 12) AS score FROM dq, embeddings WHERE label % 3 = 2) {_NEAR}",
    "engine_sources": f"""
WITH {BM25_SQL}, dq AS (SELECT 'q' || CAST(vec_id + 1 AS VARCHAR) AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id < 4),
dn AS (SELECT dq.query_id, e.vec_id AS id, label % 3 + 1 AS p, round(list_cosine_similarity(dq.v, CAST(e.embedding AS DOUBLE[])), 12) AS score FROM dq, embeddings e WHERE e.vec_id IN (SELECT doc_id FROM documents)),
h AS (SELECT query_id, 0 AS p, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM bm QUALIFY r <= 20
  UNION ALL SELECT query_id, p, id, score, row_number() OVER (PARTITION BY query_id, p ORDER BY score DESC, id) AS r FROM dn QUALIFY r <= 20),
n AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS x FROM h WINDOW w AS (PARTITION BY query_id, p)),
m AS (SELECT query_id, id, min(p * 1000 + r) AS place, round(coalesce(max(x) FILTER (p = 0), 0) * 0.25 + coalesce(max(x) FILTER (p = 1), 0) * 0.25 + coalesce(max(x) FILTER (p = 2), 0) * 0.15 + coalesce(max(x) FILTER (p = 3), 0) * 0.15, 9) AS score FROM n GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place, id) AS INTEGER) AS final_rank, id AS chunk_id, round(score, 6) AS score FROM m QUALIFY final_rank <= 10""",
    "query_by_type": f"WITH {BM25_SQL}, {_FUSED.format(where="lang = 'de'")} SELECT * FROM z",
    "query_by_document": f"WITH {BM25_SQL}, {_FUSED.format(where='doc_id = 7')} SELECT * FROM z",
    "engine_filters": f"""WITH {BM25_SQL} SELECT 'type' AS run, query_id, least(10, count(*)) AS n FROM bm WHERE id IN (SELECT doc_id FROM documents WHERE lang = 'fr') GROUP BY ALL
UNION ALL SELECT 'lenient', query_id, least(10, count(*)) FROM bm GROUP BY ALL""",
    "bm25_upsert": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(CASE WHEN doc_id % 2 = 0 THEN text ELSE lang END), '[\p{L}\p{N}_]+') AS t FROM documents WHERE source <> 'src1'),
p AS (SELECT DISTINCT doc_id, unnest(t) AS term FROM d)
SELECT 'documents' AS name, count(*) AS n FROM d UNION ALL SELECT 'tokens', CAST(sum(len(t)) AS BIGINT) FROM d UNION ALL SELECT 'postings', count(*) FROM p UNION ALL SELECT 'terms', count(DISTINCT term) FROM p
UNION ALL SELECT 'term characters', CAST(sum(length(term)) AS BIGINT) FROM (SELECT DISTINCT term FROM p)""",
    "chunk_lookup": f"""WITH {_CHUNKS}, h AS (SELECT id AS chunk_id, CASE WHEN chunk_index % 2 = 0 THEN 'own' ELSE '' END AS own FROM k UNION ALL SELECT 'none', '')
SELECT chunk_id, CASE WHEN own <> '' THEN own ELSE chunk_text END AS chunk_text, document_id, CASE WHEN o_orderstatus <> 'P' THEN 'o' || o_orderkey END AS filename, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS document_type
FROM h LEFT JOIN k ON id = chunk_id LEFT JOIN orders ON CAST(o_orderkey AS VARCHAR) = document_id""",
    "document_lookup": "SELECT CAST(o_orderkey AS VARCHAR) AS id, 'o' || o_orderkey AS filename, o_orderstatus AS document_type, 'p/' || o_orderkey AS source_path FROM orders WHERE o_orderkey IN (7, 33)",
    "chunks_of_document": f"WITH {_CHUNKS} SELECT *, 'all' AS part FROM k WHERE document_id = '7' UNION ALL (SELECT *, 'first' FROM k WHERE document_id = '32' ORDER BY chunk_index LIMIT 2)",
    "stored_rows": f"""WITH {_CHUNKS} SELECT 'documents' AS name, count(*) AS n, count(*) AS documents, min(CAST(o_orderkey AS VARCHAR)) AS first FROM orders UNION ALL SELECT 'chunks', count(*), count(DISTINCT document_id), min(id) FROM k
UNION ALL SELECT 'tables', count(*), count(DISTINCT document_id), min(id) FROM k WHERE chunk_index = 1 UNION ALL SELECT 'images', count(*), count(DISTINCT document_id), min(id) FROM k WHERE chunk_index = 2""",
    "stored_chunks": f"""WITH x AS (SELECT conv_id || '-' || turn AS document_id, {_NORMAL} AS t FROM conversations)
SELECT left(sha256(document_id || chr(31) || 'text' || chr(31) || '0'), 32) AS id, document_id, CAST(0 AS INTEGER) AS chunk_index, 'text' AS chunk_type, CAST(length(t) AS VARCHAR) AS end_char_index, CAST(greatest(1, length(t) // 4) AS VARCHAR) AS token_count, md5(t) AS text_md5 FROM x WHERE t <> ''""",
    "upload_keys": """WITH s AS (SELECT o_orderpriority AS source, count(*) AS stored FROM orders GROUP BY 1)
SELECT 'raw_documents/' || o_orderpriority || '/' || o_orderstatus || '/order.' || o_orderkey || '_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '.pdf' AS key,
  o_orderkey || '/image_3_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '_' || left(md5(o_orderstatus), 8) || '.png' AS image, stored FROM orders JOIN s ON source = o_orderpriority""",
    "vector_delete": "SELECT label, count(*) AS n, 64 AS size FROM embeddings WHERE label NOT IN (1, 4) GROUP BY label",
    "blob_paths": """SELECT CAST(o_orderkey AS VARCHAR) AS document_id, 'p/' || o_orderkey AS path FROM orders WHERE o_orderstatus = 'F'
UNION SELECT CAST(l_orderkey AS VARCHAR), 'img/' || l_orderkey || '/' || (l_linenumber % 2) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_linenumber < 3""",
    "schema_check": "SELECT * FROM (VALUES ('chunks: no table', NULL::BIGINT), ('documents.filename: string, not int', NULL), ('documents after', 0), ('vectors after', 0)) AS v(name, rows) UNION ALL SELECT 'documents before', count(*) FROM documents UNION ALL SELECT 'vectors before', count(*) FROM embeddings",
    "chunk_statistics": """WITH c AS (SELECT text, greatest(1, length(text) // 4) AS t FROM documents)
SELECT count(*) AS total_chunks, CAST(sum(t) AS BIGINT) AS total_tokens, CAST(sum(t) // count(*) AS BIGINT) AS avg_tokens, CAST(min(t) AS INTEGER) AS min_tokens, CAST(max(t) AS INTEGER) AS max_tokens, CAST(sum(length(text)) AS BIGINT) AS total_characters FROM c""",
    "chunk_function": f"SELECT doc_id, md5({_NORMAL}) AS chunk_md5, CAST(greatest(1, length({_NORMAL}) // 4) AS INTEGER) AS tokens FROM documents WHERE length({_NORMAL}) BETWEEN 1 AND 3199",
    "table_json": """SELECT n_regionkey, '{"headers":["Key","Name"],"rows":[' || string_agg('["' || n_nationkey || '","' || n_name || '"]', ',' ORDER BY n_nationkey) || ']}' AS json, CAST(count(*) AS INTEGER) AS row_count, 2 AS col_count, 'Key,Name' AS headers, 'lattice' AS method, CAST(0.9 AS DOUBLE) AS accuracy, 3 AS page FROM nation GROUP BY n_regionkey""",
    "chunk_numbering": """WITH k AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 20 THEN 'text' WHEN l_quantity < 40 THEN 'table' ELSE 'image' END AS kind FROM lineitem),
a AS (SELECT *, CAST(l_linenumber AS INTEGER) AS chunk_index FROM k WHERE kind = 'text'), m AS (SELECT l_orderkey, max(chunk_index) + 1 AS s FROM a GROUP BY 1),
b AS (SELECT k.*, CAST(coalesce(s, 0) + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) AS chunk_index FROM k LEFT JOIN m USING (l_orderkey) WHERE kind = 'table'),
ab AS (SELECT * FROM a UNION ALL SELECT * FROM b), n AS (SELECT l_orderkey, max(chunk_index) + 1 AS s FROM ab GROUP BY 1)
SELECT * FROM ab UNION ALL SELECT k.*, CAST(coalesce(s, 0) + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) FROM k LEFT JOIN n USING (l_orderkey) WHERE kind = 'image'""",
    "metadata_spread": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'name=' || c_name || ';' ELSE '' END || 'nation=' || c_nationkey || ';segment=' || lower(c_mktsegment) AS metadata FROM customer",
    "content_cut": "SELECT CAST(doc_id AS VARCHAR) AS chunk_id, CAST(length(left(repeat(text, 20), 50000)) AS INTEGER) AS length, md5(left(repeat(text, 20), 50000)) AS content_md5 FROM documents",
    "spaced_headings": "SELECT n_nationkey, CASE WHEN regexp_matches(upper(n_name), '^[A-Z]{9,}$') THEN upper(n_name) WHEN regexp_matches(trim(regexp_replace(array_to_string(string_split(upper(n_name), ''), ' '), '\\s+', ' ', 'g')), '^[A-Z][A-Z\\s]{8,}$') AND NOT regexp_matches(upper(n_name), '^[A-Z]{3,}$') THEN trim(regexp_replace(array_to_string(string_split(upper(n_name), ''), ' '), '\\s+', ' ', 'g')) END AS heading FROM nation",
    "file_texts": r"""SELECT 'in/r' || n_regionkey || '.docx' AS path, 'docx' AS file_type, r_name || E'\n\nKey | Name\n\n' || string_agg(n_nationkey || ' | ' || n_name, E'\n\n' ORDER BY n_nationkey) AS text, FALSE AS failed, 1 AS n_tables FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey, r_name
UNION ALL SELECT * FROM (VALUES ('in/broken.docx', 'docx', NULL, TRUE, NULL), ('in/a.txt', 'txt', E'café\n\nx', FALSE, NULL), ('in/b.md', 'md', '# café', FALSE, NULL), ('in/c.gz', NULL, NULL, TRUE, NULL)) AS v(a, b, c, d, e)""",
    "file_tables": "SELECT 'in/r' || n_regionkey || '.docx' AS path, 1 AS table_index, 'docx' AS method, CAST(count(*) + 1 AS INTEGER) AS n_rows, arg_min(n_name, n_nationkey) AS first_name FROM nation GROUP BY n_regionkey",
    "file_images": """SELECT 'in/r' || r_regionkey || '.docx' AS path, 3 - k AS image_index, 'png' AS extension, 300 * k * (r_regionkey + 1) AS width, 600 AS height,
CASE WHEN w / 600 > 2 OR w / 600 < 0.5 THEN 'diagram' WHEN w / 600 BETWEEN 0.8 AND 1.2 AND w < 500 THEN 'screenshot' WHEN w / 600 BETWEEN 0.8 AND 1.2 OR w BETWEEN 500 AND 2000 THEN 'chart' WHEN w > 2000 THEN 'photo' ELSE 'unknown' END AS image_type
FROM (SELECT *, 300 * k * (r_regionkey + 1) AS w FROM region, (VALUES (1), (2)) AS v(k))""",
    "extraction_status": """SELECT 'in/r' || r_regionkey || '.docx' AS path, 1::BIGINT AS n_tables, 2::BIGINT AS n_images, 'ok' AS status FROM region
UNION ALL SELECT * FROM (VALUES ('in/broken.docx', 0, 0, 'failed'), ('in/a.txt', 0, 0, 'ok'), ('in/b.md', 0, 0, 'ok'), ('in/c.gz', 0, 0, 'failed')) AS v(a, b, c, d)""",
    "embedded_chunks": f"""WITH {_T}, x AS (SELECT chunk_id, CASE WHEN chunk_index <> 1 AND trim(chunk_text) <> '' THEN 'aa ' || chunk_text ELSE '' END AS s FROM t), n AS (SELECT chunk_id, {_letters('s')} FROM x),
m AS (SELECT *, CAST(greatest(sqrt(a * a + e * e + i * i + o * o), 1e-12) AS FLOAT) AS z FROM n)
SELECT chunk_id, {', '.join(f"round(CAST(CAST({x} AS FLOAT) / z AS DOUBLE), 5) AS {x}" for x in "aeio")} FROM m""",
    "model_entities": f"""WITH {_T}, e AS (SELECT chunk_id, unnest(regexp_extract_all(chunk_text, '[A-Za-z]{{10,}}')) AS name FROM t), d AS (SELECT chunk_id, lower(name) AS normalized_name, min(name) AS entity_name FROM e GROUP BY ALL)
SELECT *, CASE WHEN length(entity_name) % 2 = 1 THEN 'DATE' ELSE 'ORG' END AS entity_type, CASE WHEN length(entity_name) % 2 = 1 THEN entity_name END AS entity_value, CAST(0.85 AS DOUBLE) AS confidence FROM d""",
    "captioned_images": f"""WITH {_T}, x AS (SELECT chunk_id, strlen(chunk_text) AS n, array_to_string(list_filter(list_transform(string_split(chunk_text, E'\\n'), lambda s: trim(s)), lambda s: s <> ''), ' ') AS s FROM t)
SELECT chunk_id, CASE WHEN n % 2 = 1 THEN n || ' bytes' END AS caption, md5(s) AS text_md5 FROM x""",
    "model_answers": f"""WITH {_T}, c AS (SELECT query_id, max(chunk_text) AS context FROM t WHERE chunk_index > 0 AND query_id % 3 > 0 GROUP BY ALL)
SELECT query_id, CASE WHEN trim(coalesce(context, '')) <> '' THEN left(chunk_text, 10) || ': ' || length(context) ELSE 'I don''t have enough information to answer this question. No relevant context was found.' END AS answer FROM t LEFT JOIN c USING (query_id) WHERE chunk_index = 0""",
    "source_rows": f"WITH {_T} SELECT query_id, chunk_id, query_id AS document_id, role AS filename, chunk_index, CASE WHEN length(chunk_text) > 200 THEN left(chunk_text, 200) || '...' ELSE chunk_text END AS chunk_text, '[Document: ' || role || ', Chunk: ' || chunk_index || ']' AS citation, CAST(0.5 AS DOUBLE) AS score FROM t",
    "engine_ingest": f"""WITH {_T}, k AS (SELECT chunk_id, 'text' AS kind, 0 AS i FROM t UNION ALL SELECT chunk_id, 'table', 1 FROM t WHERE chunk_index % 2 = 0 UNION ALL SELECT chunk_id, 'image', CASE WHEN chunk_index % 2 = 0 THEN 1 ELSE 0 END + v FROM t, (VALUES (1), (2)) AS n(v) WHERE chunk_index % 3 = 0)
SELECT kind AS name, count(*) AS n, CAST(sum(i) AS BIGINT) AS total, 'chunk' AS kind FROM k GROUP BY k.kind UNION ALL SELECT kind || '_chunks', count(*), NULL, 'vector' FROM k GROUP BY k.kind
UNION ALL SELECT 'Document', count(*), NULL, 'node' FROM t UNION ALL SELECT 'Media', count(*), NULL, 'node' FROM k WHERE kind = 'image' UNION ALL SELECT 'HAS_MEDIA', count(*), NULL, 'edge' FROM k WHERE kind = 'image' UNION ALL SELECT 'HAS_CHUNK', count(*), NULL, 'edge' FROM k""",
    "engine_markdown": f"""WITH {_T} SELECT chunk_id AS document_id, 'Turn: ' || chunk_index || ', Role: ' || role || E'\\nTurn: z, Role: z' AS chunk_text, E'| Turn | Role |\\n| --- | --- |\\n| ' || chunk_index || ' | ' || role || E' |\\n| z | z |' AS table_markdown, CAST(1 AS INTEGER) AS chunk_index FROM t WHERE chunk_index % 2 = 0""",
    "engine_listing": """WITH k AS (SELECT 'raw/' || source || '/' || lang || '/' || doc_id AS key, doc_id, source, lang FROM documents)
(SELECT key, 'listed' AS kind FROM k WHERE source = 'src1' AND lang = 'en' ORDER BY key LIMIT 5) UNION ALL (SELECT key, 'found' FROM k ORDER BY doc_id LIMIT 1)""",
    "engine_delete": """WITH d AS (SELECT doc_id FROM documents WHERE lang <> 'de') SELECT 'documents' AS name, count(*) AS n FROM d UNION ALL SELECT 'chunks', count(*) FROM d UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'de') UNION ALL SELECT 'indexed', count(*) FROM d""",
}
