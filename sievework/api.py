"""The engine as one object: ingest, query, list, get and delete over stored tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import images as image_functions
from sievework.functions import tables as table_functions
from sievework.functions.text import keywords
from sievework.operators import bm25, chunking, dense, entities, fusion, graph, lifecycle, sections
from sievework.operators.segments import Segments
from sievework.schemas import deterministic_id
from sievework.session import materialize, shared_folder
from sievework.sources import files, plugins, stores


@dataclass
class Engine:
    """documents (document_id, filename, document_type, source_path, text, ...), chunks (chunk_id, document_id,
    chunk_index, chunk_text, chunk_type), vectors (collection, chunk_id, document_id, vector), a graph and an inverted
    index of the chunks. Tables are immutable DataFrames; each change returns a new engine."""

    documents: DataFrame
    chunks: DataFrame | None = None
    vectors: DataFrame | None = None
    graph: graph.Graph | None = None
    weights: dict[str, float] = field(default_factory=lambda: dict(fusion.WEIGHTS))
    index: Segments | None = None

    @staticmethod
    def extract(found: DataFrame) -> DataFrame:
        """Text and tables of files, without indexing them."""
        return files.extract(found)

    def ingest(self, tables: DataFrame | None = None, images: DataFrame | None = None, embedder=None) -> Engine:
        """Chunks, sections, entities, topics, media and edges of all documents, and the inverted index.

        tables: document_id, table_index, data (rows of cells, header first). images: document_id, image_index, image_path,
        image_type, extracted_text, caption and, if known, width, height and page. Tables go on after a document's text
        chunks, images after both. An embedder (see sources.plugins) gives vectors, a collection for each kind of chunk."""
        docs, spark = self.documents, self.documents.sparkSession
        text = chunking.chunk(docs, "document_id", "text").withColumn("chunk_type", F.lit("text"))
        text = sections.titled(text, sections.heading(F.col("chunk_text")), "document_id", "chunk_index")
        every = text.select("document_id", "chunk_index", "chunk_text", "chunk_type", "section_index", "section_title", "start_char_index", "end_char_index", "token_count")
        if tables is not None:
            t = tables.where(table_functions.is_valid(F.col("data"))).withColumn("_t", table_functions.split_header(F.col("data")))
            t = t.select("document_id", "table_index", table_functions.flat_text(F.col("_t.headers"), F.col("_t.rows")).alias("chunk_text"), table_functions.markdown(F.col("_t.headers"), F.col("_t.rows")).alias("table_markdown"), F.lit("table").alias("chunk_type"))
            every = every.unionByName(stores.continued(t, every, "document_id", "table_index").drop("table_index"), allowMissingColumns=True)
        if images is not None:
            told = image_functions.with_caption(F.col("extracted_text"), F.col("caption"))
            i = images.withColumns({"chunk_text": image_functions.chunk_text(told, F.col("image_type")), "chunk_type": F.lit("image")})
            i = stores.continued(i, every, "document_id", "image_index")
            every = every.unionByName(i.select("document_id", "chunk_index", "chunk_text", "chunk_type", "image_path", "caption"), allowMissingColumns=True)
        for name in ("table_markdown", "image_path", "caption"):
            if name not in every.columns:
                every = every.withColumn(name, F.lit(None).cast("string"))
        told = sections.place_tables(every, "document_id").withColumn("section_title", F.coalesce("section_title", F.lit(sections.UNTITLED)))
        told = told.withColumn("chunk_id", deterministic_id(F.col("document_id"), F.col("chunk_type"), F.col("chunk_index")))
        # What all tables below are made of is computed once.
        told = materialize(told.withColumn("section_id", deterministic_id(F.col("document_id"), F.lit("section"), F.col("section_index"))))
        g = graph.empty(spark)
        first = F.min_by("section_title", F.struct(F.col("section_title") == sections.UNTITLED, "chunk_index"))
        section = materialize(told.groupBy("section_id").agg(F.first("document_id").cast("string").alias("document_id"), first.alias("title"), F.first("section_index").alias("section_index")))
        found = materialize(entities.dedupe(entities.usable(entities.by_pattern(told.select("document_id", "chunk_id", "chunk_index", "chunk_text"), order="document_id")), "entity_name", by="document_id"))
        mention = materialize(entities.mentions(told, found, "document_id"))
        topics = materialize(entities.topics(section, found, told.where("chunk_type = 'text'")))
        entity = entities.dedupe(found, "entity_name")
        topic = topics.groupBy("normalized_name").agg(F.min("topic_name").alias("topic_name"), F.min_by("keywords", "document_id").alias("keywords"))
        g.nodes |= {
            "Document": graph.document_nodes(docs),
            "Section": section,
            "Chunk": told.select("chunk_id", F.col("document_id").cast("string").alias("document_id"), F.left("chunk_text", F.lit(50_000)).alias("content"), "chunk_index", "chunk_type"),
            "Entity": materialize(entity),
            "Topic": materialize(topic),
        }
        g.edges |= {
            "HAS_SECTION": section.select(F.col("document_id").alias("src"), F.col("section_id").alias("dst"), F.col("section_index").alias("order")),
            "HAS_CHUNK": told.select(F.col("section_id").alias("src"), F.col("chunk_id").alias("dst"), "chunk_index"),
            "NEXT_CHUNK": sections.next_chunks(told, ["document_id", "section_index"], "chunk_index"),
            "MENTIONS": mention,
            "RELATED_TO": materialize(graph.with_defaults(entities.related(mention), "RELATED_TO")),
            "HAS_TOPIC": materialize(entities.topic_links(section, topics, told.select("chunk_id", "section_id"))),
            "ASSOCIATED_WITH": entities.type_links(entity, topic),
        }
        if images is not None:
            held = images.join(told.where("chunk_type = 'image'").select("document_id", "image_path", "chunk_id"), ["document_id", "image_path"], "left")
            held = held.withColumn("id", deterministic_id(F.col("document_id"), F.lit("media"), F.col("image_index")))
            g.nodes["Media"], g.edges["HAS_MEDIA"], g.edges["DESCRIBES"] = entities.media_of(held, found)
        vectors = self.vectors
        if embedder is not None:
            collection = F.concat(F.col("chunk_type"), F.lit("_chunks"))
            vectors = materialize(plugins.embed(told.select("chunk_id", "document_id", "chunk_text", collection.alias("collection")), embedder).select("collection", "chunk_id", "document_id", "vector"))
        index = Segments(spark, shared_folder(spark)).upsert(told.where("chunk_type <> 'image'").withColumn("_t", F.coalesce("table_markdown", "chunk_text")), "chunk_id", "_t")
        return Engine(docs, told, vectors, g, self.weights, index)

    def save(self, path: str) -> Engine:
        """The engine over stored tables: what ingest() has planned is computed once, and queries read it."""
        for name, table in self._tables().items():
            stores.overwrite(table, f"{path}/{name}")
        if self.index is not None:
            self.index.copy(f"{path}/index")
        return Engine.load(self.documents.sparkSession, path, self.weights)

    @staticmethod
    def load(spark: SparkSession, path: str, weights: dict[str, float] | None = None) -> Engine:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        names = [s.getPath().getName() for s in hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)]
        for n in {n.removesuffix(".old") for n in names if n.endswith(".old")}:
            stores.recover(spark, f"{path}/{n}")  # a save that was cut off
            names.append(n)
        have = {n: spark.read.parquet(f"{path}/{n}") for n in names if n != "index" and not n.endswith((".new", ".old"))}
        of = lambda kind: {n[len(kind) :]: t for n, t in have.items() if n.startswith(kind)}
        g = graph.empty(spark)
        g.nodes |= of("node-")
        g.edges |= of("edge-")
        return Engine(have["documents"], have.get("chunks"), have.get("vectors"), g if of("node-") else None, weights or dict(fusion.WEIGHTS), Segments.open(spark, f"{path}/index") if "index" in names else None)

    def _tables(self) -> dict[str, DataFrame]:
        out = {"documents": self.documents} | ({"chunks": self.chunks} if self.chunks is not None else {}) | ({"vectors": self.vectors} if self.vectors is not None else {})
        if self.graph is not None:
            out |= {f"node-{n}": t for n, t in self.graph.nodes.items()} | {f"edge-{n}": t for n, t in self.graph.edges.items()}
        return out

    def query(self, questions: DataFrame, k: int = 10, filters: dict[str, str] | None = None, sparse: bool = True, dense_text: bool = True, dense_table: bool = True, dense_image: bool = True, by_graph: bool = True, normalized: bool = True, strict: bool = True) -> DataFrame:
        """Fused hits for questions (query_id, query, and vector where there are vectors). Blank questions have none.
        With strict, a filter on a field that a store lacks matches nothing there."""
        questions = questions.where(F.trim("query") != "")
        if not any((sparse, dense_text, dense_table, dense_image, by_graph)):
            raise ValueError("at least one retriever must be on")
        facts = self.documents.select("document_id", *[c for c in ("filename", "document_type", "source_path") if c in self.documents.columns])
        every = self.chunks.join(facts, "document_id")
        chunks = bm25.exact_filter(every, filters or {}, strict=strict)
        parts = []
        if sparse:
            # The filter takes hits away; it does not change what terms weigh.
            kept = chunks.select(F.col("chunk_id").alias("id")) if filters else None
            if self.index is not None:
                found = self.index.search(questions, 2 * k, kept)
            else:
                found = bm25.search_texts(every.where("chunk_type <> 'image'"), questions, "chunk_id", "chunk_text")
                found = found.join(kept, "id", "left_semi") if filters else found
            parts.append(bm25.top(found, 2 * k).select("query_id", F.lit("sparse").alias("source"), "rank", F.col("id").alias("chunk_id"), "score"))
        if self.vectors is not None and "vector" in questions.columns:
            for on, source, collection in ((dense_text, "dense", "text_chunks"), (dense_table, "table", "table_chunks"), (dense_image, "image", "image_chunks")):
                if on:
                    rows = self.vectors.where(F.col("collection") == collection).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
                    found = dense.search(rows, questions.select("query_id", "vector"), 2 * k, "chunk_id", "vector")
                    parts.append(found.select("query_id", F.lit(source).alias("source"), "rank", F.col("id").alias("chunk_id"), "score"))
        if by_graph and self.graph is not None:
            words = questions.select("query_id", keywords(F.col("query")).alias("keywords")).where(F.size("keywords") > 0)
            told = chunks.select("chunk_id", "document_id", "section_title", "section_index", "chunk_index", F.col("chunk_text").alias("content"))
            found = graph.retrieve(told, self.graph, words, k)
            parts.append(found.select("query_id", F.lit("graph").alias("source"), "rank", "chunk_id", "score"))
        hits = parts[0]
        for p in parts[1:]:
            hits = hits.unionByName(p)
        return fusion.fuse(hits, k, self.weights, normalized).join(chunks.select("chunk_id", "document_id", "chunk_index", "chunk_text", "chunk_type"), "chunk_id", "left")

    def query_document(self, questions: DataFrame, document_id: str, k: int = 10) -> DataFrame:
        return self.query(questions, k, {"document_id": document_id})

    def query_type(self, questions: DataFrame, document_type: str, k: int = 10) -> DataFrame:
        return self.query(questions, k, {"document_type": document_type})

    def list_documents(self, source: str | None = None, document_type: str | None = None, limit: int | None = None) -> DataFrame:
        return files.listing(self.documents.withColumnRenamed("source_path", "key"), source, document_type, limit)

    def get_document(self, source_path: str) -> DataFrame:
        return self.documents.where(F.col("source_path") == source_path).limit(1)

    def delete_documents(self, ids: DataFrame) -> Engine:
        """Without the documents in ids (document_id), in every store."""
        store = {"documents": self.documents} | ({"chunks": self.chunks} if self.chunks is not None else {}) | ({"vectors": self.vectors} if self.vectors is not None else {})
        left = {n: lifecycle.delete_by_keys(t, ids, "document_id") for n, t in store.items()}
        index = self.index
        if index is not None and self.chunks is not None:
            index = index.delete(self.chunks.join(ids.select("document_id").distinct(), "document_id", "left_semi").select(F.col("chunk_id").alias("id")))
        return Engine(left["documents"], left.get("chunks"), left.get("vectors"), lifecycle.delete_from_graph(self.graph, ids) if self.graph else None, self.weights, index)
