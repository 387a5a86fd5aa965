"""The property graph as DataFrames: a node table for each label, an edge table (src, dst, properties) for each type."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import occurrences
from sievework.operators import grams
from sievework.schemas import EDGE_TYPES, NODES
from sievework.session import materialize, shared_folder


@dataclass
class Graph:
    nodes: dict[str, DataFrame]
    edges: dict[str, DataFrame] = field(default_factory=dict)

    def chunks_in_order(self) -> DataFrame:
        """Document, section and chunk of the chain, one row for each chunk."""
        s = self.nodes["Section"].select("section_id", "document_id", F.col("title").alias("section_title"), "section_index")
        held = self.edges["HAS_CHUNK"].select(F.col("src").alias("section_id"), F.col("dst").alias("chunk_id"))
        return self.nodes["Chunk"].drop("document_id").join(held, "chunk_id").join(s, "section_id")


def empty(spark) -> Graph:
    nodes = {label: spark.createDataFrame([], schema) for label, (_, schema) in NODES.items()}
    return Graph(nodes, {t: spark.createDataFrame([], "src string, dst string") for t in EDGE_TYPES})


# ---- writes -------------------------------------------------------------------------------------------------------


def upsert_nodes(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """MERGE on key: later values win where they are not null; columns in keep are set only on creation."""
    columns = old.columns
    rows = old.withColumn("_seq", F.lit(0)).unionByName(new.select(*[c for c in columns if c in new.columns]).withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    pick = [(F.min_by if c in keep else F.max_by)(c, F.when(F.col(c).isNotNull(), F.col("_seq"))).alias(c) for c in columns if c != key]
    return rows.groupBy(key).agg(*pick).select(*columns)


def upsert_edges(old: DataFrame, new: DataFrame, sources: DataFrame, targets: DataFrame, source_key: str, target_key: str) -> DataFrame:
    """MERGE on (src, dst): an edge without both ends is not written; later properties win."""
    ends = new.join(sources.select(F.col(source_key).alias("src")).distinct(), "src", "left_semi").join(targets.select(F.col(target_key).alias("dst")).distinct(), "dst", "left_semi")
    rows = old.withColumn("_seq", F.lit(0)).unionByName(ends.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    properties = [c for c in rows.columns if c not in ("src", "dst", "_seq")]
    pick = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_seq"))).alias(c) for c in properties]
    return rows.groupBy("src", "dst").agg(*pick) if pick else rows.select("src", "dst").distinct()


#: What an edge's properties are where none is given.
EDGE_DEFAULTS = {"RELATED_TO": {"context": "", "confidence": 0.5}, "MENTIONS": {"frequency": 1, "importance": 0.5}, "ABOUT": {"frequency": 1, "importance": 0.5}}


def with_defaults(edges: DataFrame, kind: str) -> DataFrame:
    """edges (src, dst, ...) with the properties of their type, filled where they are missing."""
    for name, value in EDGE_DEFAULTS.get(kind, {}).items():
        edges = edges.withColumn(name, F.coalesce(name, F.lit(value)) if name in edges.columns else F.lit(value))
    return edges


def document_nodes(documents: DataFrame, key: str = "document_id") -> DataFrame:
    """Document nodes; a document without chunks has one too. The title is the file name."""
    text = lambda c: F.col(c).cast("string") if c in documents.columns else F.lit(None).cast("string")
    return documents.select(F.col(key).cast("string").alias("document_id"), F.coalesce(text("filename"), F.lit("unknown")).alias("title"), text("source_path").alias("source_path"), text("document_type").alias("document_type")).dropDuplicates(["document_id"])


def samples(graph: Graph, chunks: int = 5, characters: int = 100) -> DataFrame:
    """Some chunks with content, in the order of their ids: the short id and the beginning of the content."""
    rows = graph.nodes["Chunk"].where(F.coalesce("content", F.lit("")) != "").orderBy("chunk_id").limit(chunks)
    return rows.select(F.left(F.col("chunk_id").cast("string"), F.lit(8)).alias("short_id"), F.left("content", F.lit(characters)).alias("preview"))


def census(graph: Graph) -> DataFrame:
    """Nodes of each label and edges of each type."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), "n") for kind, tables in (("node", graph.nodes), ("edge", graph.edges)) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sections_to_rows(nested: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nested documents (document_id, sections: array of section_id, title, section_index, chunks) as section and chunk
    nodes with HAS_SECTION and HAS_CHUNK edges. Chunks default to index 0, type text and no content."""
    s = nested.select("document_id", F.posexplode("sections").alias("order", "s"))
    sections = s.select("s.section_id", "document_id", "s.title", "s.section_index")
    c = s.select("document_id", "s.section_id", F.posexplode("s.chunks").alias("order", "c"))
    index = F.coalesce("c.chunk_index", F.lit(0))
    chunks = c.select("c.chunk_id", "document_id", F.left(F.coalesce("c.content", F.lit("")), F.lit(50_000)).alias("content"), index.alias("chunk_index"), F.coalesce("c.chunk_type", F.lit("text")).alias("chunk_type"))
    return sections, chunks, s.select(F.col("document_id").alias("src"), F.col("s.section_id").alias("dst"), "order"), c.select(F.col("section_id").alias("src"), F.col("c.chunk_id").alias("dst"), "order", index.alias("chunk_index"))


# ---- reads: each takes queries (query_id, keywords) or seeds and returns query_id, chunk_id, graph_score, ... ---------


def _lower(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.transform("keywords", lambda w: F.lower(w)).alias("keywords"))


def limited(hits: DataFrame, k: int, *order: Column | str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Rows of questions' words that are sent to every task at once; more go in groups.
SENT = 20_000


def meeting(rows: DataFrame, words: DataFrame, condition: Column) -> DataFrame:
    """rows with each of words that a condition, which no key can serve, allows. words are counted and sent in groups of
    about SENT rows, each of which meets rows in one scan."""
    parts = max(1, -(-words.count() // SENT))
    out = None
    for i in range(parts):
        group = words.where(F.pmod(F.xxhash64(*words.columns), F.lit(parts)) == i) if parts > 1 else words
        found = rows.join(F.broadcast(group), condition)
        out = found if out is None else out.unionByName(found)
    return out


def by_section_title(chunks: DataFrame, queries: DataFrame, score: float = 0.9) -> DataFrame:
    """Chunks of sections whose title contains any keyword. chunks: chunk_id, document_id, section_title,
    section_index, chunk_index, content."""
    words = _lower(queries).select("query_id", F.explode("keywords").alias("w"))
    titles = chunks.select("section_title").distinct()
    found = meeting(titles, words, F.lower("section_title").contains(F.col("w"))).select("query_id", "section_title").distinct()
    return chunks.join(found, "section_title").withColumn("graph_score", F.lit(score))


def by_content(chunks: DataFrame, queries: DataFrame, content: str = "content", index: grams.Grams | None = None) -> DataFrame:
    """Chunks that contain any keyword: (matches + a tenth of all occurrences) / number of keywords; may exceed 1.
    With a trigram index of the chunks, only its candidates are read; else keywords of the whole batch are tested in one
    scan. Candidates get their keywords before texts are joined, so that no text goes by its question."""
    low = chunks.withColumn("_low", F.lower(content))
    asked = _lower(queries)
    if index is not None:
        few = asked.limit(SENT + 1).count() <= SENT
        held = grams.containing(index, chunks, asked).join(F.broadcast(asked) if few else asked, "query_id")
        rows = low.join(held, "chunk_id").select("query_id", *low.columns, "keywords")
    else:
        rows = meeting(low, asked, F.exists("keywords", lambda w: F.col("_low").contains(w)))
    rows = rows.withColumn("_hit", F.filter("keywords", lambda w: F.col("_low").contains(w))).where(F.size("_hit") > 0)
    # Keywords that are not there do not occur.
    total = F.aggregate(F.transform("_hit", lambda w: occurrences(F.col("_low"), w)), F.lit(0), lambda a, x: a + x)
    return rows.withColumn("match_count", F.size("_hit")).withColumn("graph_score", (F.col("match_count") + 0.1 * total) / F.greatest(F.size("keywords"), F.lit(1))).drop("keywords", "_low", "_hit")


def by_entity_mention(mention: DataFrame, entities: DataFrame, queries: DataFrame, score: float = 0.7) -> DataFrame:
    """query_id, chunk_id, match_count (distinct entities) of chunks that mention an entity whose name contains a keyword."""
    words = _lower(queries).select("query_id", F.explode("keywords").alias("w"))
    named = meeting(entities.select("normalized_name").distinct(), words, F.col("normalized_name").contains(F.col("w"))).select("query_id", F.col("normalized_name").alias("dst")).distinct()
    return mention.join(named, "dst").groupBy("query_id", F.col("src").alias("chunk_id")).agg(F.count_distinct("dst").alias("match_count")).withColumn("graph_score", F.lit(score))


def by_entity(mention: DataFrame, entities: DataFrame, names: DataFrame) -> DataFrame:
    """query_id, chunk_id, importance of chunks that mention the entity of an exact name (case matters). A name that many
    entities bear is one: each mention of it is returned once for a query."""
    asked = names.select("query_id", "entity_name").distinct()
    named = entities.select(F.col("normalized_name").alias("dst"), "entity_name").join(asked, "entity_name").select("query_id", "dst").distinct()
    return mention.join(named, "dst").select("query_id", F.col("src").alias("chunk_id"), "importance")


def by_entities_across(mention: DataFrame, names: DataFrame, score: float = 0.85) -> DataFrame:
    """query_id, chunk_id, entity_matches: chunks of any document that mention the named entities (normalised)."""
    named = names.select("query_id", F.lower(F.trim("entity_name")).alias("dst")).distinct()
    return mention.join(named, "dst").groupBy("query_id", F.col("src").alias("chunk_id")).agg(F.count_distinct("dst").alias("entity_matches")).withColumn("graph_score", F.lit(score))


def by_topic(topics: DataFrame, has_topic: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id, topic, graph_score 0.75 + 0.15 * relevance, for topics whose name or keywords contain a keyword."""
    words = _lower(queries).select("query_id", F.explode("keywords").alias("w"))
    match = F.lower("topic_name").contains(F.col("w")) | F.exists("keywords", lambda k: F.lower(k).contains(F.col("w")))
    found = meeting(topics, words, match).select("query_id", F.col("normalized_name").alias("dst")).distinct()
    relevance = F.coalesce("relevance", F.lit(0.5))
    return has_topic.join(found, "dst").select("query_id", F.col("src").alias("chunk_id"), F.col("dst").alias("topic"), (0.75 + 0.15 * relevance).alias("graph_score"))


#: Edges of a node from which it is a hub, whose edges are dealt by a salt.
HUB = 50_000


@dataclass(frozen=True)
class Adjacency:
    """Stored neighbours (a, salt, b), each pair once, and hubs (a, salts)."""

    rows: DataFrame
    hubs: DataFrame

    @staticmethod
    def of(pairs: DataFrame, hub: int = HUB) -> Adjacency:
        """Neighbours from pairs (a, b), as they stand."""
        rows = materialize(pairs.select("a", "b").distinct())
        hubs = materialize(rows.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > hub).select("a", F.ceil(F.col("n") / hub).cast("int").alias("salts")))
        salt = F.coalesce(F.pmod(F.xxhash64("b"), F.col("salts")), F.lit(0)).cast("int")
        return Adjacency(materialize(rows.join(hubs, "a", "left").select("a", salt.alias("salt"), "b")), hubs)

    def step(self, frontier: DataFrame, node: str) -> DataFrame:
        """The columns of frontier but node, with each neighbour b of node. A hub goes once to each of its salts."""
        rest = [c for c in frontier.columns if c != node]
        sent = frontier.select(*rest, F.col(node).alias("a")).join(self.hubs, "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        return sent.join(self.rows, ["a", "salt"]).select(*rest, "b")


def reached(starts: DataFrame, near: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """What starts reach within `most` steps, by hop (the starts are of hop 0). near gives the neighbours of a frontier, in
    the columns of starts. Each frontier is written, in a folder for its hop, and what has been reached is read from all
    folders: plans stay as they are from hop to hop, and the search ends with an empty frontier."""
    spark, folder, keys = starts.sparkSession, shared_folder(starts.sparkSession), starts.columns
    every = lambda: spark.read.schema(starts.schema).parquet(folder)
    starts.distinct().write.parquet(f"{folder}/hop=0")
    for hop in range(1, most + 1):
        last = spark.read.schema(starts.schema).parquet(f"{folder}/hop={hop - 1}")
        near(last).distinct().join(every().select(*keys), keys, "left_anti").write.parquet(f"{folder}/hop={hop}")
        if spark.read.schema(starts.schema).parquet(f"{folder}/hop={hop}").isEmpty():
            break
    return spark.read.option("basePath", folder).parquet(folder)


def shared_entities(mention: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """query_id, chunk_id, shared_entities, hop: chunks that share entities with the seeds (query_id, chunk_id), which
    are left out; each further hop starts from what the last one found."""
    if hops == 1:
        edges, first = mention.select("src", "dst").distinct(), seeds.select("query_id", "chunk_id").distinct()
        entities = edges.join(first, edges["src"] == first["chunk_id"]).select("query_id", "dst").distinct()
        near = edges.join(entities, "dst").groupBy("query_id", F.col("src").alias("chunk_id")).agg(F.count("*").alias("shared_entities"))
        return near.join(first, ["query_id", "chunk_id"], "left_anti").withColumn("hop", F.lit(1))
    chunk_of, entity_of = Adjacency.of(mention.select(F.col("dst").alias("a"), F.col("src").alias("b"))), Adjacency.of(mention.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    paths = lambda frontier: chunk_of.step(entity_of.step(frontier, "chunk_id").distinct().withColumnRenamed("b", "entity").withColumn("_e", F.col("entity")), "entity")
    found = reached(seeds.select("query_id", "chunk_id"), lambda f: paths(f).select("query_id", F.col("b").alias("chunk_id")), hops)
    # The entities that a chunk shares with the frontier of the hop before.
    sharing = paths(found.where(F.col("hop") < hops)).groupBy("query_id", (F.col("hop") + 1).alias("hop"), F.col("b").alias("chunk_id")).agg(F.count_distinct("_e").alias("shared_entities"))
    return found.where("hop > 0").join(sharing, ["query_id", "chunk_id", "hop"]).select("query_id", "chunk_id", "shared_entities", F.col("hop").cast("int").alias("hop"))


def related_chunks(mention: DataFrame, seeds: DataFrame) -> DataFrame:
    """query_id, chunk_id, shared_count: other chunks of a seed's entities, counting every path."""
    mine = mention.join(seeds, mention["src"] == seeds["chunk_id"]).select("query_id", F.col("chunk_id").alias("seed"), "dst")
    return mention.select("src", "dst").join(mine, "dst").where("src <> seed").groupBy("query_id", F.col("src").alias("chunk_id")).agg(F.count("*").alias("shared_count"))


def entity_hops(related: DataFrame, starts: DataFrame, most: int = 2) -> DataFrame:
    """query_id, start, name, hops: entities within `most` RELATED_TO steps, in either direction, by their least number
    of hops. The frontier of each hop is only what no hop before reached."""
    both = Adjacency.of(related.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(related.select("dst", "src")))
    found = reached(starts.select("query_id", F.col("name").alias("start"), "name"), lambda f: both.step(f, "name").withColumnRenamed("b", "name"), most)
    return found.where("hop > 0").select("query_id", "start", "name", F.col("hop").cast("int").alias("hops"))


def hop_score(hops: Column) -> Column:
    return F.greatest(F.lit(0.6), 0.8 - 0.1 * hops)


def by_relationship(related: DataFrame, mention: DataFrame, entities: DataFrame, queries: DataFrame, most: int = 2) -> DataFrame:
    """query_id, chunk_id, hops, graph_score of chunks that mention entities near those that keywords name."""
    words = _lower(queries).select("query_id", F.explode("keywords").alias("name"))
    starts = words.join(entities.select(F.col("normalized_name").alias("name")).distinct(), "name", "left_semi")
    reached = entity_hops(related, starts, most).groupBy("query_id", F.col("name").alias("dst")).agg(F.min("hops").alias("hops"))
    return mention.join(reached, "dst").groupBy("query_id", F.col("src").alias("chunk_id")).agg(F.min("hops").alias("hops")).withColumn("graph_score", hop_score(F.col("hops")))


def round_robin(hits: DataFrame, k: int, by: str = "document_id", *order: Column | str) -> DataFrame:
    """k hits of each query, taking a document's next best in turn; documents in the order of their best hit."""
    own = Window.partitionBy("query_id", by).orderBy(*order)
    rows = hits.withColumn("turn", F.row_number().over(own)).where(F.col("turn") <= k)
    # Only a document's best hit takes part in the order of documents, and no more than k documents can have a turn.
    first = limited(rows.where("turn = 1"), k, *order).select("query_id", by, F.col("rank").alias("_first"))
    return limited(rows.join(first, ["query_id", by]), k, "turn", "_first").drop("_first")


#: How a hit was found, in the order in which the cascade tries.
METHODS = ("section_title_match", "entity_mention", "topic", "entity_relationship", "content")


def cascade(chunks: DataFrame, graph: Graph, queries: DataFrame, k: int, by_document: bool = False) -> DataFrame:
    """Keyword retrieval over the graph: section titles; then, as far as there is room, entity mentions (twice the room,
    dealt over documents), topics and relationships; content always. A chunk counts for the first strategy that finds it;
    entity mentions that the dealing leaves out are not brought back by a later one. Ties of the final score go to the
    smaller chunk_index.

    Each strategy gives a bounded number of hits for a query, so that the steps that depend on what the others have found
    are taken on arrays, one row for each query."""
    mention, entities = graph.edges["MENTIONS"], graph.nodes["Entity"]
    info = chunks.select("chunk_id", "document_id", "section_index", "chunk_index")
    title = limited(by_section_title(chunks, queries).select("query_id", "chunk_id", "document_id", "section_index", "chunk_index", "graph_score"), k, "section_index", "chunk_index", "chunk_id")
    entity = limited(by_entity_mention(mention, entities, queries).join(info, "chunk_id"), 3 * k, F.desc("match_count"), "section_index", "chunk_index", "chunk_id")
    topic = by_topic(graph.nodes["Topic"], graph.edges["HAS_TOPIC"], queries).groupBy("query_id", "chunk_id").agg(F.max("graph_score").alias("graph_score")).join(info, "chunk_id")
    topic = limited(topic, k, F.desc("graph_score"), "section_index", "chunk_index", "chunk_id")
    relation = limited(by_relationship(graph.edges["RELATED_TO"], mention, entities, queries).join(info, "chunk_id"), k, "hops", "document_id", "chunk_index", "chunk_id")
    content = limited(limited(by_content(chunks, queries), 4 * k, F.desc("match_count"), "section_index", "chunk_index", "chunk_id").drop("rank"), k, F.desc("graph_score"), "chunk_index", "chunk_id")
    fields = ("rank", "chunk_id", "document_id", "section_index", "chunk_index", "graph_score")
    parts = [p.select("query_id", *fields).withColumn("_s", F.lit(i)) for i, p in enumerate((title, entity, topic, relation, content))]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    told = rows.groupBy("query_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("_s") == i, F.struct(*fields)))).alias(f"s{i}") for i in range(len(METHODS))))
    ids = lambda hits: F.transform(hits, lambda x: x["chunk_id"])
    fresh = lambda hits: F.filter(hits, lambda x: ~F.array_contains("seen", x["chunk_id"]))
    room = F.greatest(F.lit(k) - F.col("n"), F.lit(0))
    told = told.withColumn("kept", F.transform("s0", lambda x: F.struct(F.lit(0).alias("s"), x.alias("x")))).withColumns({"seen": ids("s0"), "n": F.size("s0")})
    told = told.withColumn("e", F.slice(fresh("s1"), F.lit(1), room * (1 if by_document else 2)))
    # A document's next best in turn; documents in the order of their best hit.
    turn = lambda x, i: F.size(F.filter(F.slice("e", F.lit(1), i), lambda y: y["document_id"] == x["document_id"]))
    first = lambda x: F.call_function("array_position", F.transform("e", lambda y: y["document_id"]), x["document_id"])
    dealt = F.col("e") if by_document else F.transform(F.array_sort(F.transform("e", lambda x, i: F.struct(turn(x, i).alias("t"), first(x).alias("f"), x.alias("x")))), lambda y: y["x"])
    told = told.withColumn("d", F.slice(dealt, F.lit(1), room)).withColumns({"kept": F.concat("kept", F.transform("d", lambda x: F.struct(F.lit(1).alias("s"), x.alias("x")))), "seen": F.concat("seen", ids("e")), "n": F.col("n") + F.size("d")})
    marked = lambda i: lambda x: F.struct(F.lit(i).alias("s"), x.alias("x"))
    for i in range(2, len(METHODS)):
        found = fresh(F.slice(f"s{i}", F.lit(1), room) if i < 4 else F.col(f"s{i}"))
        told = told.withColumn("d", found).withColumns({"kept": F.concat("kept", F.transform("d", marked(i))), "seen": F.concat("seen", ids("d")), "n": F.col("n") + F.size("d")})
    hits = told.select("query_id", F.explode("kept").alias("h")).select("query_id", "h.x.*", F.col("h.s").alias("strategy"), F.element_at(F.array(*(F.lit(m) for m in METHODS)), F.col("h.s") + 1).alias("retrieval_method"))
    return limited(hits.drop("rank"), k, F.desc("graph_score"), "chunk_index", "chunk_id")


def retrieve(chunks: DataFrame, graph: Graph, queries: DataFrame, k: int, seeds: int = 10) -> DataFrame:
    """The graph's hits for keywords: the cascade with twice the limit, then chunks that share entities with its first
    hits, half the limit, which it has not found. Title matches score at least 0.9, entity mentions 0.7, traversal 0.8;
    hits without text are left out."""
    found = cascade(chunks, graph, queries, 2 * k)
    base = F.when(F.col("retrieval_method") == "section_title_match", F.greatest("graph_score", F.lit(0.9))).when(F.col("retrieval_method") == "entity_mention", F.greatest("graph_score", F.lit(0.7))).otherwise(F.coalesce("graph_score", F.lit(0.8)))
    direct = materialize(found.select("query_id", "chunk_id", "rank", base.alias("score"), "retrieval_method"))
    near = shared_entities(graph.edges["MENTIONS"], direct.where(F.col("rank") <= seeds).select("query_id", "chunk_id"))
    near = near.join(direct.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").join(chunks.select("chunk_id", "section_index", "chunk_index"), "chunk_id")
    near = limited(near, max(1, k // 2), F.desc("shared_entities"), "section_index", "chunk_index", "chunk_id")
    near = near.select("query_id", "chunk_id", (F.col("rank") + 2 * k).alias("rank"), F.lit(0.8).alias("score"), F.lit("graph_traversal").alias("retrieval_method"))
    every = direct.unionByName(near).join(chunks.where(F.trim("content") != "").select("chunk_id"), "chunk_id", "left_semi")
    return limited(every.drop("rank").withColumn("_at", F.when(F.col("retrieval_method") == "graph_traversal", 1).otherwise(0)), 3 * k, F.desc("score"), "_at", "chunk_id").drop("_at")


def of_document(chunks: DataFrame, document_id: str, limit: int = 50) -> DataFrame:
    return chunks.where(F.col("document_id") == document_id).orderBy("section_index", "chunk_index").limit(limit)


def of_section(chunks: DataFrame, section_id: str, limit: int = 50) -> DataFrame:
    return chunks.where(F.col("section_id") == section_id).orderBy("chunk_index").limit(limit)


def method_counts(hits: DataFrame) -> DataFrame:
    """Hits of each query by how they were found."""
    return hits.groupBy("query_id", "retrieval_method").agg(F.count("*").alias("n"))


def places_found(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """Distinct sections and documents that the hits of each query come from."""
    return hits.groupBy(by).agg(F.count_distinct("section_id").alias("sections"), F.count_distinct("document_id").alias("documents"), F.count("*").alias("n"))


def topics_found(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """Distinct topics of the hits of each query (query_id, chunk_id, topic)."""
    return hits.groupBy(by).agg(F.count_distinct("topic").alias("topics"), F.count_distinct("chunk_id").alias("n"))


def attach_media(hits: DataFrame, has_media: DataFrame, media: DataFrame) -> DataFrame:
    """hits with the media of image chunks as an array."""
    wanted = hits.where("chunk_type = 'image'").select("chunk_id").distinct()
    held = has_media.join(wanted, has_media["src"] == wanted["chunk_id"], "left_semi").join(media.withColumnRenamed("media_id", "dst"), "dst")
    found = held.groupBy(F.col("src").alias("chunk_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("dst").alias("media_id"), "media_url", "caption"))).alias("media"))
    return hits.join(found, "chunk_id", "left")


def diagnostics(graph: Graph, sections: int = 20) -> tuple[DataFrame, DataFrame]:
    """Counts of chunks with and without content, and the first sections of each document."""
    counts = graph.nodes["Chunk"].agg(F.count("*").alias("chunks"), F.count_if(F.coalesce("content", F.lit("")) != "").alias("with_content"), F.count_if(F.coalesce("content", F.lit("")) == "").alias("without_content"))
    w = Window.partitionBy("document_id").orderBy("section_index")
    return counts, graph.nodes["Section"].withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= sections).drop("_n")
