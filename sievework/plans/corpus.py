"""Queries over a small corpus of chunks, sections, entities and topics made of the conversations table: reads and writes
of the graph, the keyword cascade, graph retrieval and the life cycle of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import entities, graph, lifecycle, sections
from sievework.plans.common import read

#: Hits of the cascade.
K = 12


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are documents, turns chunks; a user's turn heads a section and titles it."""
    rows = read(spark, sf_dir, "conversations").withColumn("chunk_id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    rows = sections.titled(rows, F.when(F.col("role") == "user", F.left("text", F.lit(20))), "conv_id", "turn")
    document = F.concat(F.lit("d"), F.col("conv_id").cast("string"))
    return rows.select("chunk_id", document.alias("document_id"), F.concat(document, F.lit("/"), F.col("section_index").cast("string")).alias("section_id"), "section_title", "section_index", F.col("turn").cast("int").alias("chunk_index"), F.col("text").alias("content"), F.lit("text").alias("chunk_type"))


def corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, graph.Graph]:
    """Entities are words of nine letters or more; topics are the titles of sections."""
    c = chunks(spark, sf_dir)
    mention = c.select(F.col("chunk_id").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit("([a-z]{9,})"), 1))).alias("dst"))
    names = mention.select(F.col("dst").alias("normalized_name")).distinct()
    title = F.lower(F.trim("section_title"))
    topic = c.groupBy(title.alias("normalized_name")).agg(F.min("section_title").alias("topic_name")).withColumn("keywords", F.split("normalized_name", " "))
    g = graph.empty(spark)
    g.nodes |= {
        "Document": c.select("document_id").distinct(),
        "Section": c.select("section_id", "document_id", F.col("section_title").alias("title"), "section_index").distinct(),
        "Chunk": c.select("chunk_id", "document_id", "content", "chunk_index", "chunk_type"),
        "Entity": names.withColumn("entity_name", F.initcap("normalized_name")),
        "Topic": topic,
    }
    g.edges |= {
        "HAS_SECTION": c.select(F.col("document_id").alias("src"), F.col("section_id").alias("dst")).distinct(),
        "HAS_CHUNK": c.select(F.col("section_id").alias("src"), F.col("chunk_id").alias("dst")),
        "NEXT_CHUNK": sections.next_chunks(c, ["document_id"], "chunk_index"),
        "MENTIONS": mention,
        "RELATED_TO": entities.related(mention).select("src", "dst"),
        "HAS_TOPIC": c.select(F.col("chunk_id").alias("src"), title.alias("dst"), F.when(F.pmod("chunk_index", F.lit(2)) == 0, 0.8).alias("relevance")),
    }
    return c, g


def keywords(spark: SparkSession, g: graph.Graph) -> DataFrame:
    """Parts of words, and the first and last names of entities."""
    ends = g.nodes["Entity"].agg(F.min("normalized_name").alias("a"), F.max("normalized_name").alias("b")).select(F.lit("q2").alias("query_id"), F.array("a", "b").alias("keywords"))
    return spark.createDataFrame([("q1", ["tion", "HERE"]), ("q3", ["zzzz"])], "query_id string, keywords array<string>").unionByName(ends)


def chunk_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir)[1].chunks_in_order().select("document_id", "section_id", "section_title", "section_index", "chunk_id", "chunk_index")


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.of_document(chunks(spark, sf_dir), "d3").select("chunk_id", "section_index", "chunk_index")


def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.of_section(chunks(spark, sf_dir), "d3/0", 2).select("chunk_id", "chunk_index")


def keyword_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, g = corpus(spark, sf_dir)
    found = graph.cascade(c, g, keywords(spark, g), K)
    return found.select("query_id", "rank", "chunk_id", "retrieval_method", F.round("graph_score", 6).alias("graph_score"))


def graph_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cascade of twice the limit, then traversal from its first ten hits."""
    c, g = corpus(spark, sf_dir)
    found = graph.retrieve(c, g, keywords(spark, g), K // 2)
    return found.select("query_id", "rank", "chunk_id", "retrieval_method", F.round("score", 6).alias("score"))


def method_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, g = corpus(spark, sf_dir)
    return graph.method_counts(graph.cascade(c, g, keywords(spark, g), K))


def places_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections, documents and topics that hits come from."""
    c, g = corpus(spark, sf_dir)
    asked = keywords(spark, g)
    places = graph.places_found(graph.by_section_title(c, asked))
    return places.join(graph.topics_found(graph.by_topic(g.nodes["Topic"], g.edges["HAS_TOPIC"], asked)).withColumnRenamed("n", "topic_chunks"), "query_id", "full")


def graph_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.samples(corpus(spark, sf_dir)[1])


def first_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.diagnostics(corpus(spark, sf_dir)[1], 2)[1].select("section_id", "document_id", "title", "section_index")


def _media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pictures for each assistant's turn; captions are the turn's first words, or none."""
    c = chunks(spark, sf_dir).where("chunk_index % 3 = 1").withColumn("image_index", F.explode(F.array(F.lit(1), F.lit(2))))
    kind = F.when(F.col("image_index") == 1, F.lit("chart"))
    return c.select(F.concat_ws("#", "chunk_id", F.col("image_index").cast("string")).alias("id"), "chunk_id", "document_id", kind.alias("image_type"), F.concat(F.lit("img/"), "chunk_id", F.lit(".png")).alias("image_path"), F.when(F.col("image_index") == 2, F.left("content", F.lit(60))).alias("caption"), F.when(F.col("image_index") == 1, F.col("content")).alias("extracted_text"), (F.col("chunk_index") * 100).alias("width"), F.when(F.col("image_index") == 1, F.lit(7)).alias("page"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, g = corpus(spark, sf_dir)
    return g.edges["MENTIONS"].join(c.select(F.col("chunk_id").alias("src"), "document_id"), "src").select("document_id", F.col("dst").alias("normalized_name")).distinct()


def media_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media nodes with their defaults, and how many edges each has."""
    media, held, named = entities.media_of(_media(spark, sf_dir), _names(spark, sf_dir))
    n = named.groupBy(F.col("src").alias("media_id")).agg(F.count("*").alias("names"))
    h = held.groupBy(F.col("dst").alias("media_id")).agg(F.count("*").alias("chunks"))
    return media.join(n, "media_id", "left").join(h, "media_id", "left").select("media_id", "media_type", "media_url", "caption", "alt_text", F.get_json_object("metadata", "$.width").alias("width"), F.get_json_object("metadata", "$.page").alias("page"), "names", "chunks")


def media_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of image chunks with their media; others have none."""
    media, held, _ = entities.media_of(_media(spark, sf_dir), _names(spark, sf_dir))
    hits = chunks(spark, sf_dir).select("chunk_id", F.when(F.col("chunk_index") % 2 == 1, "image").otherwise("text").alias("chunk_type"))
    return graph.attach_media(hits, held, media).select("chunk_id", "chunk_type", F.array_join(F.transform("media", lambda m: m["media_id"]), ",").alias("media"))


def graph_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents written as nodes and edges; chunks without an index or a content get the defaults."""
    c = chunks(spark, sf_dir)
    inner = F.struct("chunk_id", F.when(F.col("chunk_index") % 4 > 0, F.col("content")).alias("content"), F.when(F.col("chunk_index") % 4 > 1, F.col("chunk_index")).alias("chunk_index"), F.lit(None).cast("string").alias("chunk_type"))
    per_section = c.groupBy("document_id", "section_id", "section_title", "section_index").agg(F.array_sort(F.collect_list(inner)).alias("chunks"))
    nested = per_section.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("section_index", "section_id", F.col("section_title").alias("title"), "chunks"))).alias("sections"))
    s, nodes, has_section, has_chunk = graph.sections_to_rows(nested)
    counts = [t.groupBy("document_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(k)) for k, t in (("section", s), ("chunk", nodes), ("empty", nodes.where("content = '' AND chunk_index = 0 AND chunk_type = 'text'")), ("has_section", has_section.withColumnRenamed("src", "document_id")))]
    counts.append(has_chunk.join(s.select(F.col("section_id").alias("src"), "document_id"), "src").groupBy("document_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit("has_chunk")))
    out = counts[0]
    for x in counts[1:]:
        out = out.unionByName(x)
    return out


def edge_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of each type with the properties that they lack filled in."""
    m = corpus(spark, sf_dir)[1].edges["MENTIONS"].groupBy("src").agg(F.min("dst").alias("dst"), F.count("*").cast("int").alias("n"))
    some = F.when(F.col("n") > 5, F.col("n"))
    related = graph.with_defaults(m.select("src", "dst", (some / 100).alias("confidence")), "RELATED_TO").select("src", "dst", F.lit("RELATED_TO").alias("kind"), F.round("confidence", 6).alias("weight"), F.col("context").alias("note"))
    mention = graph.with_defaults(m.select("src", "dst", some.alias("frequency")), "MENTIONS").select("src", "dst", F.lit("MENTIONS").alias("kind"), F.col("importance").alias("weight"), F.col("frequency").cast("string").alias("note"))
    about = graph.with_defaults(m.select("src", "dst"), "ABOUT").select("src", "dst", F.lit("ABOUT").alias("kind"), F.col("importance").alias("weight"), F.col("frequency").cast("string").alias("note"))
    return related.unionByName(mention).unionByName(about)


def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node for each document, with chunks or without, once."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("filename"), F.col("lang").alias("document_type"))
    return graph.document_nodes(docs.union(docs.where("document_id % 2 = 0")))


def graph_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each kind when every other document goes."""
    _, g = corpus(spark, sf_dir)
    gone = g.nodes["Document"].where("CAST(substr(document_id, 2) AS INT) % 2 = 0")
    left = lifecycle.delete_from_graph(g, gone)
    kept = graph.Graph({n: left.nodes[n] for n in ("Document", "Section", "Chunk", "Entity", "Topic")}, {n: left.edges[n] for n in ("HAS_SECTION", "HAS_CHUNK", "NEXT_CHUNK", "MENTIONS", "RELATED_TO", "HAS_TOPIC")})
    return graph.census(kept)


def orphan_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities without any edge, and those that only others relate to: mentions of some names are taken away."""
    _, g = corpus(spark, sf_dir)
    g.edges["MENTIONS"] = g.edges["MENTIONS"].where("dst < 'm'")
    g.edges["RELATED_TO"] = g.edges["RELATED_TO"].where("dst < 'r' AND src < 'r'")
    left, gone = lifecycle.clean_orphans(g)
    return gone.unionByName(left.nodes["Entity"].agg(F.count("*").alias("deleted")).select(F.lit("left").alias("step"), "deleted"))


def delete_everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges before all of them are deleted, and after."""
    _, g = corpus(spark, sf_dir)
    full = graph.Graph({n: g.nodes[n] for n in ("Chunk", "Entity")}, {"MENTIONS": g.edges["MENTIONS"]})
    bare = graph.Graph(lifecycle.delete_all(full.nodes), lifecycle.delete_all(full.edges))
    return graph.census(full).join(graph.census(bare).withColumnRenamed("n", "n_left"), ["kind", "name"])


def topics_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of each document by all tiers: titles, kinds of entities, and phrases where these are few."""
    c = chunks(spark, sf_dir)
    kinds = F.element_at(F.array(*(F.lit(k) for k in ("ORG", "PERSON", "LOC"))), (F.length("normalized_name") % 3 + 1).cast("int"))
    found = _names(spark, sf_dir).withColumn("entity_type", kinds)
    titles = c.select("document_id", "section_id", F.col("section_title").alias("title")).distinct()
    out = entities.topics(titles, found, c.withColumn("chunk_text", F.initcap("content")))
    return out.select("document_id", "normalized_name", "topic_name", F.array_join("keywords", " ").alias("keywords"))


QUERIES = {f.__name__: f for f in (chunk_chain, document_chunks, section_chunks, keyword_cascade, graph_retrieval, method_counts, places_found, graph_samples, first_sections, media_nodes, media_attach, graph_batch, edge_defaults, document_nodes, graph_delete, orphan_cleanup, delete_everything, topics_composed)}

_C = """t AS (SELECT *, conv_id || '-' || turn AS chunk_id FROM conversations),
s AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) - CASE WHEN first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'user' THEN 1 ELSE 0 END AS INTEGER) AS section_index FROM t),
c AS (SELECT 'd' || conv_id AS document_id, chunk_id, 'd' || conv_id || '/' || section_index AS section_id, section_index, CAST(turn AS INTEGER) AS chunk_index, text AS content,
  coalesce(first_value(CASE WHEN role = 'user' THEN left(text, 20) END IGNORE NULLS) OVER (PARTITION BY conv_id, section_index ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 'Document Content') AS section_title FROM s)"""
_M = "m AS (SELECT DISTINCT chunk_id AS src, unnest(regexp_extract_all(lower(content), '[a-z]{9,}')) AS dst FROM c)"
_R = "r AS (SELECT DISTINCT a.dst AS src, b.dst AS dst FROM m a JOIN m b ON a.src = b.src AND a.dst <> b.dst)"
_KW = "kw AS (SELECT 'q1' AS query_id, ['tion', 'here'] AS words UNION ALL SELECT 'q3', ['zzzz'] UNION ALL SELECT 'q2', [min(dst), max(dst)] FROM m), w AS (SELECT query_id, unnest(words) AS w FROM kw)"
_TITLE = "SELECT DISTINCT query_id, section_title FROM (SELECT DISTINCT section_title FROM c) JOIN w ON contains(lower(section_title), w)"
_TOPIC = "SELECT DISTINCT query_id, dst FROM (SELECT DISTINCT lower(trim(section_title)) AS dst FROM c) JOIN w ON contains(dst, w) OR len(list_filter(string_split(dst, ' '), lambda x: contains(x, w))) > 0"


def _cascade(k: int) -> str:
    left = lambda n: f"greatest(0, {k} - coalesce((SELECT n FROM {n} WHERE {n}.query_id = x.query_id), 0))"
    return f"""WITH {_C}, {_M}, {_R}, {_KW},
h0 AS (SELECT query_id, chunk_id, document_id, section_index, chunk_index, 0.9 AS g, row_number() OVER (PARTITION BY query_id ORDER BY section_index, chunk_index, chunk_id) AS r FROM c JOIN ({_TITLE}) USING (section_title) QUALIFY r <= {k}),
n0 AS (SELECT query_id, count(*) AS n FROM h0 GROUP BY ALL),
e0 AS (SELECT query_id, src AS chunk_id, count(DISTINCT dst) AS mc FROM m JOIN (SELECT DISTINCT query_id, dst FROM m JOIN w ON contains(dst, w)) USING (dst) GROUP BY ALL),
e1 AS (SELECT x.*, row_number() OVER (PARTITION BY query_id ORDER BY mc DESC, section_index, chunk_index, chunk_id) AS r FROM (SELECT e0.*, document_id, section_index, chunk_index FROM e0 JOIN c USING (chunk_id)) x WHERE (query_id, chunk_id) NOT IN (SELECT query_id, chunk_id FROM h0)),
e2 AS (SELECT * FROM e1 x WHERE r <= 2 * {left("n0")}),
e3 AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY r) AS turn, min(r) OVER (PARTITION BY query_id, document_id) AS first FROM e2),
e4 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn, first) AS p FROM e3),
h1 AS (SELECT query_id, chunk_id, document_id, section_index, chunk_index, 0.7 AS g FROM e4 x WHERE p <= {left("n0")}),
n1 AS (SELECT query_id, count(*) AS n FROM (SELECT query_id FROM h0 UNION ALL SELECT query_id FROM h1) GROUP BY ALL),
s1 AS (SELECT query_id, chunk_id FROM h0 UNION ALL SELECT query_id, chunk_id FROM e2),
t0 AS (SELECT query_id, c.chunk_id, document_id, section_index, chunk_index, CAST(0.75 AS DOUBLE) + CAST(0.15 AS DOUBLE) * CASE WHEN chunk_index % 2 = 0 THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS g FROM c JOIN ({_TOPIC}) ON dst = lower(trim(section_title))),
t1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g DESC, section_index, chunk_index, chunk_id) AS r FROM t0),
h2 AS (SELECT query_id, chunk_id, document_id, section_index, chunk_index, g FROM t1 x WHERE r <= {left("n1")} AND (query_id, chunk_id) NOT IN (SELECT query_id, chunk_id FROM s1)),
n2 AS (SELECT query_id, sum(n) AS n FROM (SELECT * FROM n1 UNION ALL SELECT query_id, count(*) FROM h2 GROUP BY ALL) GROUP BY ALL),
s2 AS (SELECT * FROM s1 UNION ALL SELECT query_id, chunk_id FROM h2),
r0 AS (SELECT DISTINCT query_id, w AS name FROM w JOIN (SELECT DISTINCT dst FROM m) ON dst = w),
r1 AS (SELECT DISTINCT query_id, name AS start, dst AS name FROM r0 JOIN r ON src = name WHERE dst <> name),
r2 AS (SELECT DISTINCT query_id, start, dst AS name FROM r1 JOIN r ON src = name WHERE dst <> start),
hops AS (SELECT query_id, name, min(h) AS h FROM (SELECT query_id, name, 1 AS h FROM r1 UNION ALL SELECT query_id, name, 2 FROM r2) GROUP BY ALL),
q0 AS (SELECT query_id, src AS chunk_id, min(h) AS h FROM hops JOIN m ON dst = name GROUP BY ALL),
q1 AS (SELECT q0.*, document_id, section_index, chunk_index, row_number() OVER (PARTITION BY query_id ORDER BY h, document_id, chunk_index, chunk_id) AS r FROM q0 JOIN c USING (chunk_id)),
h3 AS (SELECT query_id, chunk_id, document_id, section_index, chunk_index, greatest(CAST(0.6 AS DOUBLE), CAST(0.8 AS DOUBLE) - CAST(0.1 AS DOUBLE) * h) AS g FROM q1 x WHERE r <= {left("n2")} AND (query_id, chunk_id) NOT IN (SELECT query_id, chunk_id FROM s2)),
s3 AS (SELECT * FROM s2 UNION ALL SELECT query_id, chunk_id FROM h3),
o0 AS (SELECT query_id, chunk_id, document_id, section_index, chunk_index, len(list_filter(words, lambda x: contains(lower(content), x))) AS mc,
  (len(list_filter(words, lambda x: contains(lower(content), x))) + CAST(0.1 AS DOUBLE) * list_sum(list_transform(words, lambda x: (length(lower(content)) - length(replace(lower(content), x, ''))) // length(x)))) / len(words) AS g FROM c, kw),
o1 AS (SELECT * FROM o0 WHERE mc > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY mc DESC, section_index, chunk_index, chunk_id) <= {4 * k}),
o2 AS (SELECT * FROM o1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY g DESC, chunk_index, chunk_id) <= {k}),
h4 AS (SELECT query_id, chunk_id, document_id, section_index, chunk_index, g FROM o2 WHERE (query_id, chunk_id) NOT IN (SELECT query_id, chunk_id FROM s3)),
u AS (SELECT query_id, chunk_id, section_index, chunk_index, CAST(g AS DOUBLE) AS g, 'section_title_match' AS method FROM h0 UNION ALL SELECT query_id, chunk_id, section_index, chunk_index, g, 'entity_mention' FROM h1
  UNION ALL SELECT query_id, chunk_id, section_index, chunk_index, g, 'topic' FROM h2 UNION ALL SELECT query_id, chunk_id, section_index, chunk_index, g, 'entity_relationship' FROM h3 UNION ALL SELECT query_id, chunk_id, section_index, chunk_index, g, 'content' FROM h4),
found AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY g DESC, chunk_index, chunk_id) AS INTEGER) AS rank FROM u QUALIFY rank <= {k})"""


_MEDIA = f"""{_C}, {_M}, i AS (SELECT chunk_id || '#' || k AS id, chunk_id, document_id, chunk_index, content, k FROM c, (VALUES (1), (2)) AS v(k) WHERE chunk_index % 3 = 1),
names AS (SELECT DISTINCT document_id, dst FROM m JOIN c ON c.chunk_id = m.src)"""
_PHRASE = "'\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+){1,3})\\b'"
#: initcap() of texts whose words are parted by white space: the first letter of each upper, all others lower.
_INITCAP = "array_to_string(list_transform(string_split(%s, ' '), lambda x: upper(left(x, 1)) || lower(substr(x, 2))), ' ')"

ORACLES = {
    "chunk_chain": f"WITH {_C} SELECT document_id, section_id, section_title, section_index, chunk_id, chunk_index FROM c",
    "document_chunks": f"WITH {_C} SELECT chunk_id, section_index, chunk_index FROM c WHERE document_id = 'd3' ORDER BY section_index, chunk_index LIMIT 50",
    "section_chunks": f"WITH {_C} SELECT chunk_id, chunk_index FROM c WHERE section_id = 'd3/0' ORDER BY chunk_index LIMIT 2",
    "keyword_cascade": f"{_cascade(K)} SELECT query_id, rank, chunk_id, method AS retrieval_method, round(g, 6) AS graph_score FROM found",
    "method_counts": f"{_cascade(K)} SELECT query_id, method AS retrieval_method, count(*) AS n FROM found GROUP BY ALL",
    "graph_retrieval": f"""{_cascade(K)},
base AS (SELECT query_id, chunk_id, rank, method, CASE method WHEN 'section_title_match' THEN greatest(g, 0.9) WHEN 'entity_mention' THEN greatest(g, 0.7) ELSE g END AS score FROM found),
seeds AS (SELECT query_id, chunk_id FROM base WHERE rank <= 10),
shared AS (SELECT query_id, src AS chunk_id, count(DISTINCT dst) AS n FROM m JOIN (SELECT DISTINCT query_id, dst FROM m JOIN seeds ON src = chunk_id) USING (dst) GROUP BY ALL),
near AS (SELECT query_id, chunk_id FROM shared JOIN c USING (chunk_id) WHERE (query_id, chunk_id) NOT IN (SELECT query_id, chunk_id FROM base) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, section_index, chunk_index, chunk_id) <= {K // 4}),
every AS (SELECT query_id, chunk_id, score, method, 0 AS late FROM base UNION ALL SELECT query_id, chunk_id, 0.8, 'graph_traversal', 1 FROM near)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, late, chunk_id) AS INTEGER) AS rank, chunk_id, method AS retrieval_method, round(score, 6) AS score FROM every JOIN c USING (chunk_id) WHERE trim(content) <> '' QUALIFY rank <= {K // 2 * 3}""",
    "places_found": f"""WITH {_C}, {_M}, {_KW}, a AS (SELECT query_id, count(DISTINCT section_id) AS sections, count(DISTINCT document_id) AS documents, count(*) AS n FROM c JOIN ({_TITLE}) USING (section_title) GROUP BY ALL),
b AS (SELECT query_id, count(DISTINCT dst) AS topics, count(DISTINCT chunk_id) AS topic_chunks FROM c JOIN ({_TOPIC}) ON dst = lower(trim(section_title)) GROUP BY ALL)
SELECT query_id, sections, documents, n, topics, topic_chunks FROM a FULL JOIN b USING (query_id)""",
    "graph_samples": f"WITH {_C} SELECT left(chunk_id, 8) AS short_id, left(content, 100) AS preview FROM c WHERE content <> '' ORDER BY chunk_id LIMIT 5",
    "first_sections": f"WITH {_C} SELECT section_id, document_id, section_title AS title, section_index FROM (SELECT DISTINCT section_id, document_id, section_title, section_index FROM c) QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY section_index) <= 2",
    "media_nodes": f"""WITH {_MEDIA}
SELECT id AS media_id, CASE WHEN k = 1 THEN 'CHART' ELSE 'IMAGE' END AS media_type, 'img/' || chunk_id || '.png' AS media_url, CASE WHEN k = 2 THEN left(content, 60) ELSE '' END AS caption, CASE WHEN k = 1 THEN left(content, 200) ELSE left(content, 60) END AS alt_text,
  CAST(chunk_index * 100 AS VARCHAR) AS width, CASE WHEN k = 1 THEN '7' END AS page, nullif((SELECT count(*) FROM names n WHERE n.document_id = i.document_id AND k = 2 AND contains(lower(left(content, 60)), dst)), 0) AS names, 1::BIGINT AS chunks FROM i""",
    "media_attach": f"WITH {_C} SELECT chunk_id, CASE WHEN chunk_index % 2 = 1 THEN 'image' ELSE 'text' END AS chunk_type, CASE WHEN chunk_index % 2 = 1 AND chunk_index % 3 = 1 THEN chunk_id || '#1,' || chunk_id || '#2' END AS media FROM c",
    "graph_batch": f"""WITH {_C} SELECT document_id, count(DISTINCT section_id) AS n, 'section' AS kind FROM c GROUP BY ALL UNION ALL SELECT document_id, count(*), 'chunk' FROM c GROUP BY ALL UNION ALL SELECT document_id, count(*), 'empty' FROM c WHERE chunk_index % 4 = 0 GROUP BY ALL
UNION ALL SELECT document_id, count(DISTINCT section_id), 'has_section' FROM c GROUP BY ALL UNION ALL SELECT document_id, count(*), 'has_chunk' FROM c GROUP BY ALL""",
    "edge_defaults": f"""WITH {_C}, {_M}, x AS (SELECT src, min(dst) AS dst, count(*) AS n FROM m GROUP BY src)
SELECT src, dst, 'RELATED_TO' AS kind, round(CASE WHEN n > 5 THEN n / 100 ELSE 0.5 END, 6) AS weight, '' AS note FROM x UNION ALL SELECT src, dst, 'MENTIONS', 0.5, CAST(CASE WHEN n > 5 THEN n ELSE 1 END AS VARCHAR) FROM x UNION ALL SELECT src, dst, 'ABOUT', 0.5, '1' FROM x""",
    "document_nodes": "SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN doc_id % 3 > 0 THEN source ELSE 'unknown' END AS title, NULL::VARCHAR AS source_path, lang AS document_type FROM documents",
    "graph_delete": f"""WITH {_C}, {_M}, k AS (SELECT * FROM c WHERE CAST(substr(document_id, 2) AS INTEGER) % 2 = 1), km AS (SELECT * FROM m WHERE src IN (SELECT chunk_id FROM k)), {_R}
SELECT 'node' AS kind, 'Document' AS name, count(DISTINCT document_id) AS n FROM k UNION ALL SELECT 'node', 'Section', count(DISTINCT section_id) FROM k UNION ALL SELECT 'node', 'Chunk', count(*) FROM k
UNION ALL SELECT 'node', 'Entity', count(DISTINCT dst) FROM km UNION ALL SELECT 'node', 'Topic', count(DISTINCT lower(trim(section_title))) FROM k
UNION ALL SELECT 'edge', 'HAS_SECTION', count(DISTINCT section_id) FROM k UNION ALL SELECT 'edge', 'HAS_CHUNK', count(*) FROM k UNION ALL SELECT 'edge', 'NEXT_CHUNK', count(*) - count(DISTINCT document_id) FROM k
UNION ALL SELECT 'edge', 'MENTIONS', count(*) FROM km UNION ALL SELECT 'edge', 'RELATED_TO', count(*) FROM r WHERE src IN (SELECT dst FROM km) AND dst IN (SELECT dst FROM km) UNION ALL SELECT 'edge', 'HAS_TOPIC', count(*) FROM k""",
    "orphan_cleanup": f"""WITH {_C}, {_M}, {_R}, e AS (SELECT DISTINCT dst AS x FROM m), q AS (SELECT * FROM r WHERE src < 'r' AND dst < 'r')
SELECT 'without edges' AS step, count(*) AS deleted FROM e WHERE x >= 'm' AND x NOT IN (SELECT src FROM q) UNION ALL SELECT 'not mentioned', count(*) FROM e WHERE x >= 'm' AND x IN (SELECT src FROM q) UNION ALL SELECT 'left', count(*) FROM e WHERE x < 'm'""",
    "delete_everything": f"WITH {_C}, {_M} SELECT 'node' AS kind, 'Chunk' AS name, count(*) AS n, 0::BIGINT AS n_left FROM c UNION ALL SELECT 'node', 'Entity', count(DISTINCT dst), 0 FROM m UNION ALL SELECT 'edge', 'MENTIONS', count(*), 0 FROM m",
    "topics_composed": rf"""WITH {_C}, {_M}, a AS (
  SELECT DISTINCT document_id, regexp_replace(regexp_replace(trim(section_title), '^\d+(\.\d+)*\s+', ''), '(?i)^(Chapter|Section|Part)\s+[IVX\d]+:?\s*', '') AS name FROM c WHERE trim(section_title) NOT IN ('', 'Document Content', 'Tables')),
t0 AS (SELECT document_id, lower(trim(name)) AS n, min(name) AS name FROM a WHERE length(name) > 3 GROUP BY ALL),
tt AS (SELECT document_id, n, name, array_to_string(list_filter(string_split_regex(lower(name), '\s+'), lambda w: length(w) > 3), ' ') AS kw, 0 AS tier FROM t0),
e AS (SELECT DISTINCT document_id, dst FROM m JOIN c ON c.chunk_id = m.src),
k AS (SELECT document_id, CASE kind WHEN 0 THEN 'Organizations and Companies' ELSE 'People and Individuals' END AS name FROM (SELECT document_id, length(dst) % 3 AS kind, count(*) AS n FROM e GROUP BY ALL) WHERE n >= 3 AND kind < 2),
sure AS (SELECT * FROM tt UNION ALL SELECT document_id, lower(name), name, lower(name), 1 FROM k),
many AS (SELECT document_id FROM sure GROUP BY document_id HAVING count(DISTINCT n) >= 3),
heads AS (SELECT document_id, left({_INITCAP % 'content'}, 500) AS x FROM c WHERE document_id NOT IN (SELECT * FROM many) QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) <= 50),
p AS (SELECT document_id, name, count(*) AS f FROM (SELECT document_id, unnest(regexp_extract_all(x, {_PHRASE}, 1)) AS name FROM heads) GROUP BY ALL),
pp AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY f DESC, name) <= 10),
every AS (SELECT * FROM sure UNION ALL SELECT document_id, lower(name), name, array_to_string(string_split_regex(lower(name), '\s+'), ' '), 2 FROM pp WHERE f >= 3 AND length(name) > 8)
SELECT document_id, n AS normalized_name, arg_min(name, (tier, name)) AS topic_name, arg_min(kw, (tier, name)) AS keywords FROM every GROUP BY document_id, n""",
}
