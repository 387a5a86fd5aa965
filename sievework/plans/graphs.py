"""Graph queries and life cycle of stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import graph, lifecycle
from sievework.plans.common import read


def _bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for chunks, the parts they ordered for entities."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("src"))
    return read(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("src", F.col("l_partkey").alias("dst")).agg(F.sum("l_quantity").alias("importance"))


def _seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("q1", 1), ("q1", 2), ("q2", 7)], "query_id string, chunk_id long")


def shared_entity_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.shared_entities(_bought(spark, sf_dir), _seeds(spark))
    return graph.limited(found, 20, F.desc("shared_entities"), "chunk_id").select("query_id", "rank", "chunk_id", "shared_entities")


def related_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.limited(graph.related_chunks(_bought(spark, sf_dir), _seeds(spark)), 20, F.desc("shared_count"), "chunk_id").select("query_id", "rank", "chunk_id", "shared_count")


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers stand next to their nation, nations next to their region."""
    edge = lambda t, a, x, b, y: read(spark, sf_dir, t).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"))
    return edge("supplier", "s", "s_suppkey", "n", "s_nationkey").union(edge("customer", "c", "c_custkey", "n", "c_nationkey")).union(edge("nation", "n", "n_nationkey", "r", "n_regionkey"))


def entity_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = spark.createDataFrame([("q1", "s1"), ("q2", "r2")], "query_id string, name string")
    return graph.entity_hops(_related(spark, sf_dir), starts, 3).withColumn("score", F.round(graph.hop_score(F.col("hops")), 6))


def by_relationship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that mention customers near a nation that a keyword names."""
    mention = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dst"))
    names = _related(spark, sf_dir).select(F.col("dst").alias("normalized_name")).distinct()
    words = spark.createDataFrame([("q1", ["N3", "none"]), ("q2", ["r1"])], "query_id string, keywords array<string>")
    found = graph.by_relationship(_related(spark, sf_dir), mention, names, words)
    return graph.limited(found, 15, "hops", "chunk_id").select("query_id", "rank", "chunk_id", "hops", F.round("graph_score", 6).alias("graph_score"))


def by_entity_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chunks, part names as entities."""
    parts = read(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("normalized_name"), F.col("p_name").alias("entity_name"))
    mention = read(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("src"), F.col("normalized_name").alias("dst"))
    words = spark.createDataFrame([("q1", ["WIDGET"]), ("q2", ["red", "hot"])], "query_id string, keywords array<string>")
    return graph.limited(graph.by_entity_mention(mention, parts, words), 25, F.desc("match_count"), "chunk_id").select("query_id", "rank", "chunk_id", "match_count", "graph_score")


def by_entity_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("normalized_name"), F.col("p_name").alias("entity_name"))
    mention = read(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("src"), F.col("normalized_name").alias("dst"), F.col("l_quantity").alias("importance"))
    names = parts.where("p_partkey IN (1, 5)").select(F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("query_id"), "entity_name")
    return graph.by_entity(mention, parts, names).groupBy("query_id", "chunk_id").agg(F.max("importance").alias("importance"))


def cross_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("q1", " 10"), ("q1", "20 "), ("q2", "33")], "query_id string, entity_name string")
    mention = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").cast("string").alias("dst"))
    return graph.by_entities_across(mention, names)


def topic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments stand for topics of customers."""
    seg = F.lower("c_mktsegment")
    topics = read(spark, sf_dir, "customer").select(seg.alias("normalized_name"), F.initcap("c_mktsegment").alias("topic_name"), F.array(F.substring("c_mktsegment", 1, 4)).alias("keywords")).distinct()
    has = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), seg.alias("dst"), F.when(F.pmod("c_custkey", F.lit(2)) == 0, 0.8).alias("relevance"))
    words = spark.createDataFrame([("q1", ["BUILD", "x"]), ("q2", ["e"])], "query_id string, keywords array<string>")
    return graph.limited(graph.by_topic(topics, has, words), 30, F.desc("graph_score"), "chunk_id").select("query_id", "rank", "chunk_id", "topic", F.round("graph_score", 6).alias("graph_score"))


def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of orders to customers; those without both ends are not written, later ones win."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dst"), F.pmod("o_orderkey", F.lit(5000)).alias("src"), F.col("o_totalprice").alias("weight"), "o_orderkey")
    old = o.where("o_orderkey < 5000").drop("o_orderkey")
    new = o.where("o_orderkey >= 5000").groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    some = read(spark, sf_dir, "customer").where("c_nationkey < 20")
    return graph.upsert_edges(old.groupBy("src", "dst").agg(F.max("weight").alias("weight")), new, o.select("src"), some, "src", "c_custkey")


def node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by lower-cased segment: the id of the first, the name of the last."""
    c = read(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("normalized_name"), F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("entity_name"))
    old = c.groupBy("normalized_name").agg(F.min("entity_id").alias("entity_id"), F.min_by("entity_name", "entity_id").alias("entity_name"))
    new = c.where("entity_id % 3 = 0").groupBy("normalized_name").agg(F.max("entity_id").alias("entity_id"), F.max_by("entity_name", "entity_id").alias("entity_name"))
    return graph.upsert_nodes(old, new, "normalized_name", keep=("entity_id",))


def graph_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph.Graph({"Customer": read(spark, sf_dir, "customer"), "Part": read(spark, sf_dir, "part")}, {"BOUGHT": _bought(spark, sf_dir)})
    return graph.census(g)


def content_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with and without content: long texts count as empty here."""
    docs = read(spark, sf_dir, "documents").select(F.when(F.length("text") < 1000, F.col("text")).alias("content"))
    empty = spark.createDataFrame([], "document_id string, section_index int")
    return graph.diagnostics(graph.Graph({"Chunk": docs, "Section": empty}))[0]


def orphan_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent or a low order above 450,000."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    large = read(spark, sf_dir, "orders").where("o_totalprice > 450000")
    return lifecycle.orphans(c, "c_custkey", (large.where("o_orderpriority = '1-URGENT'"), "o_custkey"), (large.where("o_orderpriority = '5-LOW'"), "o_custkey"))


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one nation with their orders and lines: what goes from each table."""
    gone = read(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("document_id"))
    store = {
        "documents": read(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "document_id"),
        "chunks": read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("chunk_id")),
        "postings": read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), "l_linenumber"),
    }
    return lifecycle.delete_counts(store, lifecycle.delete_documents(store, gone))


def set_null_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = read(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return lifecycle.set_null(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), gone, "s_nationkey")


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.col("o_orderpriority").alias("priority"))
    return lifecycle.upsert_latest(o.where("o_orderkey % 2 = 0").withColumn("at", F.struct("o_orderdate", "o_orderkey")), o.where("o_orderkey % 2 = 1").withColumn("at", F.struct("o_orderdate", "o_orderkey")), ["o_custkey"], "at").select("o_custkey", "o_orderkey", "priority")


def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lifecycle.delete_where(read(spark, sf_dir, "documents"), (F.col("source") == "src0") | (F.col("lang") == "de"))
    return left.groupBy("source").agg(F.count("*").alias("n"))


def label_join_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))


QUERIES = {f.__name__: f for f in (shared_entity_traversal, related_chunks, entity_hops, by_relationship, by_entity_mention, by_entity_exact, cross_document, topic_search, edge_upsert, node_upsert, graph_census, content_counts, orphan_antijoin, cascade_delete, set_null_refs, upsert_latest, delete_where, label_join_quality)}

_BOUGHT = "b AS (SELECT o_custkey AS src, l_partkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), s(query_id, seed) AS (VALUES ('q1', 1), ('q1', 2), ('q2', 7))"
_REL = """r AS (SELECT 's' || s_suppkey AS a, 'n' || s_nationkey AS b FROM supplier UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
e AS (SELECT a, b FROM r UNION SELECT b, a FROM r)"""
_WALK = "w AS (SELECT query_id, start, start AS name, 0 AS hops FROM st UNION SELECT w.query_id, w.start, e.b, w.hops + 1 FROM w JOIN e ON e.a = w.name WHERE w.hops < {n})"

ORACLES = {
    "shared_entity_traversal": f"""WITH {_BOUGHT}, e AS (SELECT DISTINCT query_id, dst FROM b JOIN s ON src = seed)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n DESC, src) AS INTEGER) AS rank, src AS chunk_id, n AS shared_entities
FROM (SELECT query_id, src, count(DISTINCT dst) AS n FROM b JOIN e USING (dst) WHERE (query_id, src) NOT IN (SELECT query_id, seed FROM s) GROUP BY ALL) QUALIFY rank <= 20""",
    "related_chunks": f"""WITH {_BOUGHT}, e AS (SELECT query_id, seed, dst FROM b JOIN s ON src = seed)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n DESC, src) AS INTEGER) AS rank, src AS chunk_id, n AS shared_count
FROM (SELECT query_id, src, count(*) AS n FROM b JOIN e USING (dst) WHERE src <> seed GROUP BY ALL) QUALIFY rank <= 20""",
    "entity_hops": f"""WITH RECURSIVE {_REL}, st(query_id, start) AS (VALUES ('q1', 's1'), ('q2', 'r2')), {_WALK.format(n=3)}
SELECT query_id, start, name, CAST(min(hops) AS INTEGER) AS hops, CAST(round(greatest(0.6, 0.8 - 0.1 * min(hops)), 6) AS DOUBLE) AS score FROM w GROUP BY ALL HAVING min(hops) > 0""",
    "by_relationship": f"""WITH RECURSIVE {_REL}, st(query_id, start) AS (VALUES ('q1', 'n3'), ('q2', 'r1')), {_WALK.format(n=2)},
h AS (SELECT query_id, o_orderkey AS chunk_id, CAST(min(hops) AS INTEGER) AS hops FROM (SELECT query_id, name, min(hops) AS hops FROM w GROUP BY ALL HAVING min(hops) > 0) JOIN orders ON name = 'c' || o_custkey GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hops, chunk_id) AS INTEGER) AS rank, chunk_id, hops, CAST(round(greatest(0.6, 0.8 - 0.1 * hops), 6) AS DOUBLE) AS graph_score FROM h QUALIFY rank <= 15""",
    "by_entity_mention": """WITH q AS (SELECT * FROM (VALUES ('q1', ['widget']), ('q2', ['red', 'hot'])) AS q(query_id, kw)),
h AS (SELECT query_id, l_orderkey AS chunk_id, count(DISTINCT lower(p_name)) AS match_count FROM q, part JOIN lineitem ON l_partkey = p_partkey WHERE len(list_filter(kw, lambda w: contains(lower(p_name), w))) > 0 GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY match_count DESC, chunk_id) AS INTEGER) AS rank, chunk_id, match_count, 0.7::DOUBLE AS graph_score FROM h QUALIFY rank <= 25""",
    "by_entity_exact": """WITH n AS (SELECT 'q' || p_partkey AS query_id, p_name FROM part WHERE p_partkey IN (1, 5))
SELECT query_id, l_orderkey AS chunk_id, max(l_quantity) AS importance FROM n JOIN (SELECT DISTINCT p_name, lower(p_name) AS low FROM part) x USING (p_name) JOIN part p ON lower(p.p_name) = low JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL""",
    "cross_document": "SELECT query_id, l_orderkey AS chunk_id, count(DISTINCT l_partkey) AS entity_matches, 0.85::DOUBLE AS graph_score FROM lineitem JOIN (VALUES ('q1', 10), ('q1', 20), ('q2', 33)) AS n(query_id, k) ON l_partkey = k GROUP BY ALL",
    "topic_search": """WITH q AS (SELECT * FROM (VALUES ('q1', ['build', 'x']), ('q2', ['e'])) AS q(query_id, kw)),
h AS (SELECT query_id, c_custkey AS chunk_id, lower(c_mktsegment) AS topic, 0.75 + 0.15 * CASE WHEN c_custkey % 2 = 0 THEN 0.8 ELSE 0.5 END AS g FROM q, customer WHERE len(list_filter(kw, lambda w: contains(lower(c_mktsegment), w))) > 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY g DESC, chunk_id) AS INTEGER) AS rank, chunk_id, topic, CAST(round(g, 6) AS DOUBLE) AS graph_score FROM h QUALIFY rank <= 30""",
    "edge_upsert": """WITH o AS (SELECT o_custkey AS dst, o_orderkey % 5000 AS src, o_totalprice AS weight, o_orderkey FROM orders),
a AS (SELECT src, dst, max(weight) AS w FROM o WHERE o_orderkey < 5000 GROUP BY ALL), b AS (SELECT src, dst, max(weight) AS w FROM o WHERE o_orderkey >= 5000 AND dst IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20) GROUP BY ALL)
SELECT src, dst, coalesce(b.w, a.w) AS weight FROM a FULL OUTER JOIN b USING (src, dst)""",
    "node_upsert": "SELECT lower(c_mktsegment) AS normalized_name, min(c_custkey) AS entity_id, coalesce(arg_max(c_name, c_custkey) FILTER (c_custkey % 3 = 0), arg_min(c_name, c_custkey)) AS entity_name FROM customer GROUP BY 1",
    "graph_census": "SELECT 'node' AS kind, 'Customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'node', 'Part', count(*) FROM part UNION ALL SELECT 'edge', 'BOUGHT', count(*) FROM (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "content_counts": "SELECT count(*) AS chunks, count(*) FILTER (length(text) BETWEEN 1 AND 999) AS with_content, count(*) FILTER (length(text) NOT BETWEEN 1 AND 999) AS without_content FROM documents",
    "orphan_antijoin": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000 AND o_orderpriority IN ('1-URGENT', '5-LOW'))",
    "cascade_delete": """WITH g AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT * FROM g))
SELECT 'documents' AS name, count(*) AS deleted FROM g UNION ALL SELECT 'chunks', count(*) FROM o UNION ALL SELECT 'postings', count(*) FROM lineitem WHERE l_orderkey IN (SELECT * FROM o)""",
    "set_null_refs": "SELECT s_suppkey, CASE WHEN s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN s_nationkey END AS s_nationkey FROM supplier",
    "upsert_latest": "SELECT o_custkey, o_orderkey, o_orderpriority AS priority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "delete_where": "SELECT source, count(*) AS n FROM documents WHERE NOT (source = 'src0' OR lang = 'de') GROUP BY source",
    "label_join_quality": "SELECT lang, count(*) AS n, count(quality) AS labelled, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
}
