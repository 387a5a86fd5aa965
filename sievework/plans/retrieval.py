"""BM25, dense, fused and graph retrieval over the test tables."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.text import STOP_WORDS, keywords
from sievework.operators import bm25, clusters, dense, fusion, graph, grams
from sievework.operators.segments import Segments
from sievework.plans.common import VALUES, questions, read
from sievework.session import shared_folder

BM25_SQL = f"""
q AS (SELECT * FROM {VALUES}),
tok AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM q) GROUP BY ALL),
post AS (SELECT term, id, dl, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (
  SELECT a.query_id, p.id, round(sum(a.qtf * ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / st.avgdl))), 9) AS score
  FROM post p JOIN asked a USING (term) JOIN df USING (term), st GROUP BY ALL)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search_texts(read(spark, sf_dir, "documents"), questions(spark))


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", F.round("score", 6))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.top(_rounded(scored(spark, sf_dir)), 50).select("query_id", "rank", F.col("id").alias("doc_id"), "score")


def _place(spark: SparkSession, docs: DataFrame, kind: str) -> str:
    """Where an index of docs lies beside the shared folder: by the names, sizes and times of its files, so that files
    written anew are indexed anew."""
    files = spark.read.format("binaryFile").load(docs.inputFiles()).select("path", "length", F.col("modificationTime").cast("string")).collect()  # names only
    return f"{shared_folder(spark).rpartition('/')[0]}/_{kind}/{hashlib.md5(repr(sorted(map(tuple, files))).encode()).hexdigest()}"


def _stored(spark: SparkSession, sf_dir: str, fresh: bool = False) -> Segments:
    """The index of documents; it is built where there is none."""
    docs = read(spark, sf_dir, "documents")
    path = _place(spark, docs, "index")
    index = Segments.open(spark, path)
    return index if index.rows and not fresh else Segments.open(spark, f"{path}/{uuid.uuid4().hex}" if fresh else path).upsert(docs)


def bm25_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest: the index is built, stored and counted."""
    return _stored(spark, sf_dir, fresh=True).statistics()


def _ranked(found: DataFrame, k: int = 50) -> DataFrame:
    return bm25.top(_rounded(found), k).select("query_id", "rank", F.col("id").alias("doc_id"), "score")


def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as bm25_topk from the stored index: of the questions' terms, only blocks that can win are read."""
    return _ranked(_stored(spark, sf_dir).search(questions(spark), 50))


def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of documents, of which every hundredth gets another text and every 97th is deleted, searched over its
    segments."""
    docs = read(spark, sf_dir, "documents")
    new = docs.where("doc_id % 100 = 3").select("doc_id", F.concat(F.lit("apache license "), "lang", F.lit(" "), "text").alias("text"))
    index = Segments(spark, shared_folder(spark)).upsert(docs).upsert(new)
    return _ranked(index.delete(docs.where("doc_id % 97 = 5").select(F.col("doc_id").alias("id"))).search(questions(spark), 50))


def index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of an index of three segments, with repeated ids and deletes, when they are one."""
    docs = read(spark, sf_dir, "documents")
    index = Segments(spark, shared_folder(spark)).upsert(docs.where("doc_id % 3 < 2")).upsert(docs.where("doc_id % 3 > 0"))
    index = index.delete(docs.where("source = 'src2'").select(F.col("doc_id").alias("id"))).upsert(docs.where("doc_id % 7 = 0").select("doc_id", F.col("lang").alias("text")))
    return index.merge().statistics()


def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = bm25.exact_filter(read(spark, sf_dir, "documents"), {"lang": "en", "source": "src0"}).select(F.col("doc_id").alias("id"))
    return _ranked(_stored(spark, sf_dir).search(questions(spark), 10, kept), 10)


def bm25_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best document of each source and question."""
    rows = _rounded(_stored(spark, sf_dir).search(questions(spark), None)).join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    return rows.groupBy("query_id", "source").agg(F.max("score").alias("best"), F.count("*").alias("n"))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index's totals, and its most frequent terms."""
    index = bm25.build(read(spark, sf_dir, "documents"))
    terms = index.terms.orderBy(F.desc("df"), "term").limit(100)
    return terms.crossJoin(F.broadcast(index.totals)).select("term", "df", "n", F.round("avgdl", 6).alias("avgdl"))


def vectors_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors 0 to 3 ask the questions q1 to q4."""
    return read(spark, sf_dir, "embeddings").where("vec_id < 4").select(F.concat(F.lit("q"), (F.col("vec_id") + 1).cast("string")).alias("query_id"), F.col("embedding").alias("vector"))


DENSE_SQL = """
dq AS (SELECT 'q' || CAST(vec_id + 1 AS VARCHAR) AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id < 4),
dn AS (SELECT dq.query_id, e.vec_id AS id, e.label, round(list_cosine_similarity(dq.v, CAST(e.embedding AS DOUBLE[])), 12) AS score FROM dq, embeddings e)
"""


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dense.search(read(spark, sf_dir, "embeddings"), vectors_asked(spark, sf_dir), 10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def dense_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bm25.exact_filter(read(spark, sf_dir, "embeddings"), {"label": "3"})
    found = dense.search(rows, vectors_asked(spark, sf_dir), 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def _lists(spark: SparkSession, sf_dir: str) -> clusters.Lists:
    """The lists of embeddings; they are built where there are none."""
    rows = read(spark, sf_dir, "embeddings")
    path = _place(spark, rows, "lists")
    try:
        return clusters.load(spark, path)
    except AnalysisException:
        return clusters.build(rows, f"{path}/{uuid.uuid4().hex}" if _there(spark, path) else path)


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a build at path was cut off."""
    try:
        return bool(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").limit(1).count())
    except AnalysisException:
        return False


def vector_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dense_topk from stored lists, all of them: the exact way."""
    lists = _lists(spark, sf_dir)
    found = lists.search(vectors_asked(spark, sf_dir), 10, probes=len(lists.centres))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def vector_lists_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dense_by_label from stored lists: the filter is in the scan."""
    lists = _lists(spark, sf_dir)
    found = lists.search(vectors_asked(spark, sf_dir), 5, where=F.col("label") == 3, probes=len(lists.centres))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def dense_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cosines in the JVM: mean, least and greatest by query and label."""
    every = dense.against(read(spark, sf_dir, "embeddings"), vectors_asked(spark, sf_dir))
    rows = every.join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    return rows.groupBy("query_id", "label").agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.min("score"), 6).alias("least"), F.round(F.max("score"), 6).alias("most"))


def hits(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """Sparse and dense hits; for tests, vector i belongs to document i."""
    sparse = bm25.top(_stored(spark, sf_dir).search(questions(spark), k), k, F.asc("id")).select("query_id", F.lit("sparse").alias("source"), "rank", F.col("id").alias("chunk_id"), "score")
    near = dense.search(read(spark, sf_dir, "embeddings"), vectors_asked(spark, sf_dir), k).select("query_id", F.lit("dense").alias("source"), "rank", F.col("id").alias("chunk_id"), "score")
    return sparse.unionByName(near)


def _fused(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "final_rank", "chunk_id", F.round("sparse_score", 6).alias("sparse_score"), F.round("dense_score", 6).alias("dense_score"), F.round("score", 6).alias("score"))


def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(fusion.fuse(hits(spark, sf_dir), 10))


def hybrid_no_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(fusion.fuse(hits(spark, sf_dir), 10, normalized=False))


def _hybrid_sql(sparse: str, dense_: str, score: str) -> str:
    return f"""
WITH {BM25_SQL}, {DENSE_SQL},
sp AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM bm QUALIFY r <= 20),
de AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM dn QUALIFY r <= 20),
m AS (SELECT query_id, id, sp.score AS s, de.score AS d, sp.r AS sr, de.r AS dr FROM sp FULL OUTER JOIN de USING (query_id, id)),
w AS (SELECT *, min(s) OVER q AS s0, max(s) OVER q AS s1, min(d) OVER q AS d0, max(d) OVER q AS d1 FROM m WINDOW q AS (PARTITION BY query_id)),
n AS (SELECT *, CASE WHEN s IS NULL THEN 0 ELSE (s - s0) / CASE WHEN s1 > s0 THEN s1 - s0 ELSE 1 END END AS sn, CASE WHEN d IS NULL THEN 0 ELSE (d - d0) / CASE WHEN d1 > d0 THEN d1 - d0 ELSE 1 END END AS dn FROM w),
f AS (SELECT *, round({score}, 9) AS score FROM n),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CASE WHEN sr IS NULL THEN 1 ELSE 0 END, coalesce(sr, dr), id) AS INTEGER) AS final_rank FROM f)
SELECT query_id, final_rank, id AS chunk_id, round(s, 6) AS sparse_score, round(d, 6) AS dense_score, round(score, 6) AS score FROM r WHERE final_rank <= 10
"""


def merge_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of merged hits by source priority: sources are dealt by document, texts are left out of some."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    kinds = F.array(F.lit("sparse"), F.lit("dense"), F.lit("table"), F.lit("image"), F.lit("graph"))
    rows = docs.select(F.lit("q").alias("query_id"), F.element_at(kinds, (F.pmod("doc_id", F.lit(5)) + 1).cast("int")).alias("source"), F.col("doc_id").cast("int").alias("rank"), F.floor(F.col("doc_id") / 3).alias("chunk_id"), (F.col("n_chars") / 1000).alias("score"), F.when(F.col("lang") == "en", F.col("source")).alias("filename"), F.lit("text").alias("chunk_type"))
    merged = fusion.merge(rows)
    return merged.select("chunk_id", "filename", "chunk_type", "src_prio", "src_rank", *(f"{s}_score" for s in fusion.SOURCES))


MERGE_SQL = """
WITH h AS (
  SELECT ['sparse', 'dense', 'table', 'image', 'graph'][doc_id % 5 + 1] AS source, doc_id % 5 AS prio, CAST(doc_id AS INTEGER) AS rank, doc_id // 3 AS chunk_id, n_chars / 1000 AS score, CASE WHEN lang = 'en' THEN source END AS filename
  FROM documents)
SELECT chunk_id, arg_min(filename, prio * 1000000000 + rank) FILTER (filename IS NOT NULL) AS filename,
  CASE WHEN bool_or(source = 'image') THEN 'image' WHEN bool_or(source = 'table') THEN 'table' ELSE 'text' END AS chunk_type,
  CAST(min(prio) AS INTEGER) AS src_prio, arg_min(rank, prio * 1000000000 + rank) AS src_rank,
  max(score) FILTER (source = 'sparse') AS sparse_score, max(score) FILTER (source = 'dense') AS dense_score, max(score) FILTER (source = 'table') AS table_score,
  max(score) FILTER (source = 'image') AS image_score, max(score) FILTER (source = 'graph') AS graph_score
FROM h GROUP BY chunk_id
"""


def _grams(spark: SparkSession, sf_dir: str) -> grams.Grams:
    """The trigram index of documents, with the number of its buckets in a row of its own; it is built where there is none."""
    docs = read(spark, sf_dir, "documents")
    path = _place(spark, docs, "grams")
    try:
        return grams.load(spark, f"{path}/rows", spark.read.schema("buckets int").json(f"{path}/done").first()["buckets"])
    except (AnalysisException, TypeError):  # not there, or not finished
        built = grams.build(docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), f"{path}/rows")
        spark.range(1).select(F.lit(built.buckets).alias("buckets")).coalesce(1).write.mode("overwrite").json(f"{path}/done")
        return built


def keyword_content_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = questions(spark).select("query_id", keywords(F.col("query")).alias("keywords")).where(F.size("keywords") > 0)
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    found = graph.by_content(docs, words, index=_grams(spark, sf_dir)).withColumn("graph_score", F.round("graph_score", 6))
    return graph.limited(found, 20, F.desc("graph_score"), "chunk_id").select("query_id", "rank", "chunk_id", "match_count", "graph_score")


STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
KEYWORDS_SQL = f"list_filter(list_transform(string_split_regex(regexp_replace(%s, '[^\\p{{L}}\\p{{N}}_\\s-]', ' ', 'g'), '\\s+'), lambda w: lower(w)), lambda w: length(w) > 2 AND NOT list_contains({STOPS}, w))[1:15]"

CONTENT_SQL = f"""
WITH q AS (SELECT query_id, {KEYWORDS_SQL % 'query'} AS kw FROM {VALUES}),
h AS (SELECT query_id, doc_id AS chunk_id, len(list_filter(kw, lambda w: contains(lower(text), w))) AS match_count,
  (len(list_filter(kw, lambda w: contains(lower(text), w))) + 0.1 * list_sum(list_transform(kw, lambda w: (length(lower(text)) - length(replace(lower(text), w, ''))) // length(w)))) / greatest(len(kw), 1) AS s
  FROM q, documents WHERE len(kw) > 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, chunk_id) AS INTEGER) AS rank, chunk_id, CAST(match_count AS INTEGER) AS match_count, round(s, 6) AS graph_score
FROM h WHERE match_count > 0 QUALIFY rank <= 20
"""


def keyword_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(keywords(F.col("text")), " ").alias("keywords"))


def round_robin_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_id"), "n_chars")
    return graph.round_robin(rows, 30, "document_id", F.desc("n_chars"), "chunk_id").select("query_id", "rank", "document_id", "chunk_id", "turn")


def relevance_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.streaming.telemetry import relevance

    rows = dense.against(read(spark, sf_dir, "embeddings"), vectors_asked(spark, sf_dir)).withColumnRenamed("id", "chunk_id").withColumns({"source": F.lit("dense"), "score": F.round("score", 9)})
    means, best = relevance(rows)
    return best.groupBy("query_id", "source").agg(F.round(F.avg("score"), 6).alias("top5")).join(means, ["query_id", "source"]).select("query_id", "source", F.round("avg_score", 6).alias("avg_score"), "n", "top5")


QUERIES = {
    "bm25_topk": bm25_topk,
    "bm25_build": bm25_build,
    "bm25_index": bm25_index,
    "index_upsert": index_upsert,
    "index_merge": index_merge,
    "bm25_filtered": bm25_filtered,
    "bm25_by_source": bm25_by_source,
    "corpus_stats": corpus_stats,
    "dense_topk": dense_topk,
    "dense_by_label": dense_by_label,
    "vector_lists": vector_lists,
    "vector_lists_filtered": vector_lists_filtered,
    "dense_scan": dense_scan,
    "hybrid_fusion": hybrid_fusion,
    "hybrid_no_norm": hybrid_no_norm,
    "merge_attributes": merge_attributes,
    "keyword_content_search": keyword_content_search,
    "keyword_extract": keyword_extract,
    "round_robin_diversity": round_robin_diversity,
    "relevance_telemetry": relevance_telemetry,
}

_TOP = "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS INTEGER) AS rank, id AS doc_id, round(score, 6) AS score FROM bm"
_NEAR = "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS vec_id, round(score, 6) AS score FROM dn"
_CHANGED = BM25_SQL.replace("lower(coalesce(text, ''))", "lower(CASE WHEN doc_id % 100 = 3 THEN 'apache license ' || lang || ' ' || text ELSE coalesce(text, '') END)").replace("FROM documents)", "FROM documents WHERE doc_id % 97 <> 5)")

ORACLES = {
    "bm25_topk": f"WITH {BM25_SQL} {_TOP} QUALIFY rank <= 50",
    "bm25_index": f"WITH {BM25_SQL} {_TOP} QUALIFY rank <= 50",
    "bm25_build": f"""WITH {BM25_SQL}, p AS (SELECT DISTINCT id, unnest(t) AS term FROM tok)
SELECT 'documents' AS name, count(*) AS n FROM tok UNION ALL SELECT 'tokens', CAST(sum(len(t)) AS BIGINT) FROM tok UNION ALL SELECT 'postings', count(*) FROM p UNION ALL SELECT 'terms', count(DISTINCT term) FROM p
UNION ALL SELECT 'term characters', CAST(sum(length(term)) AS BIGINT) FROM (SELECT DISTINCT term FROM p)""",
    "index_upsert": f"WITH {_CHANGED} {_TOP} QUALIFY rank <= 50",
    "index_merge": f"""WITH w AS (SELECT regexp_extract_all(lower(coalesce(CASE WHEN doc_id % 7 = 0 THEN lang ELSE text END, '')), '[\\p{{L}}\\p{{N}}_]+') AS t FROM documents WHERE doc_id % 7 = 0 OR source <> 'src2'),
p AS (SELECT DISTINCT row, unnest(t) AS term FROM (SELECT row_number() OVER () AS row, t FROM w))
SELECT 'documents' AS name, count(*) AS n FROM w UNION ALL SELECT 'tokens', CAST(sum(len(t)) AS BIGINT) FROM w UNION ALL SELECT 'postings', count(*) FROM p UNION ALL SELECT 'terms', count(DISTINCT term) FROM p
UNION ALL SELECT 'term characters', CAST(sum(length(term)) AS BIGINT) FROM (SELECT DISTINCT term FROM p)""",
    "bm25_filtered": f"WITH {BM25_SQL} {_TOP} WHERE id IN (SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src0') QUALIFY rank <= 10",
    "bm25_by_source": f"WITH {BM25_SQL} SELECT query_id, source, max(round(score, 6)) AS best, count(*) AS n FROM bm JOIN documents ON id = doc_id GROUP BY ALL",
    "corpus_stats": f"WITH {BM25_SQL} SELECT term, df, n, round(avgdl, 6) AS avgdl FROM (SELECT term, count(DISTINCT id) AS df FROM (SELECT id, unnest(t) AS term FROM tok) GROUP BY term ORDER BY df DESC, term LIMIT 100), st",
    "dense_topk": f"WITH {DENSE_SQL} {_NEAR} QUALIFY rank <= 10",
    "dense_by_label": f"WITH {DENSE_SQL} {_NEAR} WHERE label = 3 QUALIFY rank <= 5",
    "vector_lists": f"WITH {DENSE_SQL} {_NEAR} QUALIFY rank <= 10",
    "vector_lists_filtered": f"WITH {DENSE_SQL} {_NEAR} WHERE label = 3 QUALIFY rank <= 5",
    "dense_scan": f"WITH {DENSE_SQL} SELECT query_id, label, round(avg(score), 6) AS mean, round(min(score), 6) AS least, round(max(score), 6) AS most FROM dn GROUP BY ALL",
    "hybrid_fusion": _hybrid_sql("sn", "dn", "0.25 * sn + 0.25 * dn"),
    "hybrid_no_norm": _hybrid_sql("s", "d", "(coalesce(s, 0) * 0.25 + coalesce(d, 0) * 0.25) / (CASE WHEN s IS NOT NULL THEN 0.25 ELSE 0 END + CASE WHEN d IS NOT NULL THEN 0.25 ELSE 0 END)"),
    "merge_attributes": MERGE_SQL,
    "keyword_content_search": CONTENT_SQL,
    "keyword_extract": f"SELECT conv_id, turn, array_to_string({KEYWORDS_SQL % 'text'}, ' ') AS keywords FROM conversations",
    "round_robin_diversity": """
WITH a AS (SELECT lang AS query_id, source AS document_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS pos FROM documents),
b AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, document_id ORDER BY pos) AS INTEGER) AS turn, min(pos) OVER (PARTITION BY query_id, document_id) AS first FROM a)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY turn, first) AS INTEGER) AS rank, document_id, chunk_id, turn FROM b QUALIFY rank <= 30
""",
    "relevance_telemetry": f"""
WITH {DENSE_SQL}, c AS (SELECT query_id, id, greatest(0, least(1, round(score, 9))) AS s FROM dn),
t AS (SELECT query_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM c)
SELECT c.query_id, 'dense' AS source, round(avg(c.s), 6) AS avg_score, count(*) AS n, (SELECT round(avg(t.s), 6) FROM t WHERE t.query_id = c.query_id AND r <= 5) AS top5 FROM c GROUP BY c.query_id
""",
}
