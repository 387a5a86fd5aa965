"""Upserts and deletes across stores: every delete computes its keys once and anti-joins each table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.graph import Graph


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key; new rows win ties."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def checked_vectors(vectors: DataFrame, dimension: int) -> DataFrame:
    """vectors; a row of another dimension fails the job that reads it."""
    return vectors.withColumn("vector", F.when(F.size("vector") == dimension, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit("vector of "), F.size("vector").cast("string"), F.lit(f" dimensions, not {dimension}")))))


def delete_by_keys(table: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return table.join(keys.select(on).distinct(), on, "left_anti")


def orphans(nodes: DataFrame, key: str, *edges: tuple[DataFrame, str]) -> DataFrame:
    """Nodes that no edge (table, end column) touches."""
    for table, end in edges:
        nodes = nodes.join(table.select(F.col(end).alias(key)).distinct(), key, "left_anti")
    return nodes


def delete_documents(store: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """documents, chunks, images, tables, vectors, postings without the documents in ids (document_id): chunks, tables
    and images go with their document."""
    gone = ids.select("document_id").distinct()
    chunks = store["chunks"].join(gone, "document_id", "left_semi").select("chunk_id") if "chunk_id" in store["chunks"].columns else store["chunks"].join(gone, "document_id", "left_semi").select(F.col("id").alias("chunk_id"))
    out = {}
    for name, table in store.items():
        if name == "documents":
            out[name] = table.join(gone.withColumnRenamed("document_id", "id"), "id", "left_anti") if "document_id" not in table.columns else table.join(gone, "document_id", "left_anti")
        elif "document_id" in table.columns:
            out[name] = table.join(gone, "document_id", "left_anti")
        else:
            out[name] = table.join(chunks, "chunk_id", "left_anti")
    return out


def delete_counts(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """Rows that a delete takes from each table."""
    parts = [before[n].agg(F.count("*").alias("b")).crossJoin(after[n].agg(F.count("*").alias("a"))).select(F.lit(n).alias("name"), (F.col("b") - F.col("a")).alias("deleted")) for n in before]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def set_null(table: DataFrame, gone: DataFrame, on: str) -> DataFrame:
    """ON DELETE SET NULL: references to deleted keys become null."""
    marked = table.join(gone.select(on).distinct().withColumn("_gone", F.lit(True)), on, "left")
    return marked.withColumn(on, F.when(F.col("_gone"), None).otherwise(F.col(on))).drop("_gone").select(*table.columns)


def delete_from_graph(graph: Graph, ids: DataFrame) -> Graph:
    """The graph without documents: sections and chunks go with their edges; then media and entities that only they
    held, then topics and edges that lost an end."""
    gone = ids.select("document_id").distinct()
    nodes, edges = dict(graph.nodes), dict(graph.edges)
    chunks = nodes["Chunk"].join(gone, "document_id", "left_semi").select("chunk_id")
    sections = nodes["Section"].join(gone, "document_id", "left_semi").select("section_id")
    for label in ("Document", "Section", "Chunk"):
        nodes[label] = nodes[label].join(gone, "document_id", "left_anti")
    cut = lambda t, keys, key, end: t.join(keys.select(F.col(key).alias(end)).distinct(), end, "left_anti")
    for t in ("MENTIONS", "HAS_MEDIA", "HAS_TOPIC", "NEXT_CHUNK"):
        edges[t] = cut(edges[t], chunks, "chunk_id", "src")
    edges["NEXT_CHUNK"] = cut(edges["NEXT_CHUNK"], chunks, "chunk_id", "dst")
    edges["HAS_CHUNK"] = cut(edges["HAS_CHUNK"], chunks, "chunk_id", "dst")
    edges["HAS_SECTION"] = cut(edges["HAS_SECTION"], sections, "section_id", "dst")
    edges["ABOUT"] = cut(edges["ABOUT"], sections, "section_id", "src")
    held_before = graph.edges["HAS_MEDIA"].join(chunks.select(F.col("chunk_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("media_id"))
    lost = held_before.join(edges["HAS_MEDIA"].select(F.col("dst").alias("media_id")), "media_id", "left_anti")
    nodes["Media"] = nodes["Media"].join(lost, "media_id", "left_anti")
    named_before = graph.edges["MENTIONS"].join(chunks.select(F.col("chunk_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("normalized_name"))
    unnamed = named_before.join(edges["MENTIONS"].select(F.col("dst").alias("normalized_name")), "normalized_name", "left_anti").join(edges["ABOUT"].select(F.col("dst").alias("normalized_name")), "normalized_name", "left_anti")
    nodes["Entity"] = nodes["Entity"].join(unnamed, "normalized_name", "left_anti")
    for t, end in (("RELATED_TO", "src"), ("RELATED_TO", "dst"), ("ASSOCIATED_WITH", "src"), ("DESCRIBES", "dst")):
        edges[t] = edges[t].join(nodes["Entity"].select(F.col("normalized_name").alias(end)), end, "left_semi")
    edges["DESCRIBES"] = edges["DESCRIBES"].join(nodes["Media"].select(F.col("media_id").alias("src")), "src", "left_semi")
    nodes["Topic"] = nodes["Topic"].join(edges["HAS_TOPIC"].select(F.col("dst").alias("normalized_name")).union(edges["ASSOCIATED_WITH"].select("dst")).distinct(), "normalized_name", "left_semi")
    edges["ASSOCIATED_WITH"] = edges["ASSOCIATED_WITH"].join(nodes["Topic"].select(F.col("normalized_name").alias("dst")), "dst", "left_semi")
    return Graph(nodes, edges)


def clean_orphans(graph: Graph) -> tuple[Graph, DataFrame]:
    """The graph without entities that no edge touches, then without those that nothing mentions and no section is about;
    and how many each step took (step, deleted)."""
    e, nodes, edges = graph.nodes["Entity"], graph.edges, lambda t, c: graph.edges[t].select(F.col(c).alias("normalized_name"))
    touched = edges("MENTIONS", "dst").union(edges("ABOUT", "dst")).union(edges("RELATED_TO", "src")).union(edges("RELATED_TO", "dst")).union(edges("DESCRIBES", "dst")).union(edges("ASSOCIATED_WITH", "src")).distinct()
    some = e.join(touched, "normalized_name", "left_semi")
    used = edges("MENTIONS", "dst").union(edges("ABOUT", "dst")).distinct()
    left = some.join(used, "normalized_name", "left_semi")
    count = lambda df, name: df.agg(F.count("*").alias("deleted")).select(F.lit(name).alias("step"), "deleted")
    gone = count(e.join(touched, "normalized_name", "left_anti"), "without edges").unionByName(count(some.join(used, "normalized_name", "left_anti"), "not mentioned"))
    return Graph(graph.nodes | {"Entity": left}, nodes), gone


def blobs_of(ids: DataFrame, *tables: tuple[DataFrame, str]) -> DataFrame:
    """document_id, path of the stored objects (table, path column) that documents in ids leave behind, each once."""
    gone = ids.select("document_id").distinct()
    parts = [t.join(gone, "document_id", "left_semi").select("document_id", F.col(c).alias("path")).where("path IS NOT NULL AND path <> ''") for t, c in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def delete_blobs(paths: DataFrame) -> DataFrame:
    """path, deleted: objects are deleted where the rows are; one that is missing or cannot be deleted does not end the
    others. Paths are those of a mounted store."""
    from collections.abc import Iterator

    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for frame in frames:
            done = []
            for path in frame["path"]:
                try:
                    os.remove(path.removeprefix("file:"))
                    done.append(True)
                except OSError:
                    done.append(False)
            yield pd.DataFrame({"path": frame["path"], "deleted": done})

    return paths.select("path").mapInPandas(run, "path string, deleted boolean")


def verify(tables: dict[str, DataFrame], schemas: dict[str, str]) -> list[str]:
    """What stored tables lack against their schemas: missing tables, missing columns, other types."""
    from pyspark.sql.types import _parse_datatype_string

    wrong = [f"{n}: no table" for n in schemas if n not in tables]
    for name, table in tables.items():
        have = {f.name: f.dataType.simpleString() for f in table.schema}
        for f in _parse_datatype_string(schemas[name]) if name in schemas else ():
            if have.get(f.name) != f.dataType.simpleString():
                wrong.append(f"{name}.{f.name}: {have.get(f.name, 'missing')}, not {f.dataType.simpleString()}")
    return wrong


def rebuild(spark, schemas: dict[str, str], path: str) -> dict[str, DataFrame]:
    """Empty tables of the schemas under a path, in place of what is there."""
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/{name}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in schemas}


def delete_all(store: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {n: t.limit(0) for n, t in store.items()}


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """Rows that the condition is not true for."""
    return table.where(~F.coalesce(condition, F.lit(False)))
