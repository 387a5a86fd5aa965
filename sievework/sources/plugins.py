"""Models that a caller brings: embedders, entity extractors, captioners. None is built in or on by default."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class EntityExtractor(Protocol):
    def extract(self, texts: Sequence[str]) -> Sequence[list[tuple[str, str]]]:
        """Pairs (name, type) for each text."""


class Captioner(Protocol):
    def describe(self, images: Sequence[bytes]) -> Sequence[str | None]: ...


class Reader(Protocol):
    def read(self, images: Sequence[bytes]) -> Sequence[Sequence[str]]:
        """The strings found in each picture."""


class Answerer(Protocol):
    def answer(self, questions: Sequence[str], contexts: Sequence[str]) -> Sequence[str]: ...


def answers(questions: DataFrame, contexts: DataFrame, make: Callable[[], Answerer], key: str = "query_id") -> DataFrame:
    """key, query, answer by a model from assembled contexts; a question without context gets a fixed sentence and does
    not reach the model."""
    from sievework.operators.context import NO_CONTEXT

    rows = questions.join(contexts, key, "left").select(key, "query", F.coalesce("context", F.lit("")).alias("context"))
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            frame["answer"] = list(model.answer(frame["query"].tolist(), frame["context"].tolist()))
            yield frame[[key, "query", "answer"]]

    known = rows.where(F.trim("context") != "").mapInPandas(run, f"`{key}` {kind}, query string, answer string")
    return known.unionByName(rows.where(F.trim("context") == "").select(key, "query", F.lit(NO_CONTEXT).alias("answer")))


def embed(rows: DataFrame, make: Callable[[], Embedder], text: str = "chunk_text", prefix: str = "", batch: int = 32, out: str = "vector") -> DataFrame:
    """rows with unit vectors of a text column; a blank text has the zero vector. make() runs once for each task."""
    columns = [c for c in rows.columns if c != out]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        model = make()
        for frame in frames:
            said = frame[text].fillna("")
            vectors = np.zeros((len(frame), model.dimension), dtype=np.float32)
            some = np.flatnonzero(said.str.strip() != "")
            for a in range(0, len(some), batch):
                at = some[a : a + batch]
                v = np.asarray(model.embed([prefix + said.iloc[i] for i in at]), dtype=np.float32)
                vectors[at] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            frame[out] = list(vectors)
            yield frame

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns) + f", `{out}` array<float>"
    return rows.select(*columns).mapInPandas(run, schema)


def entities(rows: DataFrame, make: Callable[[], EntityExtractor], key: str = "chunk_id", text: str = "chunk_text", confidence: float = 0.85) -> DataFrame:
    """key, entity_name, entity_type, entity_value, confidence by a model; amounts and times carry their value."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            found = model.extract(frame[text].fillna("").tolist())
            yield pd.DataFrame([(k, n, t) for k, pairs in zip(frame[key], found) for n, t in pairs], columns=[key, "entity_name", "entity_type"])

    got = rows.select(key, text).mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, entity_name string, entity_type string")
    value = F.when(F.col("entity_type").isin("MONEY", "PERCENT", "DATE", "TIME"), F.col("entity_name"))
    return got.withColumns({"entity_value": value, "confidence": F.lit(confidence)})


def captions(rows: DataFrame, make: Callable[[], Captioner], image: str = "content", out: str = "caption") -> DataFrame:
    """rows with a description of an image column; null where the model has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            frame[out] = model.describe(frame[image].tolist())
            yield frame

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != out) + f", `{out}` string"
    return rows.drop(out).mapInPandas(run, schema)


def recognized(rows: DataFrame, make: Callable[[], Reader], image: str = "content", out: str = "extracted_text") -> DataFrame:
    """rows with the text that a model reads in an image column: the strings that are not blank, with a blank between;
    null where there are none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            found = model.read(frame[image].tolist())
            frame[out] = [" ".join(s.strip() for s in strings if s and s.strip()) or None for strings in found]
            yield frame

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != out) + f", `{out}` string"
    return rows.drop(out).mapInPandas(run, schema)


def distinct_entities(found: DataFrame, key: str = "chunk_id") -> DataFrame:
    """A model's entities, each normalised name once for each key: the first by spelling."""
    rows = found.withColumn("normalized_name", F.lower(F.trim("entity_name")))
    order = F.struct("entity_name", "entity_type")
    return rows.groupBy(key, "normalized_name").agg(*(F.min_by(c, order).alias(c) for c in ("entity_name", "entity_type", "entity_value", "confidence")))
