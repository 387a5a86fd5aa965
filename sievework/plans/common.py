"""What the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Questions of the retrieval queries.
QUESTIONS = [("q1", "apache license été the"), ("q2", "stupid idiot loser"), ("q3", "der die und von"), ("q4", "the the of")]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id string, query string")


VALUES = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in QUESTIONS) + ") AS q(query_id, query)"
