"""Queries of the text operators, each over whole tables with production parameters, and SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


from logweave.llm import (  # noqa: E402, F401
    queries_conversations,
    queries_corpus,
    queries_dedup,
    queries_models,
    queries_phrases,
    queries_shards,
    queries_tokens,
)
