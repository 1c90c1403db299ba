"""Parsed records and mined templates read back from storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.regex import strip
from logweave.operators.storage import read_daily_json


def with_message(records: DataFrame) -> DataFrame:
    """Records whose message is not blank."""
    return records.filter(strip(F.coalesce("message", F.lit(""))) != "")


def read_parsed(spark: SparkSession, path: str, origin: str | None = None, fmt: str = "parquet") -> DataFrame:
    """All days of one origin; the store is partitioned, so other origins are not read. JSON stores may be envelopes."""
    records = read_daily_json(spark, path) if fmt == "json" else spark.read.format(fmt).load(path)
    if records is None:
        raise FileNotFoundError(path)
    if origin is not None:
        records = records.filter(F.col("log_type") == origin)
    return with_message(records)


def list_origins(records: DataFrame) -> DataFrame:
    return records.select("log_type").distinct()


def list_dates(records: DataFrame) -> DataFrame:
    """Available days, newest first; undated records show as ``sin_fecha``."""
    return list_dates_of(records.select(F.coalesce(F.col("event_date").cast("string"), F.lit("sin_fecha")).alias("date")))


def list_dates_of(named: DataFrame) -> DataFrame:
    return named.select("date").distinct().orderBy(F.desc("date"))


def list_log_types(records: DataFrame, date: Column) -> DataFrame:
    """Origins with records on one day."""
    return records.filter(F.col("event_date") == date).select("log_type").distinct()


def read_templates(spark: SparkSession, path: str, layout: str | None = None) -> DataFrame:
    """Clusters of a template file: ``clusters`` is a list, or a map from id to cluster (``layout='map'``), or every line
    is a cluster (``layout='lines'``, as ``write_clusters`` leaves them). Without a layout the file tells."""
    cluster = "cluster_id string, template string, size bigint, event_type string, severity string"
    if layout is None:
        top = spark.read.schema("clusters variant").option("multiLine", "true").json(path)
        kinds = top.where("clusters is not null").select(F.expr("schema_of_variant(clusters)").alias("k")).limit(1).collect()
        layout = "lines" if not kinds else "list" if kinds[0]["k"].startswith("ARRAY") else "map"
    if layout == "lines":
        return spark.read.schema(cluster).json(path)
    entry = "struct<" + cluster.replace(" string", ":string").replace(" bigint", ":bigint") + ">"
    kind = f"array<{entry}>" if layout == "list" else f"map<string,{entry}>"
    document = spark.read.schema(f"clusters {kind}").option("multiLine", "true").json(path)
    if layout == "list":
        return document.select(F.explode("clusters").alias("c")).select("c.*")
    named = document.select(F.explode("clusters").alias("id", "c"))
    return named.select(F.col("id").alias("cluster_id"), "c.template", "c.size", "c.event_type", "c.severity")
