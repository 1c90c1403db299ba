"""Enrichment of parsed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.entities import extract_entities
from logweave.functions.levels import default_component, implicit_level, map_level
from logweave.functions.regex import strip
from logweave.functions.timestamps import event_date, event_ts, normalize_timestamp
from logweave.rules.origins import Origin


def enrich_records(
    records: DataFrame, origin: Origin, year: Column | int | None = None, apply_levels: bool = True
) -> DataFrame:
    """Timestamps, entities, component, level map, implied level: in this order, all as projections.

    ``raw_timestamp`` keeps what the line said; ``apply_levels=False`` leaves native level and component names.
    """
    stamped = records.withColumnRenamed("timestamp", "raw_timestamp").withColumn(
        "timestamp", normalize_timestamp(F.col("raw_timestamp"), year)
    )
    dated = stamped.withColumns(
        {"event_ts": event_ts(F.col("timestamp")), "event_date": event_date(F.col("timestamp"))}
    )
    extracted = extract_entities(dated, origin.extractors)
    level = F.col("level")
    if apply_levels:
        extracted = extracted.withColumn("component", default_component(F.col("component"), origin.default_component))
        level = map_level(level, origin.levels)
    return extracted.withColumn("level", implicit_level(level, F.col("message")))


def normalization_stats(records: DataFrame, raw: str = "raw_timestamp", normalised: str = "timestamp") -> DataFrame:
    """How many timestamps were normalised, failed or missing."""
    missing = strip(F.coalesce(raw, F.lit(""))) == ""
    done = F.col(normalised).isNotNull()
    return records.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~missing & done).alias("normalized"),
        F.count_if(~missing & ~done).alias("failed"),
        F.count_if(missing).alias("no_timestamp"),
    )
