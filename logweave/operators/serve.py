"""Read path: search, filters, pages and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def search_records(records: DataFrame, text: str) -> DataFrame:
    """Case-insensitive text in message, type or component."""
    needle = text.lower()
    hit = F.lit(False)
    for column in ("message", "log_type", "component"):
        hit = hit | F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(needle))
    return records.filter(hit)


def filter_records(records: DataFrame, date: Column | str | None = None, log_type: str | None = None) -> DataFrame:
    """Optional day and origin; both are partition columns of the store, so other days are not read."""
    if date is not None:
        records = records.filter(F.col("event_date") == (F.lit(date).cast("date") if isinstance(date, str) else date))
    if log_type is not None:
        records = records.filter(F.col("log_type") == log_type)
    return records


def search_templates(
    clusters: DataFrame, text: str, limit: int, order: str = "cluster_id", n_examples: int | None = None
) -> DataFrame:
    """Templates that contain a text, with all their stored examples or the first ``n_examples``."""
    hits = clusters.filter(F.contains(F.lower("template"), F.lit(text.lower())))
    if "examples" in clusters.columns and n_examples is not None:
        hits = hits.withColumn("examples", F.slice("examples", 1, n_examples))
    return hits.orderBy(order).limit(limit)


def page(records: DataFrame, number: int, page_size: int = 50, tiebreak: tuple[str, ...] = ("file", "line_no")) -> DataFrame:
    """One page in time order, undated records first. Only ``number * page_size`` rows are kept per task."""
    ordered = records.orderBy(F.col("event_ts").asc_nulls_first(), *tiebreak)
    return ordered.offset((number - 1) * page_size).limit(page_size)


def page_totals(records: DataFrame, page_size: int = 50) -> DataFrame:
    """Number of records and of pages, at least one."""
    return records.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / page_size)).cast("bigint")
    )


def top_clusters(clusters: DataFrame, n: int = 10) -> DataFrame:
    """Largest clusters with rank and share."""
    total = clusters.agg(F.sum("size")).scalar()
    top = clusters.orderBy(F.desc("size"), "cluster_id").limit(n)
    # The window sees n rows.
    rank = F.row_number().over(W.orderBy(F.desc("size"), "cluster_id"))
    return top.select(
        rank.alias("rank"), "cluster_id", "size", F.round(F.col("size") / total * 100, 2).alias("percentage"), "template"
    )


def cluster_detail(clusters: DataFrame, cluster_id: int) -> DataFrame:
    return clusters.filter(F.col("cluster_id") == cluster_id)


def groups_by_members(groups: DataFrame) -> DataFrame:
    """Groups, those with most members first."""
    return groups.orderBy(F.desc("num_members"), "group_id")


def recent_documents(documents: DataFrame, n: int = 5) -> DataFrame:
    return documents.orderBy(F.desc("@timestamp"), "_id").limit(n)


def best_config(results: DataFrame) -> DataFrame:
    """The result with the highest silhouette among those that have one."""
    scored = results.filter(F.col("silhouette").isNotNull() & ~F.isnan("silhouette"))
    return scored.agg(F.max_by(F.struct(*results.columns), "silhouette").alias("best")).select("best.*")
