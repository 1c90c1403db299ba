"""Run, cluster and coverage metrics."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logweave.functions.regex import java_regex
from logweave.operators.storage import one_row
from logweave.session import sized_broadcast
from logweave.rules.levels import LEVEL_WORDS
from logweave.rules.timestamps import TIMESTAMP_CATALOGUE

# What counts as a wildcard in a template.
WILDCARDS = r"<\*>|(?<!\S)\*(?!\S)|\b(?:ALPHANUM|NUM|IP|HEX|UUID|PATH|LIBCODE|JDECODE|CONTEXT_ID)\b"
MIN_TIMESTAMP_COVERAGE = 0.66
MIN_LEVEL_COVERAGE = 0.3


def phase_metrics(timings: DataFrame) -> DataFrame:
    """Seconds per (origin, phase) and per phase over all origins (``log_type`` is then ``global``).

    The pseudo phase ``total`` adds up a file's phases first.
    """
    per_file = timings.groupBy("log_type", "rel_path").agg(F.sum("seconds").alias("seconds"))
    phases = timings.select("log_type", "phase", "seconds").unionByName(
        per_file.select("log_type", F.lit("total").alias("phase"), "seconds")
    )
    return (
        phases.rollup("phase", "log_type")
        .agg(
            F.grouping("phase").alias("__all"),
            F.grouping("log_type").alias("__global"),
            F.round(F.sum("seconds"), 4).alias("sum"),
            F.round(F.avg("seconds"), 4).alias("avg"),
            F.round(F.min("seconds"), 4).alias("min"),
            F.round(F.max("seconds"), 4).alias("max"),
            F.count("seconds").alias("count"),
        )
        .filter("__all = 0")
        .select(
            F.when(F.col("__global") == 1, "global").otherwise(F.col("log_type")).alias("log_type"),
            "phase", "sum", "avg", "min", "max", "count",
        )
    )


def throughput(timings: DataFrame, counts: DataFrame) -> DataFrame:
    """Files, records and averages per origin and overall. ``counts``: ``log_type, rel_path, records``."""
    per_file = timings.groupBy("log_type", "rel_path").agg(F.sum("seconds").alias("seconds"))
    joined = per_file.join(counts, ["log_type", "rel_path"], "left")
    return (
        joined.rollup("log_type")
        .agg(
            F.grouping("log_type").alias("__global"),
            F.count(F.lit(1)).alias("files_count"),
            F.coalesce(F.sum("records"), F.lit(0)).alias("records_count"),
            F.sum("seconds").alias("__seconds"),
        )
        .select(
            F.when(F.col("__global") == 1, "global").otherwise(F.col("log_type")).alias("log_type"),
            "files_count",
            "records_count",
            F.round(F.col("__seconds") / F.col("files_count"), 4).alias("avg_seconds_per_file"),
            F.round(F.when(F.col("records_count") > 0, F.col("__seconds") / F.col("records_count")).otherwise(0), 6).alias(
                "avg_seconds_per_record"
            ),
        )
    )


def pattern_match_counts(records: DataFrame) -> DataFrame:
    """Hits per header rule, most first."""
    return records.groupBy("log_type", "pattern").agg(F.count(F.lit(1)).alias("hits")).orderBy(F.desc("hits"), "log_type", "pattern")


def unmatched_rate(lines: DataFrame, matched: Column) -> DataFrame:
    """Lines no rule matched, as a count and in percent."""
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if(~matched).alias("unmatched")).withColumn(
        "unmatched_pct", F.when(F.col("lines") > 0, F.round(F.col("unmatched") / F.col("lines") * 100, 1)).otherwise(0.0)
    )


def cluster_stats(assignments: DataFrame, messages: DataFrame, clusters: DataFrame, n_examples: int) -> DataFrame:
    """Size, share and the first examples of each cluster.

    Spark limits the ranked rows per cluster before the shuffle, so a large cluster sends few of them.
    """
    key = ["origin", "cluster_id"]
    total = clusters.groupBy("origin").agg(F.sum("size").alias("__total"))
    first = (
        assignments.withColumn("__rank", F.row_number().over(W.partitionBy(*key).orderBy("seq")))
        .filter(F.col("__rank") <= n_examples)
        .select(*key, "seq")
    )
    examples = (
        messages.select("origin", "seq", "message")
        .join(sized_broadcast(first, "cluster-examples"), ["origin", "seq"])
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("seq", "message"))).alias("__e"))
        .select(*key, F.transform("__e", lambda e: e["message"]).alias("examples"))
    )
    return (
        clusters.join(total, "origin")
        .join(examples, key, "left")
        .select(
            *key, "template", "size",
            F.when(F.col("__total") > 0, F.round(F.col("size") / F.col("__total") * 100, 2)).otherwise(0.0).alias("percentage"),
            "examples",
        )
    )


def cluster_quality(clusters: DataFrame, by: Sequence[str] = ("origin",)) -> DataFrame:
    """Number of clusters, entropy, coverage of the largest, wildcards and Gini coefficient per group.

    Everything but the wildcards follows from how often each size occurs. Sums of sizes bound the number of distinct
    ones by a square root, so windows run over that short histogram, not over clusters.
    """
    by = list(by)
    wild = F.regexp_count("template", F.lit(java_regex(WILDCARDS)))
    histogram = clusters.groupBy(*by, "size").agg(F.count(F.lit(1)).alias("n"), F.sum(wild).alias("wild"))
    up = W.partitionBy(*by).orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    down = W.partitionBy(*by).orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)
    ranked = histogram.withColumns(
        {
            "below": F.coalesce(F.sum("n").over(up), F.lit(0)),
            "above": F.coalesce(F.sum("n").over(down), F.lit(0)),
        }
    )
    n, size = F.col("n"), F.col("size")

    def largest(k: int) -> Column:
        return F.sum(F.least(n, F.greatest(F.lit(k) - F.col("above"), F.lit(0))) * size)

    # Ranks of n equal sizes behind `below` smaller ones add up to n * below + n * (n + 1) / 2.
    weighted = F.sum(size * (n * F.col("below") + n * (n + 1) / 2))
    summary = ranked.groupBy(*by).agg(
        F.sum("n").alias("num_clusters"),
        F.sum(n * size).alias("total_logs"),
        F.sum(n * size * F.log2(size.cast("double"))).alias("__slog"),
        largest(10).alias("__top10"),
        largest(20).alias("__top20"),
        F.sum("wild").alias("__wild"),
        weighted.alias("__weighted"),
    )
    total, count = F.col("total_logs"), F.col("num_clusters")
    return summary.filter(total > 0).select(
        *by,
        "num_clusters",
        "total_logs",
        F.round(F.log2(total.cast("double")) - F.col("__slog") / total, 3).alias("entropy"),
        F.round(F.col("__top10") / total, 3).alias("top_10_coverage"),
        F.round(F.col("__top20") / total, 3).alias("top_20_coverage"),
        F.round(total / count, 2).alias("avg_cluster_size"),
        F.round(F.col("__wild") / count, 2).alias("avg_wildcards_per_template"),
        F.round(2 * F.col("__weighted") / (count * total) - (count + 1) / count, 3).alias("gini_coefficient"),
    )


def metrics_by_config(clusters: DataFrame) -> DataFrame:
    """Quality of each (origin, configuration), side by side."""
    return cluster_quality(clusters, ("origin", "config"))


def coverage_report(structured: DataFrame, templates: DataFrame, event_id: str = "event_id") -> DataFrame:
    """Lines, lines with an event id, templates and the largest cluster."""
    sizes = structured.groupBy(event_id).agg(F.count(F.lit(1)).alias("n"))
    known = F.col(event_id).isNotNull()
    lines = sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_lines"),
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("matched_lines"),
        F.coalesce(F.max(F.when(known, F.col("n"))), F.lit(0)).alias("largest_cluster_size"),
    )
    total = F.col("total_lines")
    share = F.when(total > 0, F.round(F.col("matched_lines") / total * 100, 2)).otherwise(0.0)
    return one_row(lines, templates.agg(F.count(F.lit(1)).alias("num_templates"))).select(
        "total_lines", "matched_lines", share.alias("coverage_pct"), "num_templates", "largest_cluster_size"
    )


def origin_summary(files: DataFrame, clusters: DataFrame) -> DataFrame:
    """Files, lines, ignored, processed and clusters per origin, and a ``total`` row."""
    lines = files.groupBy("origin").agg(
        F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"),
        F.sum("ignored").alias("ignored"), F.sum("processed").alias("processed"),
    )
    counts = clusters.groupBy("origin").agg(F.count(F.lit(1)).alias("clusters"))
    joined = lines.join(counts, "origin", "left").fillna(0, ["clusters"])
    names = ["files", "lines", "ignored", "processed", "clusters"]
    return (
        joined.rollup("origin")
        .agg(F.grouping("origin").alias("__all"), *[F.sum(c).alias(c) for c in names])
        .select(F.when(F.col("__all") == 1, "total").otherwise(F.col("origin")).alias("origin"), *names)
    )


def counts_by_log_type(documents: DataFrame, limit: int | None = None) -> DataFrame:
    """Documents per origin with their share, largest first; ``limit`` asks for the largest only."""
    counts = documents.groupBy("log_type").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(W.partitionBy())
    shares = counts.withColumn("percentage", F.round(F.col("count") / total * 100, 2)).orderBy(F.desc("count"), "log_type")
    return shares if limit is None else shares.limit(limit)


def timestamp_format_coverage(sample: DataFrame, catalogue: Sequence[str] = TIMESTAMP_CATALOGUE) -> DataFrame:
    """Share of lines each format fits, one row per format; ``best`` marks the first best one if it reaches far enough."""
    shares = sample.agg(
        F.count(F.lit(1)).alias("lines"),
        *[F.count_if(F.col("value").rlike(java_regex(p))).alias(f"p{i}") for i, p in enumerate(catalogue)],
    )
    hits = F.array(*[F.struct(F.lit(i).alias("ord"), F.col(f"p{i}").alias("hits")) for i in range(len(catalogue))])
    rows = shares.select("lines", F.inline(hits)).withColumn(
        "coverage", F.when(F.col("lines") > 0, F.col("hits") / F.col("lines")).otherwise(0.0)
    )
    first = F.row_number().over(W.orderBy(F.desc("coverage"), "ord")) == 1
    return rows.withColumn("best", first & (F.col("coverage") >= MIN_TIMESTAMP_COVERAGE)).select("ord", "hits", "coverage", "best")


def level_word(line: Column, timestamp: str, window: int | None = None) -> Column:
    """First level word, in list order, behind the timestamp: anywhere, or within ``window`` characters."""
    reach = "*" if window is None else f"{{0,{window}}}"
    behind_group = re.compile(timestamp).groups + 1
    regex = java_regex(rf"(?s)(?:{timestamp})(.{reach})")
    behind = F.regexp_extract(line, regex, behind_group)
    found = F.regexp_extract_all(behind, F.lit(r"\b(?:" + "|".join(LEVEL_WORDS) + r")\b"), F.lit(0))
    return F.get(F.array_intersect(F.array(*[F.lit(w) for w in LEVEL_WORDS]), found), F.lit(0))


def level_word_coverage(sample: DataFrame, timestamp: str, window: int | None = None) -> DataFrame:
    """Lines per level word."""
    return (
        sample.withColumn("word", level_word(F.col("value"), timestamp, window))
        .filter("word is not null")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("lines"))
    )


def group_size_stats(members: DataFrame, label: str = "label") -> DataFrame:
    """Number of groups and how large they are."""
    sizes = members.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.max("n").alias("max_group_size"),
        F.min("n").alias("min_group_size"),
        F.round(F.avg("n"), 2).alias("mean_group_size"),
        F.median("n").alias("median_group_size"),
        F.count_if(F.col("n") == 1).alias("singleton_groups"),
    )


def origin_file_counts(files: DataFrame, origin: str = "origin") -> DataFrame:
    return files.groupBy(origin).agg(F.count(F.lit(1)).alias("files"))


def group_totals(members: DataFrame, label: str = "group_id") -> DataFrame:
    """Members and messages per group."""
    return members.groupBy(label).agg(F.count(F.lit(1)).alias("num_members"), F.sum("size").alias("total_size"))


def reduction_report(clusters: DataFrame, members: DataFrame, label: str = "group_id") -> DataFrame:
    """How far grouping reduces the clusters, and how many clusters no group has."""
    grouped = members.select("cluster_id", label).distinct().withColumn("__in", F.lit(1))
    joined = clusters.select("cluster_id").join(grouped, "cluster_id", "left")
    return joined.agg(
        F.count_distinct("cluster_id").alias("clusters"),
        F.count_distinct(label).alias("groups"),
        F.count_if(F.col("__in").isNull()).alias("ungrouped"),
    ).withColumn("reduction_pct", F.round((1 - F.col("groups") / F.col("clusters")) * 100, 2))
