"""A parsing run: from a folder of log files to the day store."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators.classify import classify_by_template
from logweave.operators.detect import UNKNOWN, detect_by_content, type_by_name
from logweave.operators.enrich import enrich_records, normalization_stats
from logweave.operators.events import parse_lines
from logweave.operators.storage import (
    execution_summary,
    files_to_process,
    read_version,
    source_lineage,
    update_registry,
    write_daily,
    write_learning_queue,
    write_version,
)
from logweave.rules.origins import BY_NAME, ORIGINS
from logweave.schema import REGISTRY
from logweave.session import materialize
from logweave.sources.archives import has_archives, read_archived_logs
from logweave.sources.files import read_log_lines, relative_to, scan_log_files
from logweave.streaming.incremental import follow_tail
from logweave.streaming.tail import listed_sizes


@dataclass(frozen=True)
class Run:
    files: DataFrame
    records: DataFrame
    unmatched: DataFrame
    summary: DataFrame
    file_counts: DataFrame


def archived_files(lines: DataFrame, root: str) -> DataFrame:
    """Archive members in the form of a file listing."""
    return lines.groupBy("rel_path").agg(F.sum(F.octet_length("value") + 1).alias("size_bytes")).select(
        F.concat(F.lit(f"{root.rstrip('/')}/"), "rel_path").alias("path"),
        "rel_path",
        F.col("size_bytes").cast("bigint").alias("size_bytes"),
        F.lit(None).cast("timestamp").alias("mtime"),
    )


def _archived_lines(spark: SparkSession, root: str, suffix: str) -> DataFrame | None:
    """Lines of packed logs below ``root`` that do not lie there unpacked, or none where nothing is packed."""
    if not has_archives(spark, root):
        return None
    lines = read_archived_logs(spark, root, scan_log_files(spark, root, suffix))
    path = F.concat(F.lit(f"{root.rstrip('/')}/"), "rel_path").alias("file_path")
    return lines.filter(F.col("rel_path").endswith(suffix)).select(path, "rel_path", "line_no", "value")


def detect_files(spark: SparkSession, root: str, suffix: str = ".log", archived: DataFrame | None = None) -> DataFrame:
    """Listed files, and archive members where their lines are given, with their format: by name, and by content where
    the name says nothing. ``packed`` tells members from files."""
    files = scan_log_files(spark, root, suffix).withColumn("packed", F.lit(False))
    if archived is not None:
        files = files.unionByName(archived_files(archived, root).withColumn("packed", F.lit(True)))
    named = files.withColumn("log_type", type_by_name(F.regexp_extract("rel_path", r"([^/]*)$", 1)))
    named = materialize(named, "run-files")
    open_names = named.filter(F.col("log_type") == UNKNOWN)
    # A file listing, which Spark's reader keeps on the driver as well.
    unknown = [r["path"] for r in open_names.filter(~F.col("packed")).select("path").toLocalIterator()]
    found = [read_log_lines(spark, unknown).withColumn("rel_path", relative_to(root, F.col("file_path")))] if unknown else []
    if archived is not None:
        found.append(archived.join(open_names.filter("packed").select("rel_path"), "rel_path", "left_semi"))
    for lines in found:
        by_content = detect_by_content(lines, key="rel_path").withColumnRenamed("log_type", "__content")
        named = named.join(by_content, "rel_path", "left").withColumn(
            "log_type", F.coalesce(F.when(F.col("log_type") == UNKNOWN, F.col("__content")), "log_type")
        ).drop("__content")
    growing = [o.name for o in ORIGINS if o.incremental]
    return named.withColumn("incremental", F.col("log_type").isin(growing))


def parse_folder(
    spark: SparkSession,
    root: str,
    registry: DataFrame | None = None,
    rules: DataFrame | None = None,
    year: int | None = None,
    force: bool = False,
    suffix: str = ".log",
    growing: bool = True,
) -> Run:
    """Parse and enrich what changed, packed or not; each origin is one plan over its own files, united at the end.

    ``growing=False`` leaves files of formats that grow to ``follow_growing``, which reads only what was appended; packed
    ones do not grow and are read here.
    """
    registry = spark.createDataFrame([], REGISTRY) if registry is None else registry
    archived = _archived_lines(spark, root, suffix)
    listed = detect_files(spark, root, suffix, archived)
    listed = listed if growing else listed.filter(~F.col("incremental") | F.col("packed"))
    files = materialize(files_to_process(listed, registry, force), "run-selection")
    records, unmatched = None, None
    for origin in ORIGINS:
        # A file listing, which Spark's reader keeps on the driver as well.
        mine = files.filter(F.col("process") & (F.col("log_type") == origin.name))
        paths = [row["path"] for row in mine.filter(~F.col("packed")).select("path").toLocalIterator()]
        sources = [read_log_lines(spark, paths)] if paths else []
        if archived is not None and not mine.filter("packed").isEmpty():
            packed = archived.join(mine.filter("packed").select("rel_path"), "rel_path", "left_semi")
            sources.append(packed.select("file_path", "line_no", "value"))
        if not sources:
            continue
        parsed = parse_lines(reduce(DataFrame.unionByName, sources), origin)
        enriched = enrich_records(parsed.records, origin, year)
        records = enriched if records is None else records.unionByName(enriched)
        unmatched = parsed.unmatched if unmatched is None else unmatched.unionByName(parsed.unmatched)
    if records is None:
        raise ValueError(f"no file below {root} has a known format and something new in it")
    source = relative_to(root, F.col("file_path"))
    records = records.withColumns({"source_file": source, "file": F.regexp_extract(source, r"([^/]*)$", 1)})
    if rules is not None:
        records = classify_by_template(records, rules)
    records = materialize(records, "run-records")
    unmatched = materialize(unmatched.withColumn("source_file", source), "run-unmatched")
    counts = records.groupBy(F.col("source_file").alias("rel_path")).agg(F.count(F.lit(1)).alias("records_count"))
    missed = unmatched.groupBy(F.col("source_file").alias("rel_path")).agg(F.count(F.lit(1)).alias("unmatched_lines"))
    processed = (
        files.filter(F.col("process") & F.col("log_type").isin(list(BY_NAME)))
        .join(counts, "rel_path", "left")
        .join(missed, "rel_path", "left")
        .select(
            "rel_path",
            F.current_timestamp().alias("last_processed"),
            "size_bytes",
            F.coalesce("records_count", F.lit(0)).alias("records_count"),
            "log_type",
            F.coalesce("unmatched_lines", F.lit(0)).alias("unmatched_lines"),
        )
    )
    unreadable = F.when(F.col("process") & ~F.col("log_type").isin(list(BY_NAME)), "no rules for this format")
    summary = execution_summary(files.withColumn("error", unreadable), normalization_stats(records))
    return Run(files, records, unmatched, summary, processed)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry after the last complete run, empty before the first."""
    known = read_version(spark, path, REGISTRY)
    return spark.createDataFrame([], REGISTRY) if known is None else known


def read_lineage(spark: SparkSession, path: str) -> DataFrame | None:
    return read_version(spark, path)


def store_run(
    run: Run,
    store: str,
    queue: str | None = None,
    registry: str | None = None,
    lineage: str | None = None,
    history: str | None = None,
    fmt: str = "parquet",
) -> None:
    """Merge a run's records into the day store and, where paths are given, end the run: its unmatched lines replace the
    queue, its files renew the registry, what fed each day joins the lineage, and its summary is added to the history.

    Registry and lineage are written as new versions (``read_registry``, ``read_lineage``). All but the history, which
    tells every call, are the same when a run is stored twice.
    """
    spark = run.records.sparkSession
    write_daily(run.records, store, fmt)
    if queue is not None:
        write_learning_queue(run.unmatched, queue)
    if registry is not None:
        write_version(update_registry(read_registry(spark, registry), run.file_counts), registry)
    if lineage is not None:
        write_version(source_lineage(run.records, read_lineage(spark, lineage)), lineage)
    if history is not None:
        run.summary.withColumn("timestamp", F.current_timestamp()).write.mode("append").parquet(history)


def follow_growing(
    spark: SparkSession,
    root: str,
    store: str,
    state: str,
    year: int | None = None,
    suffix: str = ".log",
    max_bytes: int = 0,
    flush_after: float | None = None,
) -> None:
    """Read what was appended to files of growing formats since the last call, and merge it into the day store.

    Formats are found as in ``parse_folder``, by name and by content; what a file was found to be is kept below
    ``state``, as are checkpoint and held events of the one stream per format, which opens that format's files only.
    ``parse_folder(growing=False)`` takes all other files, and packed ones of any format.
    """
    place = state.rstrip("/")
    known = read_version(spark, f"{place}/routes", "rel_path string, log_type string")
    found = detect_files(spark, root, suffix).filter("incremental").select("rel_path", "log_type")
    if known is not None:
        found = known.unionByName(found.join(known.select("rel_path"), "rel_path", "left_anti"))
    routes = materialize(found, "routes")
    write_version(routes, f"{place}/routes")
    listed = list(listed_sizes(root, suffix))
    for origin in ORIGINS:
        # A file listing, which the source holds as its offsets as well.
        mine = {r["rel_path"] for r in routes.filter(F.col("log_type") == origin.name).select("rel_path").toLocalIterator()}
        only = [p for p in listed if _below(root, p) in mine]
        if only:
            follow_tail(spark, root, origin, store, f"{place}/{origin.name}", suffix, only, max_bytes, year=year, flush_after=flush_after)


def _below(root: str, path: str) -> str:
    """``relative_to`` for a path of the listing."""
    tail = root.rstrip("/").split("://", 1)[-1]
    return path[path.index(tail) + len(tail) :].lstrip("/")
