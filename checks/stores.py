"""Queries for sources, stores, registries, search documents, serving and metrics."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from checks import inputs as I
from checks.parsing import _LEVELS
from checks.parsing import _NAMES, _TYPE, _prs_1
from logweave.operators import classify, metrics, search, serve, storage
from logweave.session import materialize, scratch_path
from logweave.sources import files as file_source
from logweave.sources import tables

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def register(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return query

    return register


# --- sources -------------------------------------------------------------------------------------------------------


def _text_files(spark, sf, numbered: bool = True) -> str:
    """Log lines as text files below one folder per ``file``; each line may begin with its number."""
    path = scratch_path(spark, "check-logs")
    value = F.concat_ws(" ", "line_no", "value") if numbered else F.col("value")
    lines = I.log_lines(spark, sf).select("file", "line_no", value.alias("value"))
    ordered = lines.repartitionByRange("file", "line_no").sortWithinPartitions("file", "line_no")
    ordered.select("file", "value").write.partitionBy("file").text(path)
    return path


_FOLDER = r"file=([^/]+)/"


@check(
    "src_1_scan_log_files",
    f"with {I.LINES_CTE} select file, cast(sum(strlen(concat(line_no, ' ', value)) + 1) as bigint) as size_bytes from log_lines group by file",
)
def _src_1(spark, sf):
    listed = file_source.scan_log_files(spark, _text_files(spark, sf), ".txt", exclude_prefix="_")
    return listed.groupBy(F.regexp_extract("rel_path", _FOLDER, 1).alias("file")).agg(F.sum("size_bytes").alias("size_bytes"))


@check(
    "src_2_read_log_lines",
    f"with {I.LINES_CTE} select file, concat(line_no, ' ', value) as value, true as in_order from log_lines",
)
def _src_2(spark, sf):
    lines = file_source.read_log_lines(spark, _text_files(spark, sf))
    # Lines were written in the order of the number they begin with, so reading numbers must agree with it.
    numbers = W.partitionBy("file_path", F.floor(F.col("line_no") / 4096)).orderBy("line_no")
    written = F.split("value", " ")[0].cast("bigint")
    in_order = F.coalesce(written > F.lag(written).over(numbers), F.lit(True))
    return lines.select(F.regexp_extract("file_path", _FOLDER, 1).alias("file"), "value", in_order.alias("in_order"))


@check("src_2_split_geometry", f"with {I.LINES_CTE} select file, concat(line_no, ' ', value) as value, row_number() over (partition by file order by line_no) as line_no from log_lines")
def _src_2_geometry(spark, sf):
    """Files are cut differently when the lines are read than when the frame was built."""
    key, path = "spark.sql.files.maxPartitionBytes", _text_files(spark, sf)
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64k")
        lines = file_source.read_log_lines(spark, path)
        spark.conf.set(key, "96k")
        lines = materialize(lines, "check-lines")
    finally:
        spark.conf.set(key, before)
    # The folder of a file holds part files that follow each other in name order.
    parts = lines.groupBy("file_path").agg(F.max("line_no").alias("n"))
    file = F.regexp_extract("file_path", _FOLDER, 1)
    earlier = W.partitionBy("file").orderBy("file_path").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.withColumn("file", file).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return lines.join(offsets, "file_path").select("file", "value", (F.col("before") + F.col("line_no")).alias("line_no"))


def _write_archives(spark, sf) -> str:
    """Log lines packed into tar archives by the tasks that hold them."""
    import os

    path = scratch_path(spark, "check-archives").removeprefix("file:")
    os.makedirs(path, exist_ok=True)

    def pack(batches):
        import io
        import tarfile
        import uuid

        import pandas as pd

        for batch in batches:
            for name, group in batch.groupby("file"):
                data = ("\n".join(group["value"]) + "\n").encode()
                unique = uuid.uuid4().hex
                with tarfile.open(f"{path}/{unique}.tar.gz", "w:gz") as tar:
                    entry = tarfile.TarInfo(f"deep/{unique}-{name}")
                    entry.size = len(data)
                    tar.addfile(entry, io.BytesIO(data))
                yield pd.DataFrame({"n": [len(group)]})

    I.log_lines(spark, sf).select("file", "value").mapInPandas(pack, "n bigint").agg(F.sum("n")).collect()
    return path


@check("src_3_read_archived_logs", f"with {I.LINES_CTE} select file, value from log_lines")
def _src_3(spark, sf):
    from logweave.sources.archives import read_archived_logs

    lines = read_archived_logs(spark, _write_archives(spark, sf))
    return lines.select(F.regexp_extract("rel_path", r"-(.*)$", 1).alias("file"), "value")


def _by_file(spark, sf):
    """Records with one origin per file."""
    return I.records(spark, sf).withColumn("log_type", F.replace("file", F.lit(".log"), F.lit("")))


_BY_FILE = I.RECORDS_CTE + ", typed as (select * replace (replace(file, '.log', '') as log_type) from records)"


def _store(spark, sf) -> str:
    path = scratch_path(spark, "check-store")
    _by_file(spark, sf).write.partitionBy("log_type", "event_date").parquet(path)
    return path


@check(
    "src_4_read_parsed",
    f"with {_BY_FILE} select log_type, strftime(event_date, '%Y-%m-%d') as event_date, file, line_no, message from typed "
    "where log_type = 'app_1' and trim(coalesce(message, '')) <> ''",
)
def _src_4(spark, sf):
    records = tables.read_parsed(spark, _store(spark, sf), "app_1")
    return records.select("log_type", F.col("event_date").cast("string").alias("event_date"), "file", "line_no", "message")


@check("src_5_list_origins", f"with {_BY_FILE} select distinct log_type from typed")
def _src_5(spark, sf):
    return tables.list_origins(_by_file(spark, sf))


@check("src_5_list_dates", f"with {_BY_FILE} select distinct strftime(event_date, '%Y-%m-%d') as date from typed")
def _src_5_dates(spark, sf):
    return tables.list_dates(_by_file(spark, sf))


@check("src_5_list_log_types", f"with {_BY_FILE} select distinct log_type from typed where event_date = date '2024-01-02'")
def _src_5_types(spark, sf):
    return tables.list_log_types(_by_file(spark, sf), F.lit("2024-01-02").cast("date"))


@check("src_6_sample_lines")
def _src_6(spark, sf):
    return file_source.sample_lines(I.log_lines(spark, sf), 500, seed=7)


@check(
    "src_6_sample_of_lines",
    f"with {I.LINES_CTE}, n as (select least(500, count(*)) as n from log_lines where trim(value) <> '') "
    "select n as sampled, n as different, n as known, 0 as blank from n",
)
def _src_6_of(spark, sf):
    """What must hold of any sample: its size, no line twice, lines of the input only, none of them blank."""
    lines = I.log_lines(spark, sf)
    sample = materialize(file_source.sample_lines(lines, 500, seed=7), "check-sample")
    known = sample.join(lines, ["file", "line_no", "value"], "left_semi").agg(F.count(F.lit(1)).alias("known"))
    own = sample.agg(
        F.count(F.lit(1)).alias("sampled"),
        F.count_distinct("file", "line_no").alias("different"),
        F.count_if(F.trim("value") == "").alias("blank"),
    )
    return storage.one_row(own, known)


# --- stores --------------------------------------------------------------------------------------------------------

# Coarse times make equal (timestamp, message) pairs; half of the files were stored by an earlier run.
_COARSE = (
    I.RECORDS_CTE
    + ", coarse as (select log_type, event_date, concat(left(\"timestamp\", 8), ' 00:00:00.000') as \"timestamp\", message, file, line_no, "
    "case when file in ('app_0.log', 'app_1.log') then 0 else 1 end as is_new from records)"
)


def _coarse(spark, sf):
    return I.records(spark, sf).select(
        "log_type", "event_date", F.concat(F.substring("timestamp", 1, 8), F.lit(" 00:00:00.000")).alias("timestamp"), "message", "file", "line_no"
    )


def _halves(spark, sf):
    rows = _coarse(spark, sf)
    early = F.col("file").isin("app_0.log", "app_1.log")
    return rows.filter(early), rows.filter(~early)


_FIRST = (
    'row_number() over (partition by log_type, event_date, "timestamp", message order by is_new, file, line_no) as rn from coarse'
)


@check(
    "snk_1_merge_daily",
    f"with {_COARSE}, r as (select *, {_FIRST}) select log_type, strftime(event_date, '%Y-%m-%d') as event_date, \"timestamp\", message, file, line_no from r where rn = 1",
)
def _snk_1(spark, sf):
    stored, new = _halves(spark, sf)
    new = materialize(new, "check-new")
    merged = storage.merge_daily(new, storage.affected(stored, new), order=("file", "line_no"))
    kept = stored.join(new.select("event_date").distinct(), "event_date", "left_anti").select(merged.columns)
    whole = merged.unionByName(storage.keep_first(kept, ["log_type", "event_date", "timestamp", "message"], ["file", "line_no"]))
    return whole.withColumn("event_date", F.col("event_date").cast("string"))


@check(
    "snk_1_write_daily_twice",
    f"with {_COARSE}, r as (select *, {_FIRST}) select log_type, strftime(event_date, '%Y-%m-%d') as event_date, \"timestamp\", message, file, line_no from r where rn = 1",
)
def _snk_1_written(spark, sf):
    path = scratch_path(spark, "check-daily")
    stored, new = _halves(spark, sf)
    for part in (stored, new, new):
        storage.write_daily(part, path, order=("file", "line_no"))
    day = F.col("event_date").cast("string").alias("event_date")
    return spark.read.parquet(path).select("log_type", day, "timestamp", "message", "file", "line_no")


@check("win_2_keep_first", f"with {_COARSE}, r as (select *, row_number() over (partition by message order by file, line_no) as rn from coarse) select message, file, line_no from r where rn = 1")
def _win_2(spark, sf):
    return storage.keep_first(_coarse(spark, sf).select("message", "file", "line_no"), ["message"], ["file", "line_no"])


@check(
    "snk_2_daily_json",
    f"with {_BY_FILE} select log_type, coalesce(strftime(event_date, '%Y-%m-%d'), 'sin_fecha') as date, file, line_no, message from typed",
)
def _snk_2(spark, sf):
    """Envelopes written, put together in name order, parsed as one document each, and their records."""
    path = scratch_path(spark, "check-json")
    rows = _by_file(spark, sf).select("log_type", "event_date", "file", "line_no", "timestamp", "message")
    storage.write_daily_json(rows, path, order=("file", "line_no"))
    lines = spark.read.text(path).select(
        "log_type", "event_date", F.struct(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i"), "value").alias("line")
    )
    ordered = F.transform(F.array_sort(F.collect_list("line")), lambda x: x["value"])
    documents = lines.groupBy("log_type", "event_date").agg(F.array_join(ordered, "\n").alias("text"))
    schema = "log_type string, date string, records array<struct<file:string,line_no:bigint,message:string>>"
    return documents.select(F.from_json("text", schema).alias("d")).select("d.log_type", "d.date", F.inline("d.records"))


_TWICE = (
    f"{_BY_FILE}, merged_days as (select log_type, event_date, timestamp, message, min(struct_pack(late := file = 'app_1.log', f := file, n := line_no)) as o "
    "from typed group by all)"
)


def _json_in_two_writes(spark, sf):
    """The records of one file arrive after those of the others, and some days are written again."""
    path = scratch_path(spark, "check-json-merge")
    rows = _by_file(spark, sf).select("log_type", "event_date", "file", "line_no", "timestamp", "message")
    late = F.col("file") == "app_1.log"
    storage.write_daily_json(rows.where(~late), path, order=("file", "line_no"))
    storage.write_daily_json(rows.where(late | (F.col("event_date") == F.lit("2024-01-02"))), path, order=("file", "line_no"))
    return path


@check("snk_2_write_twice_two_days", f"with {_TWICE} select log_type, event_date, o.f as file, o.n as line_no, message from merged_days")
def _snk_2_twice(spark, sf):
    found = storage.read_daily_json(spark, _json_in_two_writes(spark, sf), "file string, line_no bigint, timestamp string, message string")
    return found.select("log_type", "event_date", "file", "line_no", "message")


@check(
    "src_4_read_json",
    f"with {_TWICE} select event_date, o.f as file, o.n as line_no, message from merged_days where log_type = 'app_2' and trim(coalesce(message, '')) <> ''",
)
def _src_4_json(spark, sf):
    records = tables.read_parsed(spark, _json_in_two_writes(spark, sf), "app_2", fmt="json")
    return records.select("event_date", "file", "line_no", "message")


@check(
    "snk_3_source_lineage",
    f"with {_BY_FILE} select log_type, strftime(event_date, '%Y-%m-%d') as event_date, source_file, min(line_no) as first_seen, count(*) as records from typed group by all",
)
def _snk_3(spark, sf):
    """Stored twice, which adds nothing."""
    records = _by_file(spark, sf)
    first = storage.source_lineage(records)
    found = storage.source_lineage(records, first).withColumn("event_date", F.col("event_date").cast("string"))
    return found.select("log_type", "event_date", "source_file", "first_seen", "records")


@check(
    "snk_4_learning_queue",
    f"with {I.PARSED_CTE} select file, count(*) as unmatched_count, min(line_no) as first_line, max(line_no) as last_line from parsed where pattern is null group by file",
)
def _snk_4(spark, sf):
    from checks.parsing import QUERIES as parsing

    return storage.learning_queue(parsing["prs_5_unmatched_lines"](spark, sf))


_RUNS = (
    "select concat('f', o_orderkey, '.log') as rel_path, cast(floor(o_totalprice) as bigint) as size_bytes, o_custkey as records_count, "
    "case when o_orderkey % 7 = 0 then 3 else 0 end as unmatched_lines from orders where o_orderkey % 2 = 0"
)


@check(
    "snk_5_update_registry",
    f"with {I.REGISTRY_CTE}, runs as ({_RUNS}) select coalesce(n.rel_path, r.rel_path) as rel_path, "
    "case when n.rel_path is not null then n.size_bytes else r.size_bytes end as size_bytes, "
    "case when n.rel_path is not null then n.unmatched_lines > 0 else r.needs_reprocessing end as needs_reprocessing, "
    "case when n.rel_path is not null then n.records_count end as records_count, case when n.rel_path is not null then n.unmatched_lines end as unmatched_lines "
    "from registry r full outer join runs n on r.rel_path = n.rel_path",
)
def _snk_5(spark, sf):
    runs = spark.sql(_RUNS.replace("from orders", "from {orders}"), orders=I.table(spark, sf, "orders"))
    old = I.registry(spark, sf).withColumns(
        {"records_count": F.lit(None).cast("bigint"), "unmatched_lines": F.lit(None).cast("int")}
    )
    return storage.update_registry(old, runs)


_REASON = (
    "case when f.incremental then 'incremental' when r.rel_path is null then 'new' when r.needs_reprocessing then 'needs_reprocessing' "
    "when f.size_bytes <> r.size_bytes then 'size_changed' else 'unchanged' end"
)
_SELECTED = f"{I.REGISTRY_CTE}, {I.FILES_CTE}, s as (select f.*, {_REASON} as reason from files f left join registry r on f.rel_path = r.rel_path)"


@check("joi_1_files_to_process", f"with {_SELECTED} select rel_path, size_bytes, incremental, reason, reason <> 'unchanged' as process from s")
def _joi_1(spark, sf):
    return storage.files_to_process(I.files(spark, sf), I.registry(spark, sf))


@check(
    "snk_6_execution_summary",
    f"with {_SELECTED}, p as (select reason <> 'unchanged' as process, case when size_bytes % 97 = 0 then 'unreadable' end as error from s) "
    "select count(*) as total_files, count(*) filter (where process) as files_to_process, count(*) filter (where not process) as files_skipped, "
    "count(*) filter (where process and error is null) as processed_successfully, count(*) filter (where process and error is not null) as errors, "
    "(select count(*) from events) as total_normalized, cast(0 as bigint) as failed_to_normalize, (select count(*) filter (where event_type = 'click') from events) as no_timestamp from p",
)
def _snk_6(spark, sf):
    run = _joi_1(spark, sf).withColumn("error", F.when(F.col("size_bytes") % 97 == 0, "unreadable"))
    stats = I.table(spark, sf, "events").agg(
        F.count(F.lit(1)).alias("normalized"), F.lit(0).cast("bigint").alias("failed"), F.count_if(F.col("event_type") == "click").alias("no_timestamp")
    )
    return storage.execution_summary(run, stats)


@check(
    "snk_6_last_execution",
    "select count(*) as total_executions, max(event_id) as event_id, arg_max(user_id, event_id) as user_id from events",
)
def _snk_6_last(spark, sf):
    history = I.table(spark, sf, "events").select(F.col("event_id").alias("timestamp"), "event_id", "user_id")
    return storage.last_execution(history).drop("timestamp")


# --- search documents ----------------------------------------------------------------------------------------------

_ISO = "regexp_replace(strftime(strptime(raw_timestamp, '%d %b %Y %H:%M:%S,%g'), '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '')"
_DOCS = (
    I.RECORDS_CTE
    + f", docs as (select sha256(concat_ws('|', source_file, coalesce(\"timestamp\", ''), '', coalesce(message, ''))) as _id, {_ISO} as \"@timestamp\", * from records)"
)


def _documents(spark, sf):
    return search.prepare_documents(I.records(spark, sf), F.lit("run"))


@check("snk_7_prepare_documents", f'with {_DOCS} select _id, "@timestamp", "timestamp", log_type, file, pattern, level, user_name, component, message from docs')
def _snk_7(spark, sf):
    return _documents(spark, sf).select(
        "_id", "@timestamp", "timestamp", "log_type", "file", "pattern", "level", F.col("user").alias("user_name"), "component", "message"
    )


@check(
    "snk_7_upsert_documents",
    f"with {_COARSE}, d as (select sha256(concat_ws('|', '', \"timestamp\", '', message)) as _id, file, line_no, row_number() over "
    "(partition by \"timestamp\", message order by is_new desc, line_no desc) as rn from coarse) select _id, file, line_no as line from d where rn = 1",
)
def _snk_7_upsert(spark, sf):
    stored, new = _halves(spark, sf)
    with_id = [
        rows.select(search.document_id(rows).alias("_id"), "file", F.col("line_no").alias("line"), F.col("line_no").alias("seq"))
        for rows in (stored, new)
    ]
    return search.upsert_documents(with_id[1], with_id[0])


_DELETE = "log_type = 'app' and \"@timestamp\" >= '2024-01-05' and \"@timestamp\" <= '2024-01-09T23:59:59.999999'"


@check("snk_8_delete_by_date", f'with {_DOCS} select _id, "@timestamp", file from docs where not ({_DELETE})')
def _snk_8(spark, sf):
    condition = search.where_log_type("app") & search.where_date_range("2024-01-05", "2024-01-09")
    return search.delete_documents(_documents(spark, sf), condition).select("_id", "@timestamp", "file")


@check(
    "snk_8_deletion_counts",
    f"with {_DOCS} select count(*) filter (where source_file = 'app_2.log') as deleted, count(*) filter (where source_file <> 'app_2.log') as remaining from docs",
)
def _snk_8_counts(spark, sf):
    return search.deletion_counts(_documents(spark, sf), search.where_source_file("app_2.log"))


@check("agg_8_counts_by_log_type", f"with {_BY_FILE}, c as (select log_type, count(*) as count from typed group by log_type) select log_type, count, round(count * 100.0 / sum(count) over (), 2) as percentage from c")
def _agg_8(spark, sf):
    return metrics.counts_by_log_type(_by_file(spark, sf))


# --- serving -------------------------------------------------------------------------------------------------------


@check(
    "prs_12_search_records",
    f"with {I.RECORDS_CTE} select file, line_no, message from records where contains(lower(coalesce(message, '')), 'user u1') or contains(log_type, 'user u1') or contains(lower(coalesce(component, '')), 'user u1') or contains(lower(coalesce(message,'')), 'request')",
)
def _prs_12(spark, sf):
    rows = I.records(spark, sf)
    hits = serve.search_records(rows, "User U1").union(serve.search_records(rows, "REQUEST"))
    return hits.select("file", "line_no", "message").distinct()


@check("prs_13_filter_records", f"with {_BY_FILE} select file, line_no, message from typed where event_date = date '2024-01-03' and log_type = 'app_3'")
def _prs_13(spark, sf):
    return serve.filter_records(spark.read.parquet(_store(spark, sf)), "2024-01-03", "app_3").select("file", "line_no", "message")


@check(
    "top_2_page",
    f"with {I.RECORDS_CTE} select file, line_no, \"timestamp\" from records order by strptime(raw_timestamp, '%d %b %Y %H:%M:%S,%g'), file, line_no limit 50 offset 150",
)
def _top_2(spark, sf):
    return serve.page(I.records(spark, sf), 4).select("file", "line_no", "timestamp")


@check("top_2_page_totals", f"with {I.RECORDS_CTE} select count(*) as total, cast(greatest(1, ceil(count(*) / 50.0)) as bigint) as total_pages from records")
def _top_2_totals(spark, sf):
    return serve.page_totals(I.records(spark, sf))


@check("top_6_recent_documents", f'with {_DOCS} select "@timestamp", file, message from docs order by "@timestamp" desc, _id limit 5')
def _top_6(spark, sf):
    return serve.recent_documents(_documents(spark, sf)).select("@timestamp", "file", "message")


# --- metrics -------------------------------------------------------------------------------------------------------

_PHASES = (
    I.TIMINGS_CTE
    + ", per_file as (select log_type, rel_path, sum(seconds) as seconds from timings group by all), "
    "phases as (select log_type, phase, seconds from timings union all select log_type, 'total', seconds from per_file)"
)


@check(
    "agg_1_phase_metrics",
    f"with {_PHASES} select case when grouping(log_type) = 1 then 'global' else log_type end as log_type, phase, round(sum(seconds), 4) as sum, "
    "round(cast(sum(seconds) as double) / count(*), 4) as avg, round(min(seconds), 4) as min, round(max(seconds), 4) as max, count(*) as count "
    "from phases group by grouping sets ((phase, log_type), (phase))",
)
def _agg_1(spark, sf):
    return metrics.phase_metrics(I.timings(spark, sf))


_COUNTS = "counts as (select log_type, rel_path, count(*) * 1000 as records from timings group by all)"


@check(
    "agg_1_throughput",
    f"with {_PHASES}, {_COUNTS} select case when grouping(p.log_type) = 1 then 'global' else p.log_type end as log_type, count(*) as files_count, "
    "cast(sum(records) as bigint) as records_count, round(cast(sum(seconds) as double) / count(*), 4) as avg_seconds_per_file, "
    "round(cast(sum(seconds) as double) / sum(records), 6) as avg_seconds_per_record "
    "from per_file p join counts c on p.log_type = c.log_type and p.rel_path = c.rel_path group by rollup(p.log_type)",
)
def _agg_1_throughput(spark, sf):
    timings = I.timings(spark, sf)
    counts = timings.groupBy("log_type", "rel_path").agg((F.count(F.lit(1)) * 1000).alias("records"))
    return metrics.throughput(timings, counts)


@check("agg_7_origin_summary",
    f"with {I.PARSED_CTE}, l as (select file as origin, count(*) as lines from log_lines group by file), "
    "k as (select file as origin, count(*) as kept from kept group by file), "
    "c as (select file as origin, count(distinct message) as clusters from parsed where message is not null group by file), "
    "j as (select l.origin, lines, lines - kept as ignored, kept as processed, clusters from l join k on l.origin = k.origin join c on c.origin = l.origin) "
    "select case when grouping(origin) = 1 then 'total' else origin end as origin, count(*) as files, cast(sum(lines) as bigint) as lines, cast(sum(ignored) as bigint) as ignored, "
    "cast(sum(processed) as bigint) as processed, cast(sum(clusters) as bigint) as clusters from j group by rollup(origin)")
def _agg_7(spark, sf):
    from logweave.functions.text import keep_line

    lines = I.log_lines(spark, sf)
    kept = keep_line(F.col("value"), I.APP.ignore)
    per_file = lines.groupBy(F.col("file").alias("origin")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(~kept).alias("ignored"), F.count_if(kept).alias("processed")
    )
    clusters = I.records(spark, sf).select(F.col("file").alias("origin"), "message").filter("message is not null").distinct()
    return metrics.origin_summary(per_file, clusters)


@check(
    "agg_6_coverage_report",
    f"with {I.PARSED_CTE}, s as (select case when pattern is not null then message end as event_id from parsed) "
    "select count(*) as total_lines, count(event_id) as matched_lines, round(count(event_id) * 100.0 / count(*), 2) as coverage_pct, "
    "(select count(distinct event_id) from s) as num_templates, (select max(n) from (select count(*) as n from s where event_id is not null group by event_id)) as largest_cluster_size from s",
)
def _agg_6(spark, sf):
    from logweave.operators.events import parse_lines

    parsed = parse_lines(I.log_lines(spark, sf), I.APP, key="file")
    structured = parsed.records.select(F.col("message").alias("event_id")).unionByName(
        parsed.unmatched.select(F.lit(None).cast("string").alias("event_id"))
    )
    return metrics.coverage_report(structured, parsed.records.select("message").filter("message is not null").distinct())


_CATALOGUE_DUCK = [re.sub(r"\(\?P<\w+>", "(", p) for p in metrics.TIMESTAMP_CATALOGUE]


@check(
    "agg_9_timestamp_format_coverage",
    f"with {I.LINES_CTE}, c as ("
    + " union all ".join(
        f"select {i} as ord, count(*) filter (where regexp_matches(value, '{p}')) as hits, count(*) as n from log_lines"
        for i, p in enumerate(_CATALOGUE_DUCK)
    )
    + "), s as (select ord, hits, hits / n as coverage, row_number() over (order by hits desc, ord) as r from c) "
    "select ord, hits, round(coverage, 6) as coverage, r = 1 and coverage >= 0.66 as best from s",
)
def _agg_9(spark, sf):
    return metrics.timestamp_format_coverage(I.log_lines(spark, sf)).withColumn("coverage", F.round("coverage", 6))


_STAMP = _CATALOGUE_DUCK[3]
_BEHIND = f"substr(value, length(regexp_extract(value, '{_STAMP}')) + 1)"


@check(
    "agg_10_level_word_coverage",
    f"with {I.LINES_CTE}, w as (select case "
    + " ".join(f"when regexp_matches({_BEHIND}, '\\b{w}\\b') then '{w}'" for w in metrics.LEVEL_WORDS)
    + f" end as word from log_lines where regexp_matches(value, '{_STAMP}')) select word, count(*) as lines from w where word is not null group by word",
)
def _agg_10(spark, sf):
    return metrics.level_word_coverage(I.log_lines(spark, sf), metrics.TIMESTAMP_CATALOGUE[3])


@check(
    "agg_11_group_size_stats",
    "with s as (select label, count(*) as n from embeddings group by label) select count(*) as n_groups, max(n) as max_group_size, min(n) as min_group_size, "
    "round(avg(n), 2) as mean_group_size, cast(median(n) as double) as median_group_size, count(*) filter (where n = 1) as singleton_groups from s",
)
def _agg_11(spark, sf):
    return metrics.group_size_stats(I.vectors(spark, sf))


@check(
    "agg_12_origin_file_counts",
    f"with n as (select {_TYPE} as origin from (select {_NAMES} as name from orders)) select origin, count(*) as files from n group by origin",
)
def _agg_12(spark, sf):
    return metrics.origin_file_counts(_prs_1(spark, sf).withColumnRenamed("log_type", "origin"))


@check(
    "agg_13_group_totals",
    "select label as group_id, count(*) as num_members, cast(sum(vec_id) as bigint) as total_size from embeddings group by label",
)
def _agg_13(spark, sf):
    return metrics.group_totals(I.vectors(spark, sf).select(F.col("label").alias("group_id"), F.col("id").alias("size")))


@check(
    "agg_14_reduction_report",
    "with g as (select vec_id, label from embeddings where label <> 3) select count(distinct e.vec_id) as clusters, count(distinct g.label) as groups, "
    "count(*) filter (where g.vec_id is null) as ungrouped, round((1 - count(distinct g.label) / count(distinct e.vec_id)) * 100, 2) as reduction_pct "
    "from embeddings e left join g on e.vec_id = g.vec_id",
)
def _agg_14(spark, sf):
    vectors = I.vectors(spark, sf).select(F.col("id").alias("cluster_id"), F.col("label").alias("group_id"))
    return metrics.reduction_report(vectors, vectors.filter("group_id <> 3"))


# --- set operations ------------------------------------------------------------------------------------------------


@check(
    "set_1_concatenate_days",
    f"with {_COARSE} select log_type, message, file, line_no, is_new from coarse",
)
def _set_1(spark, sf):
    stored, new = _halves(spark, sf)
    both = stored.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)), allowMissingColumns=True)
    return both.select("log_type", "message", "file", "line_no", "is_new")


@check("set_3_missing_origins", f"with {I.PARSED_CTE} select distinct concat('app_', o_orderkey % 9, '.log') as log_type from orders except select file from parsed")
def _set_3(spark, sf):
    requested = I.table(spark, sf, "orders").select(F.concat(F.lit("app_"), F.col("o_orderkey") % 9, F.lit(".log")).alias("log_type"))
    return storage.missing_origins(requested, I.log_lines(spark, sf).select(F.col("file").alias("log_type")))


@check("joi_8_records_of_run", f"with {_BY_FILE} select file, line_no, message from typed where file in (select concat('app_', o_orderkey % 2, '.log') from orders)")
def _joi_8(spark, sf):
    results = I.table(spark, sf, "orders").select(F.concat(F.lit("app_"), F.col("o_orderkey") % 2, F.lit(".log")).alias("file"))
    return classify.records_of_run(_by_file(spark, sf), results, "file").select("file", "line_no", "message")


_HEADER = I.APP_BLOCKS.headers[0][1]
for _group in ("timestamp", "level", "user", "component"):
    _HEADER = _HEADER.replace(f"?P<{_group}>", "")


# --- streaming -----------------------------------------------------------------------------------------------------


@check("str_1_stream_log_tail", f"with {I.LINES_CTE} select file, value from log_lines")
def _str_1(spark, sf):
    """Files followed by a stream until nothing is left, twice: the second run finds nothing new."""
    from logweave.streaming.tail import stream_log_tail

    logs, target = _text_files(spark, sf, numbered=False), scratch_path(spark, "check-tail")
    for _ in range(2):
        query = (
            stream_log_tail(spark, logs.removeprefix("file:"), ".txt", range_bytes=1 << 16)
            .writeStream.format("parquet")
            .option("path", f"{target}/out")
            .option("checkpointLocation", f"{target}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    lines = spark.read.parquet(f"{target}/out")
    return lines.select(F.regexp_extract("file_path", _FOLDER, 1).alias("file"), "value")


@check(
    "str_4_stream_dedup_daily",
    f"with {I.RECORDS_CTE} select distinct strftime(event_date, '%Y-%m-%d') as event_date, \"timestamp\", message from records",
)
def _str_4(spark, sf):
    """Files followed, parsed, enriched and merged into the day store."""
    from logweave.streaming.incremental import start_incremental
    from logweave.streaming.tail import stream_log_tail

    logs, target = _text_files(spark, sf, numbered=False), scratch_path(spark, "check-stream")
    stream = stream_log_tail(spark, logs.removeprefix("file:"), ".txt")
    start_incremental(stream, I.APP, f"{target}/store", f"{target}/state", f"{target}/checkpoint", 2024).awaitTermination()
    stored = spark.read.parquet(f"{target}/store")
    return stored.select(F.col("event_date").cast("string").alias("event_date"), "timestamp", "message")


def _whole_files(spark, sf) -> str:
    """Log lines, one text file per ``file``."""
    path = scratch_path(spark, "check-growing")
    lines = I.log_lines(spark, sf).repartition("file").sortWithinPartitions("file", "line_no")
    lines.select("file", "value").write.partitionBy("file").text(path)
    return path.removeprefix("file:")


@check(
    "str_2_hold_open_event",
    f"with {I.LINES_CTE} select file, arg_max(value, line_no) filter (regexp_matches(value, '{_HEADER}')) as held from log_lines group by file",
)
def _str_2(spark, sf):
    """After a stream in several batches, what is held of each file begins with its last header."""
    from logweave.streaming.incremental import follow_tail
    from logweave.streaming.tail import listed_sizes

    logs, target = _whole_files(spark, sf), scratch_path(spark, "check-held")
    budget = sum(listed_sizes(logs, ".txt").values()) // 3 + 1
    batches = follow_tail(spark, logs, I.APP_BLOCKS, f"{target}/store", f"{target}/state", ".txt", max_bytes=budget, year=2024)
    held = spark.read.parquet(f"{target}/state/held/open/batch={batches - 1}")
    return held.groupBy(F.regexp_extract("file_path", _FOLDER, 1).alias("file")).agg(F.min_by("value", "line_no").alias("held"))


@check(
    "str_3_stream_parse_enrich",
    f"with {I.RECORDS_CTE} select distinct strftime(event_date, '%Y-%m-%d') as event_date, \"timestamp\", {_LEVELS} as level, message from records",
)
def _str_3(spark, sf):
    """Parsed and enriched in batches of a third of the bytes, which may end inside a line."""
    from logweave.streaming.incremental import follow_tail
    from logweave.streaming.tail import listed_sizes

    logs, target = _whole_files(spark, sf), scratch_path(spark, "check-batches")
    budget = sum(listed_sizes(logs, ".txt").values()) // 3 + 1
    follow_tail(spark, logs, I.APP, f"{target}/store", f"{target}/state", ".txt", max_bytes=budget, year=2024)
    stored = spark.read.parquet(f"{target}/store")
    return stored.select(F.col("event_date").cast("string").alias("event_date"), "timestamp", "level", "message").distinct()


@check(
    "str_5_growing_or_closed",
    f"with {I.LINES_CTE} select distinct file, 'batch' as way from log_lines union all select distinct concat('listener', file), 'stream' from log_lines",
)
def _str_5(spark, sf):
    """Two formats whose file names say nothing: each file is read in one way, by its content."""
    from logweave.plans.parsing_run import follow_growing, parse_folder

    logs, target = scratch_path(spark, "check-routes"), scratch_path(spark, "check-routed")
    lines = I.log_lines(spark, sf).where("value not like 'no header%'")
    stamp = F.date_format(F.timestamp_seconds(F.col("line_no") + F.lit(1_700_000_000)), "dd-MMM-yyyy HH:mm:ss")
    other = lines.select(F.concat(F.lit("listener"), "file").alias("file"), "line_no", F.concat(stamp, F.lit(" * job "), "line_no").alias("value"))
    both = lines.unionByName(other).repartitionByRange("file", "line_no").sortWithinPartitions("file", "line_no")
    both.select("file", "value").write.partitionBy("file").text(logs)
    logs = logs.removeprefix("file:")
    run = parse_folder(spark, logs, year=2024, suffix=".txt", growing=False)
    follow_growing(spark, logs, f"{target}/store", f"{target}/state", 2024, ".txt")
    file = F.regexp_extract("file_path", _FOLDER, 1).alias("file")
    batch = run.records.select(file, F.lit("batch").alias("way")).distinct()
    return batch.unionByName(spark.read.parquet(f"{target}/store").select(file, F.lit("stream").alias("way")).distinct())
