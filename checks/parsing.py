"""Queries for detection, lines, events, enrichment and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs as I
from logweave.functions import entities, levels, masking, text
from logweave.functions.timestamps import event_date, generic_timestamp, iso_timestamp, normalize_timestamp
from logweave.operators import detect, enrich, events, metrics
from logweave.rules.masks import CUSTOM_MASKS, DOMAIN_MASKS
from logweave.rules.origins import AIS, BY_NAME

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def register(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return query

    return register


# File names of every known kind, one per order.
_NAMES = (
    "case o_orderkey % 9 when 0 then concat('ais_', o_orderkey, '.log') when 1 then concat('alert_jde_', o_orderkey, '.log') "
    "when 2 then concat('COV_BSSV_', o_orderkey, '.log') when 3 then concat('e1root_', o_orderkey, '.LOG') "
    "when 4 then concat('jas_', o_orderkey, '.log') when 5 then concat('ged_jde_', o_orderkey) "
    "when 6 then concat('listener.', o_orderkey) when 7 then concat('Server', o_orderkey, '.txt') "
    "else concat('jdedebug_', o_orderkey, '.log') end"
)
_TYPE = "case {cases} else 'unknown' end".format(
    cases=" ".join(
        f"when regexp_matches(name, '(?i)(?:{'|'.join(f'(?:{p})' for p in o.filenames)})') then '{o.name}'"
        for o in detect.ORIGINS
    )
)


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return I.table(spark, sf, "orders").selectExpr(f"{_NAMES} as name")


@check("prs_1_detect_type_by_name", f"with n as (select {_NAMES} as name from orders) select name, {_TYPE} as log_type from n")
def _prs_1(spark, sf):
    return _names(spark, sf).select("name", detect.type_by_name(F.col("name")).alias("log_type"))


@check(
    "prs_3_origin_fallback_name",
    f"with n as (select {_NAMES} as name from orders) select name, lower(replace(replace(name, '.log', ''), '.txt', '')) as origin from n",
)
def _prs_3(spark, sf):
    return _names(spark, sf).select("name", detect.fallback_name(F.col("name")).alias("origin"))


_SAFE = [o for o in detect.content_order() if o.name in ("ais", "e1root", "jas", "listener")]
_HEADERS = {
    o.name: "|".join(f"(?:{p})" for _, p in o.headers).replace("'", "''") for o in _SAFE
}


@check(
    "prs_2_detect_type_by_content",
    f"with {I.LINES_CTE}, ranked as (select file, min(case "
    + " ".join(f"when regexp_matches(value, '{_HEADERS[o.name]}') then {i}" for i, o in enumerate(_SAFE))
    + " end) as r from log_lines group by file) select file, coalesce(case r "
    + " ".join(f"when {i} then '{o.name}'" for i, o in enumerate(_SAFE))
    + " end, 'unknown') as log_type from ranked",
)
def _prs_2(spark, sf):
    return detect.detect_by_content(I.log_lines(spark, sf), _SAFE, key="file")


@check("prs_4_drop_ignored_lines", f"with {I.KEPT_CTE} select file, line_no, value from kept")
def _prs_4(spark, sf):
    lines = I.log_lines(spark, sf)
    return lines.filter((F.trim("value") != "") & text.keep_line(F.col("value"), AIS.ignore))


@check(
    "prs_5_parse_single_line",
    f"with {I.PARSED_CTE} select file, line_no, log_type, pattern, raw_timestamp, level, user_name, component, message "
    "from parsed where pattern is not null",
)
def _prs_5(spark, sf):
    return I.records(spark, sf).select(
        "file", "line_no", "log_type", "pattern", "raw_timestamp", "level", F.col("user").alias("user_name"), "component", "message"
    )


@check(
    "prs_5_unmatched_lines",
    f"with {I.PARSED_CTE} select file, line_no, log_type, value as raw_line from parsed where pattern is null",
)
def _prs_5_unmatched(spark, sf):
    return events.parse_lines(I.log_lines(spark, sf), I.APP, key="file").unmatched


_START = "^[A-M]"


def _numbered(spark, sf):
    return events.number_events(I.log_multiline(spark, sf), F.col("value").rlike(_START), key="file", block_rows=64)


_NUMBERED = (
    I.MULTILINE_CTE
    + f", numbered as (select *, cast(sum(case when regexp_matches(value, '{_START}') then 1 else 0 end) over "
    "(partition by file order by line_no rows unbounded preceding) as bigint) as event_no from log_multiline)"
)


@check("win_1_running_event_number", f"with {_NUMBERED} select file, line_no, event_no from numbered")
def _win_1(spark, sf):
    return _numbered(spark, sf).select("file", "line_no", "event_no")


_EVENTS = (
    _NUMBERED
    + ", grouped as (select file, event_no, min(line_no) as line_no, count(*) as n_lines, "
    "string_agg(value, chr(10) order by line_no) as text from numbered group by file, event_no)"
)


@check("prs_6_split_events_by_header", f"with {_EVENTS} select file, event_no, line_no, n_lines, text from grouped")
def _prs_6(spark, sf):
    return events.collect_events(_numbered(spark, sf), key="file")


_BLOCK_HEADER = I.APP_BLOCKS.headers[0][1].replace("?P<timestamp>", "").replace("?P<level>", "").replace(
    "?P<user>", "").replace("?P<component>", "")
_IGNORED = I.IGNORE_SQL


@check(
    "prs_6_parse_multi_line",
    f"with {I.LINES_CTE}, n as (select *, regexp_matches(value, '{_BLOCK_HEADER}') as h from log_lines), "
    "e as (select *, sum(case when h then 1 else 0 end) over (partition by file order by line_no rows unbounded preceding) as event_no from n), "
    f"b as (select *, case when h then regexp_replace(value, '{_BLOCK_HEADER}', '') else value end as part from e where event_no > 0), "
    f"k as (select *, regexp_matches(part, '{_IGNORED}') as drop_it from b) "
    "select file, min(line_no) as line_no, 'app_block' as pattern, "
    f"max(case when h then regexp_extract(value, '{_BLOCK_HEADER}', 2) end) as level, "
    "string_agg(part, chr(10) order by line_no) filter (where not drop_it) as message from k "
    "group by file, event_no having count(*) filter (where not drop_it) > 0",
)
def _prs_6_parse(spark, sf):
    parsed = events.parse_lines(I.log_lines(spark, sf), I.APP_BLOCKS, key="file")
    return parsed.records.select("file", "line_no", "pattern", "level", "message")


_DATES = (r"\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{4}\s+\d{2}:\d{2}:\d{2}[,.]\d{3}",)


@check(
    "prs_7_split_events_by_timestamp",
    f"with {I.LINES_CTE}, n as (select *, regexp_matches(left(value, 45), '^.{{0,20}}?{_DATES[0]}') as h from log_lines), "
    "e as (select *, cast(sum(case when h then 1 else 0 end) over (partition by file order by line_no rows unbounded preceding) as bigint) as event_no from n) "
    "select file, event_no, min(line_no) as line_no, count(*) as n_lines, string_agg(value, chr(10) order by line_no) as text from e group by file, event_no",
)
def _prs_7(spark, sf):
    return events.split_events_by_timestamp(I.log_lines(spark, sf), _DATES, key="file")


@check(
    "prs_8_grouping_stats",
    f"with {_EVENTS} select file, count(*) as multiline_groups, cast(sum(n_lines - 1) as bigint) as continuation_lines from grouped group by file",
)
def _prs_8(spark, sf):
    return events.grouping_stats(events.collect_events(_numbered(spark, sf), key="file"), key="file")


@check(
    "win_3_message_range",
    f"with {I.MULTILINE_CTE} select file, line_no, lead(line_no) over (partition by file order by line_no) as next_line_no "
    f"from log_multiline where regexp_matches(value, '{_START}')",
)
def _win_3(spark, sf):
    return events.message_ranges(I.log_multiline(spark, sf), F.col("value").rlike(_START), key="file", block_rows=64)


@check(
    "win_4_hold_last_event",
    f"with {_EVENTS} select file, event_no, event_no = max(event_no) over (partition by file) as held from grouped",
)
def _win_4(spark, sf):
    held = events.hold_last_event(events.collect_events(_numbered(spark, sf), key="file"), key="file")
    return held.select("file", "event_no", "held")


# Separators in front of some texts: the documents have none of their own.
_SEPARATED = "case when doc_id % 3 = 0 then concat('=====', chr(10), '  -------  ', chr(10), text) when doc_id % 3 = 1 then concat(text, chr(10), '*****') else text end"


@check(
    "prs_9_strip_leading_separators",
    rf"select doc_id, trim(regexp_replace({_SEPARATED}, '\A(?:[^\S\n]*[*=\-]{{5,}}[^\S\n]*(?:\n|\z))+', ''), chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) as message from documents",
)
def _prs_9(spark, sf):
    docs = I.table(spark, sf, "documents").selectExpr("doc_id", f"{_SEPARATED} as message")
    return docs.select("doc_id", text.strip_leading_separators(F.col("message")).alias("message"))


_LINE_RULES = ("^[A-C]", "zzz", r"\.$")


@check(
    "prs_10_filter_message_lines",
    "with l as (select doc_id, string_split(text, chr(10)) as parts from documents), "
    "k as (select doc_id, array_to_string(list_filter(parts, lambda p: not regexp_matches(p, '(?:^[A-C])|(?:zzz)|(?:\\.$)')), chr(10)) as t from l) "
    "select doc_id, nullif(trim(t, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)), '') as message from k",
)
def _prs_10(spark, sf):
    docs = I.table(spark, sf, "documents")
    return docs.select("doc_id", text.filter_message_lines(F.col("text"), _LINE_RULES).alias("message"))


@check(
    "prs_11_condense_trace_json",
    "select event_id, concat('x ORCHESTRATION TRACING: [{\"type\":\"', event_type, '\",\"name\":\"n', cast(user_id as varchar), '\",\"output\":\"', "
    "cast(event_id as varchar), '\"},{\"type\":\"t2\",\"name\":\"\",\"output\":\"', event_type, '\"}]  ') as line from events",
)
def _prs_11(spark, sf):
    lines = I.table(spark, sf, "events").selectExpr(
        "event_id",
        "concat('x ORCHESTRATION TRACING: [{\"input\":{\"a\":1},\"type\":\"', event_type, '\",\"name\":\"n', user_id, '\",\"output\":\"', event_id, "
        "'\"}, {\"type\":\"t2\", \"output\":\"', event_type, '\",\"token\":\"s\"}]  ') as line",
    )
    return lines.select("event_id", text.condense_trace_json(F.col("line")).alias("line"))


# --- scalars -------------------------------------------------------------------------------------------------------

_FORMATS = [
    # (Spark date_format, DuckDB strftime, has a fraction, names its own year)
    ("dd-MMM-yyyy HH:mm:ss", "%d-%b-%Y %H:%M:%S", False),
    ("EEE MMM dd HH:mm:ss.SSSSSS", "%a %b %d %H:%M:%S.%f", True),
    ("MMM dd HH:mm:ss.SSSSSS", "%b %d %H:%M:%S.%f", True),
    ("dd MMM yyyy HH:mm:ss,SSS", "%d %b %Y %H:%M:%S,%g", True),
    ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "%Y-%m-%dT%H:%M:%S.%f", True),
    ("dd/MM/yyyy HH:mm:ss", "%d/%m/%Y %H:%M:%S", False),
    ("MMM dd HH:mm:ss", "%b %d %H:%M:%S", False),
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S", None),
]


def _stamps(spark, sf):
    raw = F.lit(None).cast("string")
    for i, (fmt, _, _) in enumerate(_FORMATS):
        raw = F.when(F.col("event_id") % len(_FORMATS) == i, F.date_format("ts", fmt)).otherwise(raw)
    return I.table(spark, sf, "events").select("event_id", raw.alias("raw"))


_RAW = "case event_id % 8 " + " ".join(f"when {i} then strftime(ts, '{d}')" for i, (_, d, _) in enumerate(_FORMATS)) + " end"
_EXPECTED = "case event_id % 8 " + " ".join(
    f"when {i} then " + ("null" if frac is None else f"strftime(ts, '%d/%m/%y %H:%M:%S.{'%g' if frac else '000'}')")
    for i, (_, _, frac) in enumerate(_FORMATS)
) + " end"


@check("enr_1_normalize_timestamp", f'select event_id, {_RAW} as raw, {_EXPECTED} as "timestamp" from events')
def _enr_1(spark, sf):
    return _stamps(spark, sf).select("event_id", "raw", normalize_timestamp(F.col("raw"), 2024).alias("timestamp"))


@check(
    "enr_2_normalization_stats",
    f"with s as (select {_RAW} as raw, {_EXPECTED} as t from events) select count(*) as total, count(t) as normalized, "
    "count(*) - count(t) as failed, cast(0 as bigint) as no_timestamp from s",
)
def _enr_2(spark, sf):
    stamped = _stamps(spark, sf).withColumn("timestamp", normalize_timestamp(F.col("raw"), 2024))
    return enrich.normalization_stats(stamped, "raw")


_GENERIC = "case event_id % 8 " + " ".join(
    [
        "when 0 then strftime(ts, '%d/%m/%y %H:%M:%S.000')",
        "when 1 then strftime(ts, '%d/%m/26 %H:%M:%S.%g')",
        "when 2 then strftime(ts, '%d/%m/26 %H:%M:%S.000')",
        "when 3 then strftime(ts, '%d/%m/%y %H:%M:%S.%g')",
        "when 4 then null",
        "when 5 then strftime(ts, '%d/%m/%y %H:%M:%S.000')",
        "when 6 then strftime(ts, '%d/%m/26 %H:%M:%S.000')",
        "else strftime(ts, '%d/%m/%y %H:%M:%S.000')",
    ]
) + " end"


@check("enr_3_generic_timestamp", f'select event_id, {_GENERIC} as "timestamp" from events')
def _enr_3(spark, sf):
    return _stamps(spark, sf).select("event_id", generic_timestamp(F.col("raw")).alias("timestamp"))


@check("enr_4_event_date", f"select event_id, strftime(case when ({_EXPECTED}) is not null then ts end, '%Y-%m-%d') as event_date from events")
def _enr_4(spark, sf):
    normal = _stamps(spark, sf).withColumn("timestamp", normalize_timestamp(F.col("raw"), 2024))
    return normal.select("event_id", event_date(F.col("timestamp")).cast("string").alias("event_date"))


_EXTRACTED = (
    I.RECORDS_CTE
    + r", x as (select file, line_no, nullif(regexp_extract(message, '(?i)(ORA-\d+)', 1), '') as ora, "
    r"nullif(regexp_extract(message, '(?i)PROTOCOL=tcp\)\(HOST=([^\)]+)', 1), '') as ip, "
    r"nullif(regexp_extract(message, '(?i)PROTOCOL=tcp\)\(HOST=[^\)]+\)\(PORT=(\d+)', 1), '') as port, "
    r"nullif(regexp_extract(message, '(?i)User[:\s]+([A-Z0-9_-]+)', 1), '') as u from records)"
)


@check(
    "enr_5_extract_entities",
    f"with {_EXTRACTED} select file, line_no, ora as ora_error_code, ip as host_ip, "
    "case when cast(port as bigint) <= 65535 then port end as port, u as username from x",
)
def _enr_5(spark, sf):
    found = entities.extract_entities(I.records(spark, sf), I.APP.extractors)
    names = ["ora_error_code", "host_ip", "port", "username"]
    # Every extractor finds at most one distinct value in these lines.
    return found.select("file", "line_no", *[F.array_join(F.col("extracted")[n], "|").alias(n) for n in names])


@check(
    "enr_6_default_component",
    f"with {I.RECORDS_CTE} select file, line_no, coalesce(nullif(case when line_no % 2 = 0 then '' when line_no % 3 = 0 then null else component end, ''), 'CORE') as component from records",
)
def _enr_6(spark, sf):
    gaps = F.when(F.col("line_no") % 2 == 0, "").when(F.col("line_no") % 3 == 0, None).otherwise(F.col("component"))
    return I.records(spark, sf).select("file", "line_no", levels.default_component(gaps, "CORE").alias("component"))


_MAP = "case upper(trim(level)) " + " ".join(f"when '{k}' then '{v}'" for k, v in AIS.levels.items()) + " else level end"


@check("enr_7_map_level", f"with {I.RECORDS_CTE} select file, line_no, {_MAP} as level from records")
def _enr_7(spark, sf):
    return I.records(spark, sf).select("file", "line_no", levels.map_level(F.col("level")).alias("level"))


_ERR = "|".join(f"(?:{p})" for p in levels.IMPLICIT_ERROR).replace("'", "''")
_WARN = "|".join(f"(?:{p})" for p in levels.IMPLICIT_WARN)
_IMPLICIT = (
    f"case when coalesce(level, '') <> '' then level when regexp_matches(message, '(?i){_ERR}') then 'ERROR' "
    f"when regexp_matches(message, '(?i){_WARN}') then 'WARN' else 'INFO' end"
)


@check("enr_8_implicit_level", f"with {I.RECORDS_CTE} select file, line_no, {_IMPLICIT} as level from records")
def _enr_8(spark, sf):
    return I.records(spark, sf).select("file", "line_no", levels.implicit_level(F.col("level"), F.col("message")).alias("level"))


@check(
    "enr_9_extracted_json",
    f"with {_EXTRACTED} select file, line_no, case when ora is null then '{{}}' else concat('{{\"ora_error_code\":[\"', ora, '\"]}}') end as body, ora as back from x",
)
def _enr_9(spark, sf):
    found = entities.extract_entities(I.records(spark, sf), I.APP.extractors[:1])
    body = found.withColumn("body", entities.extracted_to_json(F.col("extracted")))
    back = entities.json_to_extracted(F.col("body"))["ora_error_code"]
    return body.select("file", "line_no", "body", F.array_join(back, "|").alias("back"))


_RESULT = (
    "case o_orderkey % 4 when 0 then concat('out/2024_01_', lpad(cast(o_orderkey % 28 + 1 as {s}), 2, '0'), '_alert_jde.parquet') "
    "when 1 then concat('out/sin_fecha_t', cast(o_orderkey % 5 as {s}), '.json') when 2 then concat('out/2024_1_', cast(o_orderkey as {s})) "
    "else concat('2023_12_31_e1_root', cast(o_orderkey % 3 as {s}), '.parquet') end"
)


@check(
    "enr_10_parse_result_name",
    f"with n as (select o_orderkey, regexp_replace(regexp_extract({_RESULT.format(s='varchar')}, '([^/]*)$', 1), '\\.[^.]*$', '') as stem from orders) "
    "select o_orderkey, case when starts_with(stem, 'sin_fecha_') then 'sin_fecha' else nullif(regexp_replace(regexp_extract(stem, '^(\\d+_\\d+_\\d+)_', 1), '_', '-', 'g'), '') end as date, "
    "case when starts_with(stem, 'sin_fecha_') then substr(stem, 11) else nullif(regexp_extract(stem, '^\\d+_\\d+_\\d+_(.*)$', 1), '') end as log_type from n",
)
def _enr_10(spark, sf):
    names = I.table(spark, sf, "orders").selectExpr("o_orderkey", f"{_RESULT.format(s='string')} as path")
    date, log_type = text.parse_result_name(F.col("path"))
    return names.select("o_orderkey", date.alias("date"), log_type.alias("log_type"))


# RE2 has neither look-around nor back-references, so the oracle covers the masks without them.
_CUSTOM_SAFE = [(p, r) for p, r in CUSTOM_MASKS if r in ("<ALPHANUM>", "<IP>", "<UUID>", "<NUM>", "<HEX>", "<PATH>", "<URL_WITH_QUERY>", "<JWT>", "<LONG_LIST>")]
_DOMAIN_SAFE = [
    (p, f"<{n}>")
    for p, n in DOMAIN_MASKS
    if n in ("LIBCODE", "JDECODE", "CONTEXT_ID", "JWT", "LONG_LIST", "URL_WITH_QUERY", "UUID", "IP", "HEX", "PATH", "ALPHANUM", "NUM")
]
# Literals the texts do not hold.
_LITERALS = (
    "' https://h.example/p?q=1 eyJhbGciOi.eyJzdWIi.c2ln (1, 2, 3, 4, 5, 6, 77) 0x1F 10.20.30.40 LIB1234567 P123456 Context ID: 1.2:3 "
    "/var/log/42 123e4567-e89b-12d3-a456-426614174000 12. x'"
)


def _nested(masks, column: str) -> str:
    for pattern, replacement in masks:
        column = f"regexp_replace({column}, '{pattern.replace(chr(39), chr(39) * 2)}', '{replacement}', 'g')"
    return column


_ASCII = "regexp_replace(message, '[^ -~\\s]', 'e', 'g')"


def _ascii(spark, sf):
    # RE2 knows ASCII words only; letters beyond it stand in as one letter on both sides.
    plain = F.regexp_replace("message", r"[^ -~\s]", "e")
    return I.mask_input(spark, sf).select("kind", "id", F.concat(plain, F.expr(_LITERALS)).alias("message"))


@check("enr_11_mask_custom", f"with {I.MASK_CTE} select kind, id, {_nested(_CUSTOM_SAFE, f'concat({_ASCII}, {_LITERALS})')} as masked from mask_input")
def _enr_11(spark, sf):
    return _ascii(spark, sf).select("kind", "id", masking.apply_masks(F.col("message"), _CUSTOM_SAFE).alias("masked"))


@check("enr_11_mask_custom_full")
def _enr_11_full(spark, sf):
    return I.mask_input(spark, sf).select("kind", "id", masking.mask_custom(F.col("message")).alias("masked"))


@check("enr_12_mask_domain", f"with {I.MASK_CTE} select kind, id, {_nested(_DOMAIN_SAFE, f'concat({_ASCII}, {_LITERALS})')} as masked from mask_input")
def _enr_12(spark, sf):
    return _ascii(spark, sf).select("kind", "id", masking.apply_masks(F.col("message"), _DOMAIN_SAFE).alias("masked"))


@check("enr_12_mask_domain_full")
def _enr_12_full(spark, sf):
    return I.mask_input(spark, sf).select("kind", "id", masking.mask_domain(F.col("message"), include_timestamp=True).alias("masked"))


def _tokens_sql(delimiters: str) -> str:
    spaced = f"translate({_ASCII}, '{delimiters}', '{' ' * len(delimiters)}')"
    return f"list_filter(regexp_split_to_array({spaced}, '\\s+'), lambda t: t <> '')"


@check(
    "enr_13_tokenize",
    f"with {I.MASK_CTE} select kind, id, len({_tokens_sql('=:,()[]{}<>')}) as n, array_to_string({_tokens_sql('=:,()[]{}<>')}, '|') as tokens, "
    f"len({_tokens_sql(':|/=,[]()')}) as n_message from mask_input",
)
def _enr_13(spark, sf):
    plain = I.mask_input(spark, sf).withColumn("message", F.regexp_replace("message", r"[^ -~\s]", "e"))
    tokens = masking.tokenize(F.col("message"))
    return plain.select(
        "kind", "id", F.size(tokens).cast("bigint").alias("n"), F.array_join(tokens, "|").alias("tokens"),
        F.size(masking.tokenize_message(F.col("message"))).cast("bigint").alias("n_message"),
    )


@check(
    "enr_14_normalize_template",
    f"with {I.MASK_CTE} select kind, id, trim(regexp_replace(regexp_replace(concat({_nested(_CUSTOM_SAFE, _ASCII)}, '  <*> <NUM>'), '<[A-Z_*]+>', 'X', 'g'), '\\s+', ' ', 'g')) as template from mask_input",
)
def _enr_14(spark, sf):
    plain = I.mask_input(spark, sf).withColumn("message", F.regexp_replace("message", r"[^ -~\s]", "e"))
    masked = F.concat(masking.apply_masks(F.col("message"), _CUSTOM_SAFE), F.lit("  <*> <NUM>"))
    return plain.select("kind", "id", text.normalize_template(masked).alias("template"))


@check(
    "enr_15_iso_timestamp",
    f"select event_id, case when ({_EXPECTED}) is null then 'run' else regexp_replace(concat(strftime(ts, '%Y-%m-%dT%H:%M:%S.'), right({_EXPECTED}, 3), '000'), '\\.000000$', '') end as iso from events",
)
def _enr_15(spark, sf):
    normal = _stamps(spark, sf).withColumn("timestamp", normalize_timestamp(F.col("raw"), 2024))
    return normal.select("event_id", iso_timestamp(F.col("timestamp"), F.lit("run")).alias("iso"))


@check(
    "agg_2_pattern_match_counts",
    f"with {I.PARSED_CTE} select log_type, pattern, count(*) as hits from parsed where pattern is not null group by all",
)
def _agg_2(spark, sf):
    return metrics.pattern_match_counts(I.records(spark, sf))


@check(
    "agg_3_unmatched_rate",
    f"with {I.PARSED_CTE} select count(*) as lines, count(*) filter (where pattern is null) as unmatched, "
    "round(count(*) filter (where pattern is null) * 100.0 / count(*), 1) as unmatched_pct from parsed",
)
def _agg_3(spark, sf):
    lines = _prs_4(spark, sf)
    header = events.java_regex(f"^(?:{I.APP.headers[0][1]})")
    return metrics.unmatched_rate(lines, F.col("value").rlike(header))


_LEVELS = f"case when level is null then {_IMPLICIT} else {_MAP} end"


@check(
    "flagship_daily_levels",
    f"with {I.RECORDS_CTE} select strftime(event_date, '%Y-%m-%d') as event_date, {_LEVELS} as level, count(*) as records, "
    "count(distinct user_name) as users from records group by all",
)
def flagship(spark, sf):
    """Lines to enriched records to counts per day and level."""
    parsed = events.parse_lines(I.log_lines(spark, sf), I.APP, key="file").records
    enriched = enrich.enrich_records(parsed, I.APP, 2024)
    return enriched.groupBy(F.col("event_date").cast("string").alias("event_date"), "level").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("user").alias("users")
    )


assert set(BY_NAME)  # the rule tables load
