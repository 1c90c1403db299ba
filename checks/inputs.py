"""Log-shaped inputs derived from the driver's tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.timestamps import event_date, event_ts, normalize_timestamp
from logweave.operators.events import parse_lines
from logweave.rules.origins import AIS, Extractor, Origin
from logweave.session import spread

# Rows of a task that puts them through costly expressions.
SPREAD_ROWS = 250_000

_MESSAGE = """case event_type
  when 'error'  then concat('ORA-', lpad(cast(event_id % 100000 as {string}), 5, '0'), ' request failed for user ', cast(user_id as {string}))
  when 'click'  then concat('Parameter Not Found: p', cast(event_id % 7 as {string}))
  when 'view'   then concat('START block ', cast(user_id % 5 as {string}))
  when 'signup' then concat('User: U', cast(user_id as {string}), ' from 10.0.', cast(user_id % 256 as {string}), '.', cast(event_id % 256 as {string}))
  else concat('PROTOCOL=tcp)(HOST=10.1.2.', cast(user_id % 256 as {string}), ')(PORT=', cast(event_id % 70000 as {string}), ') value ', cast(cast(value as decimal(12,2)) as {string})) end"""

_LOG_LINES = """select concat('app_', cast(user_id % 4 as {string}), '.log') as file, event_id as line_no,
 case when event_id % 33 = 7 then concat('no header here ', cast(event_id as {string}))
      when event_id % 25 = 3 then concat({stamp}, ' [INFO] U0 - [AIS] AIS Version: 1.0')
      when event_id % 10 = 1 then concat({stamp}, ' [] U', cast(user_id as {string}), ' - [AIS] ', {message})
      else concat({stamp}, ' [', case event_type when 'error' then 'SEVERE' when 'click' then 'WARN' when 'view' then 'DEBUG' when 'signup' then 'APP' else 'INFO' end, '] U', cast(user_id as {string}), ' - [AIS] ', {message}) end as value
from {events}"""


def _spark_sql(template: str, **parts: str) -> str:
    return template.format(string="string", stamp="date_format(ts, 'dd MMM yyyy HH:mm:ss,SSS')", **parts)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table whose rows are about to go through costly expressions."""
    return spread(table(spark, sf, name), SPREAD_ROWS)


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``(file, line_no, value)``, one header line per event; some have no header, some an empty level."""
    query = _spark_sql(_LOG_LINES, message=_spark_sql(_MESSAGE), events="{events}")
    built = spark.sql(query, events=spread_table(spark, sf, "events"))
    # Through a generator the text is put together once, however many expressions look at it, as if it had been read.
    return built.select("file", "line_no", F.explode(F.array("value")).alias("value"))


def log_multiline(spark: SparkSession, sf: str) -> DataFrame:
    """``(file, line_no, value)``: a document is a file."""
    docs = spread_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    return docs.select("file", F.posexplode(F.split("text", "\n", -1)).alias("pos", "value")).select(
        "file", (F.col("pos") + 1).cast("bigint").alias("line_no"), "value"
    )


def timings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(
        "select l_returnflag as log_type, cast(l_orderkey as string) as rel_path, case l_linenumber % 4 when 0 then 'parse' "
        "when 1 then 'enrich' when 2 then 'group' else 'write' end as phase, cast(l_quantity / 1000 as decimal(12,4)) as seconds "
        "from {lineitem}",
        lineitem=table(spark, sf, "lineitem"),
    )


def registry(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(
        "select concat('f', cast(o_orderkey as string), '.log') as rel_path, cast(floor(o_totalprice) as bigint) as size_bytes, "
        "o_orderkey % 11 = 0 as needs_reprocessing from {orders} where o_orderkey % 3 <> 0",
        orders=table(spark, sf, "orders"),
    )


def files(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(
        "select concat('f', cast(o_orderkey as string), '.log') as rel_path, cast(floor(o_totalprice) as bigint) "
        "+ case when o_orderkey % 5 = 0 then 1 else 0 end as size_bytes, o_orderkey % 13 = 0 as incremental from {orders}",
        orders=table(spark, sf, "orders"),
    )


def mask_input(spark: SparkSession, sf: str) -> DataFrame:
    """``(kind, id, message)``: whole texts of documents, pages and conversations."""
    docs = spread_table(spark, sf, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("message"))
    pages = spread_table(spark, sf, "pages").select(F.lit("p"), "page_id", "html")
    talks = spread_table(spark, sf, "conversations").select(F.lit("c"), F.col("conv_id") * 1000 + F.col("turn"), "text")
    return docs.union(pages).union(talks)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """``(origin, id, embedding, label)``."""
    return table(spark, sf, "embeddings").select(
        F.lit("vectors").alias("origin"), F.col("vec_id").alias("id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), "label",
    )


# The single-line format of ``log_lines``, as a rule table row.
APP = Origin(
    name="app",
    filenames=(r"^app_\d+",),
    multiline=False,
    headers=(
        (
            "app_event",
            r"^(?P<timestamp>\d{1,2}\s+\w+\s+\d{4}\s+\d{2}:\d{2}:\d{2}[,.]\d{3})\s+\[(?P<level>\w*)\s*\]\s+"
            r"(?P<user>\S+)\s+-\s+\[(?P<component>\w+)\]\s+(?P<message>.*)$",
        ),
    ),
    body="none",
    ignore=AIS.ignore,
    extractors=(
        Extractor("ora_error_code", "ORA-", (r"(?P<ora_error_code>ORA-\d+)",)),
        Extractor("host_ip", "PROTOCOL=tcp", (r"PROTOCOL=tcp\)\(HOST=(?P<host_ip>[^\)]+)",)),
        Extractor("port", "PROTOCOL=tcp", (r"PROTOCOL=tcp\)\(HOST=[^\)]+\)\(PORT=(?P<port>\d+)",)),
        Extractor("username", "User", (r"User[:\s]+(?P<username>[A-Z0-9_-]+)", r"for user (?P<username>\d+)")),
    ),
    levels=AIS.levels,
)
# The same lines for the multi-line engine: lines without a header belong to the event before them.
APP_BLOCKS = replace(
    APP,
    multiline=True,
    body="all",
    headers=(("app_block", APP.headers[0][1].replace(r"(?P<message>.*)$", "").replace(r"\w*", r"\w+")),),
)


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed records of ``log_lines`` with normalised timestamps."""
    parsed = parse_lines(log_lines(spark, sf), APP, key="file").records
    stamped = parsed.withColumnRenamed("timestamp", "raw_timestamp").withColumn(
        "timestamp", normalize_timestamp(F.col("raw_timestamp"), 2024)
    )
    return stamped.withColumns(
        {
            "event_ts": event_ts(F.col("timestamp")),
            "event_date": event_date(F.col("timestamp")),
            "source_file": F.col("file"),
        }
    )


# --- the same in DuckDB --------------------------------------------------------------------------------------------


def _duck(template: str, **parts: str) -> str:
    return template.format(string="varchar", stamp="strftime(ts, '%d %b %Y %H:%M:%S,%g')", **parts)


IGNORE_SQL = "|".join(f"(?:{p})" for p in AIS.ignore)
HEADER_SQL = (
    r"^(\d{1,2}\s+\w+\s+\d{4}\s+\d{2}:\d{2}:\d{2}[,.]\d{3})\s+\[(\w*)\s*\]\s+(\S+)\s+-\s+\[(\w+)\]\s+(.*)$"
)
LINES_CTE = "log_lines as (" + _duck(_LOG_LINES, message=_duck(_MESSAGE), events="events") + ")"
KEPT_CTE = (
    LINES_CTE
    + f", kept as (select * from log_lines where trim(value) <> '' and not regexp_matches(value, '{IGNORE_SQL}'))"
)
PARSED_CTE = (
    KEPT_CTE
    + ", parsed as (select file, line_no, value, 'app' as log_type, "
    + f"case when regexp_matches(value, '{HEADER_SQL}') then 'app_event' end as pattern, "
    + ", ".join(
        f"nullif(regexp_extract(value, '{HEADER_SQL}', {i}), '') as {name}"
        for i, name in enumerate(["raw_timestamp", "level", "user_name", "component", "message"], start=1)
    )
    + " from kept)"
)
RECORDS_CTE = (
    PARSED_CTE
    + ", records as (select *, file as source_file, "
    + "strftime(strptime(raw_timestamp, '%d %b %Y %H:%M:%S,%g'), '%d/%m/%y %H:%M:%S.%g') as \"timestamp\", "
    + "cast(strptime(raw_timestamp, '%d %b %Y %H:%M:%S,%g') as date) as event_date from parsed where pattern is not null)"
)
MULTILINE_CTE = (
    "log_multiline as (select cast(doc_id as varchar) as file, i as line_no, parts[i] as value "
    "from (select doc_id, string_split(text, chr(10)) as parts from documents) d, "
    "lateral (select unnest(range(1, len(parts) + 1)) as i) u)"
)
TIMINGS_CTE = (
    "timings as (select l_returnflag as log_type, cast(l_orderkey as varchar) as rel_path, case l_linenumber % 4 when 0 then 'parse' "
    "when 1 then 'enrich' when 2 then 'group' else 'write' end as phase, cast(l_quantity / 1000 as decimal(12,4)) as seconds from lineitem)"
)
REGISTRY_CTE = (
    "registry as (select concat('f', cast(o_orderkey as varchar), '.log') as rel_path, cast(floor(o_totalprice) as bigint) as size_bytes, "
    "o_orderkey % 11 = 0 as needs_reprocessing from orders where o_orderkey % 3 <> 0)"
)
FILES_CTE = (
    "files as (select concat('f', cast(o_orderkey as varchar), '.log') as rel_path, cast(floor(o_totalprice) as bigint) "
    "+ case when o_orderkey % 5 = 0 then 1 else 0 end as size_bytes, o_orderkey % 13 = 0 as incremental from orders)"
)
MASK_CTE = (
    "mask_input as (select 'd' as kind, doc_id as id, text as message from documents union all select 'p', page_id, html from pages "
    "union all select 'c', conv_id * 1000 + turn, text from conversations)"
)
VECTORS_CTE = (
    "vectors as (select vec_id as id, list_transform(embedding, lambda x: cast(x as double)) as e, label from embeddings)"
)
