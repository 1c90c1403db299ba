"""Search documents: preparation, upsert and deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.timestamps import iso_timestamp

# The fields of a search document.
DOCUMENT_FIELDS = [
    "timestamp", "log_type", "file", "source_file", "pattern", "level", "user", "component", "message", "pid",
    "event_type", "severity", "extracted", "raw_line",
]
_ID_FIELDS = ["source_file", "timestamp", "raw_line", "message"]


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string").alias(name)


def document_id(df: DataFrame) -> Column:
    """Stable id, so that indexing the same record again replaces it; absent and null fields count alike."""
    parts = [F.coalesce(_column(df, f).cast("string"), F.lit("")) for f in _ID_FIELDS]
    return F.sha2(F.concat_ws("|", *parts), 256)


def prepare_documents(records: DataFrame, run_ts: Column) -> DataFrame:
    """``_id``, ``@timestamp`` and the fixed fields."""
    return records.select(
        document_id(records).alias("_id"),
        iso_timestamp(F.col("timestamp"), run_ts).alias("@timestamp"),
        *[_column(records, f).alias(f) for f in DOCUMENT_FIELDS],
    )


def document_json(documents: DataFrame) -> DataFrame:
    """``(_id, body)``: null fields are left out of the body."""
    return documents.select("_id", F.to_json(F.struct(*[c for c in documents.columns if c != "_id"])).alias("body"))


def upsert_documents(new: DataFrame, stored: DataFrame | None = None, order: str = "seq", mode: str = "append") -> DataFrame:
    """The index after a load: of equal ids the last one counts. ``rebuild`` forgets what was stored."""
    marked = new.withColumn("__new", F.lit(1))
    if stored is not None and mode == "append":
        marked = stored.withColumn("__new", F.lit(0)).unionByName(marked, allowMissingColumns=True)
    kept = [c for c in marked.columns if c not in ("_id", "__new", order)]
    row = F.max_by(F.struct(*kept), F.struct("__new", order)).alias("__doc")
    return marked.groupBy("_id").agg(row).select("_id", "__doc.*")


def where_log_type(log_type: str) -> Column:
    return F.col("log_type") == log_type


def where_source_file(source_file: str) -> Column:
    return F.col("source_file") == source_file


def where_date_range(start: str, end: str) -> Column:
    """Both ends belong to the range; a bare date as an end means all of that day."""
    stamp = F.col("`@timestamp`")
    last = end if "T" in end else f"{end}T23:59:59.999999"
    return (stamp >= start) & (stamp <= last)


def delete_documents(documents: DataFrame, condition: Column | None = None) -> DataFrame:
    """Documents that stay; without a condition none do."""
    if condition is None:
        return documents.limit(0)
    return documents.filter(~F.coalesce(condition, F.lit(False)))


def deletion_counts(documents: DataFrame, condition: Column | None = None) -> DataFrame:
    """How many documents a deletion removes and leaves."""
    hit = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    return documents.agg(F.count_if(hit).alias("deleted"), F.count_if(~hit).alias("remaining"))
