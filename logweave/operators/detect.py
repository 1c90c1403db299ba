"""Which log format a file has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logweave.functions.regex import any_of, java_regex
from logweave.rules.origins import ORIGINS, Origin

UNKNOWN = "unknown"


def type_by_name(file_name: Column, origins: Sequence[Origin] = ORIGINS) -> Column:
    """First origin with a file-name rule found in the name, else ``unknown``."""
    result = None
    for origin in origins:
        hit = file_name.rlike(any_of(origin.filenames, ignore_case=True))
        result = F.when(hit, origin.name) if result is None else result.when(hit, origin.name)
    return result.otherwise(UNKNOWN)


def content_order(origins: Sequence[Origin] = ORIGINS) -> list[Origin]:
    """Detection order for contents: a rule that accepts any line comes last."""
    return sorted(origins, key=lambda o: any(h in (r"^(?P<message>.+)$", ".*") for _, h in o.headers))


def detect_by_content(
    lines: DataFrame,
    origins: Sequence[Origin] = ORIGINS,
    key: str = "file_path",
    max_lines: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """``(key, log_type)``: the first format, in detection order, with a header anywhere in a file.

    All lines are tested unless the caller bounds how many of a file's first lines or bytes are looked at. Each task
    sends one row per file.
    """
    ordered = content_order(origins)
    head, text = lines, F.col("value")
    if max_lines is not None:
        head = head.filter(F.col("line_no") <= max_lines)
    if max_bytes is not None:
        running = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
        start = F.coalesce(F.sum(F.octet_length("value") + 1).over(running), F.lit(0))
        head = head.withColumn("__start", start).filter(F.col("__start") < max_bytes)
        room = (F.lit(max_bytes) - F.col("__start")).cast("int")
        cut = F.decode(F.substring(F.encode("value", "utf-8"), F.lit(1), room), "utf-8")
        text = F.when(F.octet_length("value") <= room, F.col("value")).otherwise(cut)
    rank = None
    for position, origin in enumerate(ordered):
        hit = text.rlike("|".join(f"(?:{java_regex(h)})" for _, h in origin.headers))
        rank = F.when(hit, position) if rank is None else rank.when(hit, position)
    names = F.array(*[F.lit(o.name) for o in ordered])
    best = head.groupBy(key).agg(F.min(rank).alias("__rank"))
    return best.select(key, F.coalesce(F.get(names, F.col("__rank")), F.lit(UNKNOWN)).alias("log_type"))


def fallback_name(file_name: Column) -> Column:
    """Name under which a file of unknown format is analysed."""
    return F.lower(F.replace(F.replace(file_name, F.lit(".log"), F.lit("")), F.lit(".txt"), F.lit("")))
