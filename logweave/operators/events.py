"""From lines to events: numbering, grouping and structured parsing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logweave.functions.regex import group_indexes, java_regex, strip
from logweave.functions.text import (
    condense_trace_json,
    filter_message_lines,
    keep_line,
    strip_leading_separators,
)
from logweave.rules.origins import Origin
from logweave.schema import CORE_GROUPS
from logweave.session import sized_broadcast

BLOCK_ROWS = 1 << 17
NEAR_START = 20
# Stands between the fields of a matched header.
_FIELD = "\x1e\x1f\x1e"


def number_events(
    lines: DataFrame,
    is_start: Column,
    opens: Column | None = None,
    key: str = "file_path",
    order: Sequence[str] = ("line_no",),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Running event number per file, plus ``in_event``: whether the latest start was one that ``opens`` an event.

    A file can hold a large share of all lines, so no window spans a whole file of lines. Lines are cut into blocks
    by line number; windows run inside a block, and what earlier blocks add is a window over one row per block.
    """
    order = list(order)
    opens = F.lit(True) if opens is None else opens
    marked = lines.withColumns(
        {
            "__block": F.floor(F.col(order[0]) / F.lit(block_rows)),
            "__start": F.coalesce(is_start, F.lit(False)).cast("long"),
            "__opens": F.coalesce(opens, F.lit(False)),
        }
    )
    last_start = F.when(F.col("__start") == 1, F.struct(*order, "__opens"))
    totals = marked.groupBy(key, "__block").agg(F.sum("__start").alias("__n"), F.max(last_start).alias("__last"))
    earlier = W.partitionBy(key).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        key,
        "__block",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
        F.max("__last").over(earlier).alias("__carry"),
    )
    inside = W.partitionBy(key, "__block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    state = F.coalesce(F.max(last_start).over(inside), F.col("__carry"))
    return (
        marked.join(carried, [key, "__block"])
        .withColumns(
            {
                "event_no": F.col("__before") + F.sum("__start").over(inside),
                "in_event": F.coalesce(state["__opens"], F.lit(False)),
                "is_start": F.col("__start") == 1,
            }
        )
        .drop("__block", "__start", "__opens", "__before", "__carry")
    )


def collect_events(
    numbered: DataFrame, key: str = "file_path", order: Sequence[str] = ("line_no",), text: str = "value"
) -> DataFrame:
    """One row per event: its first line number, number of lines and text."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, text)))
    return (
        numbered.groupBy(key, "event_no")
        .agg(F.min(order[0]).alias("line_no"), F.count(F.lit(1)).alias("n_lines"), ordered.alias("__parts"))
        .withColumn("text", F.array_join(F.transform("__parts", lambda p: p[text]), "\n"))
        .drop("__parts")
    )


def timestamp_start(line: Column, patterns: Sequence[str]) -> Column:
    """A line starts an event when a timestamp is found near its beginning; without rules, when it is not indented."""
    if not patterns:
        return ~line.rlike(r"^[ \t.|]")
    starts = [F.regexp_instr(line, F.lit(java_regex(p))).between(1, NEAR_START + 1) for p in patterns]
    result = starts[0]
    for start in starts[1:]:
        result = result | start
    return result


def split_events_by_timestamp(lines: DataFrame, patterns: Sequence[str], key: str = "file_path") -> DataFrame:
    """Group lines into events by timestamps alone."""
    return collect_events(number_events(lines, timestamp_start(F.col("value"), patterns), key=key), key=key)


def grouping_stats(events: DataFrame, key: str = "file_path") -> DataFrame:
    """Groups and continuation lines per file."""
    return events.groupBy(key).agg(
        F.count(F.lit(1)).alias("multiline_groups"), F.sum(F.col("n_lines") - 1).alias("continuation_lines")
    )


def message_ranges(lines: DataFrame, is_start: Column, key: str = "file_path", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Start lines with the start of the following one; null behind the last event of a file."""
    starts = lines.filter(is_start).select(
        key, "line_no", F.floor(F.col("line_no") / F.lit(block_rows)).alias("__block")
    )
    firsts = starts.groupBy(key, "__block").agg(F.min("line_no").alias("__first"))
    following = firsts.select(
        key, "__block", F.lead("__first").over(W.partitionBy(key).orderBy("__block")).alias("__next_first")
    )
    inside = W.partitionBy(key, "__block").orderBy("line_no")
    return starts.join(following, [key, "__block"]).select(
        key,
        "line_no",
        F.coalesce(F.lead("line_no").over(inside), F.col("__next_first")).alias("next_line_no"),
    )


def hold_last_event(events: DataFrame, key: str = "file_path") -> DataFrame:
    """Mark each file's last event, which may still grow."""
    last = sized_broadcast(events.groupBy(key).agg(F.max("event_no").alias("__last")), "last-events")
    return events.join(last, key).withColumn("held", F.col("event_no") == F.col("__last")).drop("__last")


@dataclass(frozen=True)
class Parsed:
    """Structured records, and the lines no record accounts for."""

    records: DataFrame
    unmatched: DataFrame


def _header_fields(df: DataFrame, origin: Origin, text: str) -> DataFrame:
    """Columns of the first header rule that matches at the start of ``text``; ``__rest`` is what follows the header.

    One replacement per rule writes all its groups next to each other, so a line is matched once, not once per group.
    """
    rules = [(name, java_regex(f"^(?:{pattern})"), group_indexes(pattern)) for name, pattern in origin.headers]
    extras = list(
        dict.fromkeys(
            group
            for name, _, at in rules
            for group in at
            if group not in CORE_GROUPS or (name, group) in origin.extra_only
        )
    )
    slots = [(group, False) for group in CORE_GROUPS] + [(group, True) for group in extras]

    def form(name: str, at: dict[str, int]) -> str:
        groups = [
            f"${at[group]}" if group in at and ((name, group) in origin.extra_only or group not in CORE_GROUPS) == extra else ""
            for group, extra in slots
        ]
        return _FIELD.join([name, *groups, ""])

    written = None
    for name, regex, at in rules:
        value = F.regexp_replace(text, regex, form(name, at))
        if len(rules) == 1:
            written = value
        else:
            hit = F.col(text).rlike(regex)
            written = F.when(hit, value) if written is None else written.when(hit, value)
    parts = df.withColumn("__parts", F.split(written, _FIELD))

    def part(i: int) -> Column:
        return F.nullif(F.get("__parts", F.lit(i)), F.lit(""))

    core = {group: part(i) for i, group in enumerate(CORE_GROUPS, start=1)}
    entries = [
        F.struct(F.lit(group).alias("key"), part(i).alias("value"))
        for i, group in enumerate(extras, start=1 + len(CORE_GROUPS))
    ]
    fields = (
        F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))
        if entries
        else F.create_map().cast("map<string,string>")
    )
    rest = F.get("__parts", F.lit(1 + len(slots)))
    return parts.withColumns({"pattern": part(0), **core, "fields": fields, "__rest": rest}).drop("__parts")


def _present(df: DataFrame, column: str, value: Column) -> DataFrame:
    """Set a column and keep the rows that have something in it.

    As a generator, not a filter: a filter would be moved below the column's expression and evaluate it twice.
    """
    return df.withColumn(column, F.explode(F.filter(F.array(value), lambda v: v != "")))


def _finish(df: DataFrame, origin: Origin, key: str) -> DataFrame:
    cleaned = strip(filter_message_lines(strip_leading_separators(F.col("message")), origin.ignore))
    records = _present(df, "message", cleaned) if origin.ignore else df.withColumn("message", cleaned)
    return records.select(
        key, "line_no", F.lit(origin.name).alias("log_type"), "pattern", *CORE_GROUPS, "fields"
    )


def _unmatched(df: DataFrame, origin: Origin, key: str, text: str) -> DataFrame:
    return df.filter(strip(F.col(text)) != "").select(
        key, "line_no", F.lit(origin.name).alias("log_type"), F.col(text).alias("raw_line")
    )


def _header_regex(origin: Origin, start: str = "") -> str:
    return java_regex("|".join(f"{start}(?:{pattern})" for _, pattern in origin.headers))


def _with_headers(lines: DataFrame, regex: str) -> DataFrame:
    """One row per header found in a line, none for a line without any."""
    found = F.regexp_extract_all("value", F.lit(regex), F.lit(0))
    return lines.select(*[c for c in lines.columns if c != "value"], F.explode(found).alias("__header"))


def parse_single_line(lines: DataFrame, origin: Origin, key: str = "file_path") -> Parsed:
    """One line, one record: ignored lines go first, then the first header rule that matches decides."""
    kept = lines.filter((strip(F.col("value")) != "") & keep_line(F.col("value"), origin.ignore))
    regex = _header_regex(origin, "^")
    records = _header_fields(_with_headers(kept, regex), origin, "__header").select(
        key, "line_no", F.lit(origin.name).alias("log_type"), "pattern", *CORE_GROUPS, "fields"
    )
    return Parsed(records, _unmatched(kept.filter(~F.col("value").rlike(regex)), origin, key, "value"))


def _parse_header_only(lines: DataFrame, origin: Origin, key: str) -> Parsed:
    """Messages end with their header line, so every line stands alone and nothing is shuffled."""
    regex = _header_regex(origin)
    parsed = _header_fields(_with_headers(lines, regex), origin, "__header")
    return Parsed(
        _finish(parsed, origin, key), _unmatched(lines.filter(~F.col("value").rlike(regex)), origin, key, "value")
    )


def segments_of(lines: DataFrame, origin: Origin) -> DataFrame:
    """Cut lines where a header starts inside them: ``(…, seg_no, segment, is_header)``."""
    pieces = F.split(F.regexp_replace("value", f"({_header_regex(origin)})", _FIELD + "$1"), _FIELD)
    cut = lines.select(*[c for c in lines.columns if c != "value"], F.posexplode(pieces).alias("seg_no", "segment"))
    # A header at the very beginning leaves an empty piece in front; a blank line is an empty piece of its own.
    leading = (F.col("seg_no") == 0) & (F.col("segment") == "")
    return cut.filter(~leading).withColumn("is_header", F.col("seg_no") > 0)


def parse_multi_line(lines: DataFrame, origin: Origin, key: str = "file_path", block_rows: int = BLOCK_ROWS) -> Parsed:
    """Events that may span lines; the message is what the header captured plus the body lines its rule allows."""
    if not origin.ignore:
        lines = lines.withColumn("value", condense_trace_json(F.col("value")))
    if origin.body == "none":
        return _parse_header_only(lines, origin, key)
    segments = segments_of(lines, origin)
    is_header = F.col("is_header")
    stops = F.lit(False) if origin.body == "all" else F.col("segment").rlike(java_regex(f"^(?:{origin.body})"))
    numbered = number_events(
        segments, is_header | stops, opens=is_header, key=key, order=("line_no", "seg_no"), block_rows=block_rows
    )
    events = (
        numbered.filter("in_event")
        .groupBy(key, "event_no")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "seg_no", "segment"))).alias("__parts"))
        .withColumns(
            {
                "line_no": F.col("__parts")[0]["line_no"],
                "__header": F.col("__parts")[0]["segment"],
                "__body": F.transform(
                    F.slice("__parts", 2, F.greatest(F.size("__parts") - 1, F.lit(0))), lambda p: p["segment"]
                ),
            }
        )
    )
    parsed = _header_fields(events, origin, "__header")
    captured = any("message" in group_indexes(pattern) for _, pattern in origin.headers)
    first = F.coalesce("message", F.lit("")) if captured else F.col("__rest")
    parsed = parsed.withColumn("message", F.array_join(F.concat(F.array(first), F.col("__body")), "\n"))
    return Parsed(
        _finish(parsed, origin, key), _unmatched(numbered.filter(~F.col("in_event")), origin, key, "segment")
    )


def parse_lines(lines: DataFrame, origin: Origin, key: str = "file_path") -> Parsed:
    """Parse lines of one origin with the engine its rules ask for."""
    return parse_multi_line(lines, origin, key) if origin.multiline else parse_single_line(lines, origin, key)
