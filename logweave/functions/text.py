"""Message clean-up as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave.functions.regex import any_of, strip

TRACE_MARK = "ORCHESTRATION TRACING:"
_TRACE = r"ORCHESTRATION TRACING:\s*(\[.*\])\s*$"
_TRACE_EVENTS = "array<struct<type:string,name:string,output:string>>"


def strip_leading_separators(message: Column) -> Column:
    """Drop leading lines made only of five or more ``*``, ``=`` or ``-``, then trim."""
    # The possessive repeat keeps Java's matcher iterative however many such lines there are.
    return strip(F.regexp_replace(message, r"\A(?:[^\S\n]*[*=\-]{5,}[^\S\n]*(?:\n|\z))++", ""))


def keep_line(line: Column, ignore: Sequence[str]) -> Column:
    """True for a line no ignore rule is found in."""
    return ~line.rlike(any_of(ignore)) if ignore else F.lit(True)


def filter_message_lines(message: Column, ignore: Sequence[str]) -> Column:
    """Drop ignored and trace lines inside a message; null when nothing is left."""
    if not ignore:
        return message
    kept = F.filter(
        F.split(message, "\n"), lambda line: ~line.contains(TRACE_MARK) & keep_line(line, ignore)
    )
    return F.nullif(strip(F.array_join(kept, "\n")), F.lit(""))


def condense_trace_json(line: Column) -> Column:
    """Reduce the JSON array of a trace line to type, name and output; broken JSON is salvaged by pattern."""
    blob = F.regexp_extract(line, _TRACE, 1)
    events = F.filter(F.from_json(blob, _TRACE_EVENTS, {"mode": "PERMISSIVE"}), lambda e: e.isNotNull())
    whole = F.to_json(
        F.transform(
            events,
            lambda e: F.struct(
                F.coalesce(e["type"], F.lit("")).alias("type"),
                F.coalesce(e["name"], F.lit("")).alias("name"),
                F.coalesce(e["output"], F.lit("")).alias("output"),
            ),
        )
    )

    def found(pattern: str) -> Column:
        return F.regexp_extract_all(blob, F.lit(pattern), F.lit(1))

    zipped = F.arrays_zip(
        found(r'"type"\s*:\s*"([^"]*)"').alias("t"),
        found(r'"name"\s*:\s*"([^"]*)"').alias("n"),
        found(r'"output"\s*:\s*"((?:[^"\\]|\\.)*+)"').alias("o"),
    )
    complete = F.filter(zipped, lambda z: z["t"].isNotNull() & z["n"].isNotNull() & z["o"].isNotNull())
    salvaged = F.concat(
        F.lit("["),
        F.array_join(
            F.transform(
                complete,
                lambda z: F.concat(
                    F.lit('{"type":"'), z["t"], F.lit('","name":"'), z["n"], F.lit('","output":"'), z["o"], F.lit('"}')
                ),
            ),
            ",",
        ),
        F.lit("]"),
    )
    prefix = F.regexp_extract(line, r"^(.*?)ORCHESTRATION TRACING:", 1)
    suffix = F.regexp_extract(line, r"(\s*)$", 1)
    condensed = F.concat(prefix, F.lit(TRACE_MARK + " "), F.coalesce(whole, salvaged), suffix)
    return F.when(line.contains(TRACE_MARK) & line.rlike(_TRACE), condensed).otherwise(line)


def normalize_template(template: Column) -> Column:
    """Every placeholder becomes ``X`` and white space collapses."""
    return strip(F.regexp_replace(F.regexp_replace(template, r"<[A-Z_*]+>", "X"), r"\s+", " "))


def parse_result_name(path: Column) -> tuple[Column, Column]:
    """(date, log type) of a result file name; ``sin_fecha`` marks undated ones."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    pattern = r"^(\d+)_(\d+)_(\d+)_(.*)$"
    undated = stem.startswith("sin_fecha_")
    dated = stem.rlike(pattern)
    date = F.when(undated, "sin_fecha").when(
        dated, F.concat_ws("-", *[F.regexp_extract(stem, pattern, i) for i in (1, 2, 3)])
    )
    log_type = F.when(undated, F.substring(stem, len("sin_fecha_") + 1, 1 << 30)).when(
        dated, F.regexp_extract(stem, pattern, 4)
    )
    return date, log_type
