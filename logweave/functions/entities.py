"""Entity extraction around anchors."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.regex import java_regex, strip
from logweave.rules.origins import Extractor

_WORD = r"A-Za-z0-9_\-/.@"


def _literal(text: str) -> str:
    return r"\Q" + text + r"\E"


def _windows(text: Column, anchor: str, pattern: str, window: int | None) -> Column:
    """Text behind every occurrence of the anchor, to its end or ``window`` characters; the look-ahead lets them overlap."""
    reach = "*" if window is None else f"{{0,{window}}}"
    if anchor.lower() in pattern.lower():
        return F.regexp_extract_all(text, F.lit(f"(?is)(?=({_literal(anchor)}.{reach}))"), F.lit(1))
    behind = F.regexp_extract_all(text, F.lit(f"(?is)(?={_literal(anchor)}(.{reach}))"), F.lit(1))
    return F.transform(behind, lambda w: F.regexp_replace(w, f"^[^{_WORD}]+(?=[{_WORD}])", ""))


def _groups(pattern: str) -> list[int]:
    """Named groups are the values; without any, the whole match is."""
    return list(re.compile(pattern).groupindex.values()) or [0]


def _clean(values: Column) -> Column:
    return F.filter(F.transform(values, strip), lambda v: v != "")


def _first_in_windows(windows: Column, pattern: str) -> Column:
    regex = java_regex(pattern, ignore_case=True)
    per_window = F.transform(windows, lambda w: F.array(*[F.regexp_extract(w, regex, g) for g in _groups(pattern)]))
    return _clean(F.flatten(per_window))


def _all_in_text(text: Column, pattern: str) -> Column:
    regex = F.lit(java_regex(pattern, ignore_case=True))
    columns = [F.regexp_extract_all(text, regex, F.lit(g)).alias(f"g{i}") for i, g in enumerate(_groups(pattern))]
    if len(columns) == 1:
        return _clean(columns[0])
    names = [f"g{i}" for i in range(len(columns))]
    return _clean(F.flatten(F.transform(F.arrays_zip(*columns), lambda z: F.array(*[z[n] for n in names]))))


def _valid_ports(values: Column) -> Column:
    digits = F.transform(values, lambda v: F.regexp_replace(v, r"\D", "").try_cast("bigint"))
    return F.transform(F.filter(digits, lambda d: d.between(0, 65535)), lambda d: d.cast("string"))


def extract_entities(
    df: DataFrame,
    extractors: Sequence[Extractor],
    text: str = "message",
    output: str = "extracted",
    window: int | None = None,
) -> DataFrame:
    """Add ``output``, a map from extractor name to its distinct values in order of appearance.

    ``window`` bounds how far behind an anchor a value may stand; by default anywhere behind it.

    Expressions are tried one level per select, so that what earlier ones found is computed once and only referred to.
    """
    if not extractors:
        return df.withColumn(output, F.create_map().cast("map<string,array<string>>"))
    source = F.coalesce(F.col(text), F.lit(""))
    found = {e.name: f"__found_{i}" for i, e in enumerate(extractors)}
    levels = max(len(e.patterns) for e in extractors)
    empty = F.array().cast("array<string>")
    for level in range(levels):
        near: dict[str, Column] = {}
        whole: dict[str, Column] = {}
        for e in extractors:
            if level >= len(e.patterns):
                continue
            pattern, column = e.patterns[level], found[e.name]
            before = F.col(column) if level else empty
            if e.anchor:
                guard = F.lower(source).contains(e.anchor.lower())
                windows = F.when(guard, _first_in_windows(_windows(source, e.anchor, pattern, window), pattern)).otherwise(empty)
                near[column] = F.concat(before, windows) if level else windows
            else:
                near[column] = before
            whole[column] = F.when(F.size(F.col(column)) > 0, F.col(column)).otherwise(_all_in_text(source, pattern))
        df = df.withColumns(near).withColumns(whole)
    arrays = []
    for e in extractors:
        values = F.array_distinct(F.col(found[e.name]))
        arrays.append(_valid_ports(values) if e.name == "port" else values)
    pairs = [item for e, values in zip(extractors, arrays, strict=True) for item in (F.lit(e.name), values)]
    result = F.map_filter(F.create_map(*pairs), lambda _, values: F.size(values) > 0)
    return df.withColumn(output, result).drop(*found.values())


def extracted_to_json(extracted: Column) -> Column:
    return F.to_json(extracted)


def json_to_extracted(text: Column) -> Column:
    return F.from_json(text, "map<string,array<string>>")
