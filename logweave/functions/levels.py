"""Level and component defaults as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave.functions.regex import any_of, strip
from logweave.rules.levels import IMPLICIT_ERROR, IMPLICIT_WARN, LEVEL_MAPPING


def default_component(component: Column, value: str | None) -> Column:
    """Fill a missing or empty component."""
    if value is None:
        return component
    return F.coalesce(F.nullif(component, F.lit("")), F.lit(value))


def map_level(level: Column, mapping: Mapping[str, str] = LEVEL_MAPPING) -> Column:
    """Standard name of a native level; unknown names stay as they are."""
    if not mapping:
        return level
    pairs = [F.lit(item) for key, value in mapping.items() for item in (key.upper(), value)]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.upper(strip(level))), level)


def implicit_level(
    level: Column,
    message: Column,
    errors: Sequence[str] = IMPLICIT_ERROR,
    warnings: Sequence[str] = IMPLICIT_WARN,
) -> Column:
    """Keep a given level, else infer it from words in the message."""
    text = F.coalesce(message, F.lit(""))
    return (
        F.when(F.coalesce(level, F.lit("")) != "", level)
        .when(text.rlike(any_of(errors, ignore_case=True)), "ERROR")
        .when(text.rlike(any_of(warnings, ignore_case=True)), "WARN")
        .otherwise("INFO")
    )
