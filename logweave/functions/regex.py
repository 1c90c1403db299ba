"""Python-style rule text to the regular-expression dialect of Spark's JVM functions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAMED_GROUP = re.compile(r"\(\?P<\w+>")


def java_regex(pattern: str, *, ignore_case: bool = False, unicode: bool = True, multiline: bool = False) -> str:
    """Drop group names (they are addressed by index), use ``\\z`` and newline-only line ends."""
    flags = "d" + ("i" if ignore_case else "") + ("U" if unicode else "") + ("m" if multiline else "")
    body = _NAMED_GROUP.sub("(", pattern).replace(r"\Z", r"\z")
    return f"(?{flags}){body}"


def group_indexes(pattern: str) -> dict[str, int]:
    """Group name to position, in order of appearance."""
    return dict(re.compile(pattern).groupindex)


def _search_form(pattern: str) -> str:
    """The same rule without a leading or trailing ``.*``: when a rule is searched for in a line, they change nothing
    but cost a scan of the rest of the line at every position."""
    body = re.sub(r"^\^?\.\*(?![?+])", "", pattern)
    body = re.sub(r"(?<!\\)\.\*\$?$", "", body)
    return body or pattern


def any_of(patterns: Sequence[str], **flags: bool) -> str:
    """One expression that finds any of ``patterns`` in a line; each one keeps its own alternation scope."""
    return java_regex("|".join(f"(?:{_search_form(p)})" for p in patterns), **flags)


def strip(text: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"))
