"""Masking of variable parts and tokenising, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave.functions.regex import java_regex
from logweave.rules.masks import CUSTOM_DELIMITERS, CUSTOM_MASKS, DOMAIN_MASKS, MASK_NEEDS, MESSAGE_DELIMITERS
from logweave.rules.timestamps import TIMESTAMP_CATALOGUE


def apply_masks(text: Column, masks: Iterable[tuple[str, str]], *, unicode: bool = True) -> Column:
    """Ordered replacements, one after the other; a mask is only tried on texts that hold what its matches need.

    The lambda names what the masks before have made, which a condition would evaluate twice.
    """
    for pattern, replacement in masks:
        found = java_regex(pattern, unicode=unicode)
        needs = MASK_NEEDS.get(pattern)
        if needs is None:
            text = F.regexp_replace(text, found, replacement)
        else:
            text = F.element_at(F.transform(F.array(text), _guarded(needs, found, replacement)), 1)
    return text


def _guarded(needs: Sequence[str], found: str, replacement: str) -> Callable[[Column], Column]:
    def replaced(text: Column) -> Column:
        held = reduce(Column.__or__, [F.contains(text, F.lit(need)) for need in needs])
        return F.when(held, F.regexp_replace(text, found, replacement)).otherwise(text)

    return replaced


def custom_masks(timestamps: Sequence[str] = TIMESTAMP_CATALOGUE) -> list[tuple[str, str]]:
    """Timestamps first, then the first-match miner's list."""
    return [(p, "<TIMESTAMP>") for p in (timestamps or TIMESTAMP_CATALOGUE)] + CUSTOM_MASKS


def domain_masks(include_timestamp: bool, timestamps: Sequence[str] = ()) -> list[tuple[str, str]]:
    """The best-match miner's list, with the origin's timestamps in front for raw lines."""
    first = [(p, "<TIMESTAMP>") for p in (timestamps or TIMESTAMP_CATALOGUE)] if include_timestamp else []
    return first + [(p, f"<{name}>") for p, name in DOMAIN_MASKS]


def mask_custom(text: Column, timestamps: Sequence[str] = TIMESTAMP_CATALOGUE) -> Column:
    return apply_masks(text, custom_masks(timestamps))


def mask_domain(text: Column, include_timestamp: bool = False, timestamps: Sequence[str] = ()) -> Column:
    return apply_masks(text, domain_masks(include_timestamp, timestamps))


def tokenize(text: Column, delimiters: str = CUSTOM_DELIMITERS) -> Column:
    """Delimiters count as spaces; tokens are what stands between white space."""
    return F.array_remove(F.split(F.translate(text, delimiters, " " * len(delimiters)), r"(?U)\s+"), "")


def tokenize_message(text: Column) -> Column:
    return tokenize(text, MESSAGE_DELIMITERS)
