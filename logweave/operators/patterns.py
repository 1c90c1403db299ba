"""From templates to classification rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.dialects import Dialect
from logweave.rules.masks import PLACEHOLDER_PATTERNS
from logweave.session import materialize

# Share of a shape's places that must hold one token only, for its members to become one pattern.
MIN_CONSTANT = 0.5
_SPECIAL = r"([\\.^$|?*+()\[\]{}&~#\-])"
_BY_LENGTH = sorted(PLACEHOLDER_PATTERNS, key=len, reverse=True)


def escape_literal(text: Column) -> Column:
    """Escape what has a meaning in a regular expression, and white space."""
    return F.regexp_replace(F.regexp_replace(text, _SPECIAL, r"\\$1"), r"(\s)", r"\\$1")


def template_to_pattern(template: Column, anchor: bool = True) -> Column:
    """Literals escaped, placeholders replaced by what they stand for, longest name first; dot matches newlines.

    Each placeholder is wrapped, so one that holds an alternation does not split the whole pattern.
    """
    pattern = escape_literal(template)
    for name in _BY_LENGTH:
        # In escaped text a placeholder only differs by its star.
        wrapped = f"(?:{PLACEHOLDER_PATTERNS[name]})".replace(r"\Z", r"\z")
        pattern = F.replace(pattern, F.lit(name.replace("*", r"\*")), F.lit(wrapped))
    if anchor:
        pattern = F.concat(F.lit("^"), pattern, F.lit("$"))
    return F.concat(F.lit("(?s)"), pattern)


# --- member templates ----------------------------------------------------------------------------------------------


def attach_member_templates(groups: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(origin, group_id, ord, cluster_id, template)``: a member's own template, its cluster's, or the representative."""
    members = groups.select(
        "origin", "group_id", "representative_template", F.posexplode("member_cluster_ids").alias("ord", "m")
    ).select(
        "origin", "group_id", "representative_template", "ord",
        F.col("m.cluster_id").cast("string").alias("cluster_id"), F.nullif(F.col("m.template"), F.lit("")).alias("own"),
    )
    stored = clusters.select("origin", F.col("cluster_id").cast("string").alias("cluster_id"), F.col("template").alias("stored"))
    return members.join(stored, ["origin", "cluster_id"], "left").select(
        "origin", "group_id", "ord", "cluster_id", F.coalesce("own", "stored", "representative_template").alias("template")
    )


# --- group patterns ------------------------------------------------------------------------------------------------


def _fragment(token: Column) -> Column:
    """Pattern of one token."""
    return F.regexp_replace(template_to_pattern(token, anchor=False), r"^\(\?s\)", "")


def _tokens(template: str = "template") -> Column:
    return F.split(template, r"\s+", -1)


def _slots(members: DataFrame, max_alternatives: int | None, dialect: Dialect | None) -> DataFrame:
    """Per group, number of tokens and position: the pattern of all tokens that stand there."""
    shape = ["origin", "group_id", "n_tokens"]
    placed = members.select(*shape, F.posexplode(_tokens()).alias("pos", "token"))
    found = placed.groupBy(*shape, "pos").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    fragments = F.array_join(F.transform("tokens", dialect.fragment if dialect else _fragment), "|")
    masked = F.exists("tokens", dialect.masked) if dialect else F.lit(False)
    many = F.lit(False) if max_alternatives is None else F.size("tokens") > max_alternatives
    constant = F.size("tokens") == 1
    slot = F.when(constant, fragments).when(many, F.lit(r"\S*")).otherwise(F.concat(F.lit("(?:"), fragments, F.lit(")")))
    readable = F.when(constant, F.element_at("tokens", 1)).otherwise("<*>")
    return found.select(
        *shape, "pos", constant.alias("constant"), slot.alias("slot"), readable.alias("readable"), masked.alias("masked")
    )


def synthesize_group_patterns(
    members: DataFrame,
    max_alternatives: int | None = None,
    min_constant: float = MIN_CONSTANT,
    dialect: Dialect | None = None,
) -> DataFrame:
    """``(origin, group_id, pattern, merged_template)``: one rule per group, from ``attach_member_templates`` rows.

    Members with equally many tokens share a shape. Where enough places of a shape hold the same token in all of them,
    the shape is one pattern whose other places list the tokens found there; else it lists whole members. The shapes of a
    group are alternatives. Every member matches its group's pattern; sets per place are merged before they shuffle.
    ``max_alternatives`` lets a place with more tokens accept any token.

    Without a ``dialect`` patterns are for templates' own text, tokens joined by white space. With the dialect of the
    miner they are for messages as they came: tokens are parted by what it took for delimiters.
    """
    shape = ["origin", "group_id", "n_tokens"]
    distinct = members.select("origin", "group_id", "template", F.size(_tokens()).alias("n_tokens")).distinct()
    # Read three times below; what led to the members is not computed again.
    distinct = materialize(distinct, "pattern-members")
    parts = F.array_sort(F.collect_list(F.struct("pos", "slot", "readable", "masked")))
    if dialect:
        body, whole = dialect.joined(F.col("parts")), dialect.body(_tokens())
    else:
        body = F.array_join(F.transform("parts", lambda p: p["slot"]), r"\s+")
        whole = F.array_join(F.transform(_tokens(), _fragment), r"\s+")
    shapes = materialize(
        _slots(distinct, max_alternatives, dialect)
        .groupBy(*shape)
        .agg(parts.alias("parts"), F.count_if("constant").alias("n_constant"))
        .select(
            *shape,
            (F.col("n_constant") >= F.col("n_tokens") * min_constant).alias("mergeable"),
            body.alias("body"),
            F.array_join(F.transform("parts", lambda p: p["readable"]), " ").alias("readable"),
        ),
        "pattern-shapes",
    )
    apart = shapes.filter(~F.col("mergeable")).select(*shape)
    listed = (
        distinct.join(apart, shape, "left_semi")
        .groupBy(*shape)
        .agg(F.array_sort(F.collect_list(F.struct("template", whole.alias("body")))).alias("all"))
        .select(
            *shape,
            F.array_join(F.transform("all", lambda m: m["body"]), "|").alias("body"),
            F.array_join(F.transform("all", lambda m: m["template"]), " | ").alias("readable"),
        )
    )
    every = shapes.filter("mergeable").select(*shape, "body", "readable").unionByName(listed)
    ordered = F.array_sort(F.collect_list(F.struct("n_tokens", "body", "readable")))
    choices = F.array_join(F.transform("shapes", lambda x: x["body"]), "|")
    pattern = dialect.whole(choices) if dialect else F.concat(F.lit("(?s)^(?:"), choices, F.lit(")$"))
    return (
        every.groupBy("origin", "group_id")
        .agg(ordered.alias("shapes"))
        .select(
            "origin",
            "group_id",
            pattern.alias("pattern"),
            F.array_join(F.transform("shapes", lambda x: x["readable"]), " | ").alias("merged_template"),
        )
    )


def build_rules(groups: DataFrame, members: DataFrame, dialect: Dialect | None = None) -> DataFrame:
    """The rule table: groups with the patterns of their members ``(origin, group_id, ord, cluster_id, template)``.

    Rules for messages need the dialect of the miner that made the templates.
    """
    return groups.join(synthesize_group_patterns(members, dialect=dialect), ["origin", "group_id"]).select(
        "origin", "group_id", "representative_cluster_id", "representative_template", "merged_template", "pattern",
        "event_type", "severity",
    )


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        compiles, matches = [], []
        for pattern, template in zip(batch["pattern"], batch["representative_template"], strict=True):
            try:
                compiled = re.compile(pattern.replace(r"\z", r"\Z").replace("(?sU)", "(?s)", 1))
            except re.error:
                compiles.append(False)
                matches.append(False)
                continue
            compiles.append(True)
            matches.append(bool(compiled.match(template)))
        yield batch.assign(compiles=compiles, matches_representative=matches)


def validate_rules(rules: DataFrame) -> DataFrame:
    """Whether each pattern compiles and matches its own representative."""
    checked = rules.select("origin", "group_id", "pattern", "representative_template")
    schema = (
        "origin string, group_id bigint, pattern string, representative_template string, "
        "compiles boolean, matches_representative boolean"
    )
    return checked.mapInPandas(_check, schema)


def review_rules(rules: DataFrame, reviews: DataFrame) -> DataFrame:
    """Apply reviewed event types and severities by representative template; unreviewed rules keep what they had."""
    given = reviews.select(
        "representative_template", F.col("event_type").alias("__event"), F.col("severity").alias("__severity")
    )
    return (
        rules.join(given, "representative_template", "left")
        .withColumns(
            {
                "event_type": F.coalesce("__event", "event_type"),
                "severity": F.coalesce("__severity", "severity"),
            }
        )
        .drop("__event", "__severity")
    )


def reviewed(rules: DataFrame) -> DataFrame:
    """Rules that may classify: both fields are set."""
    return rules.filter(F.col("event_type").isNotNull() & F.col("severity").isNotNull())
