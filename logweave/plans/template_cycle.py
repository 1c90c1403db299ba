"""The template cycle: messages to clusters, groups, rules and back to classified records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.dialects import best_match_dialect, first_match_dialect
from logweave.operators.grouping import embed_templates, group_members, group_templates, template_groups
from logweave.operators.metrics import level_word_coverage, timestamp_format_coverage
from logweave.operators.mining import mine_templates_best_match, mine_templates_first_match, number_arrivals
from logweave.operators.patterns import build_rules
from logweave.operators.serve import top_clusters
from logweave.rules.levels import LEVEL_WORDS
from logweave.rules.timestamps import TIMESTAMP_CATALOGUE
from logweave.functions.regex import java_regex, strip
from logweave.functions.text import condense_trace_json, filter_message_lines, strip_leading_separators
from logweave.session import materialize


@dataclass(frozen=True)
class Templates:
    clusters: DataFrame
    groups: DataFrame
    members: DataFrame
    rules: DataFrame


def group_clusters(clusters: DataFrame, distance_threshold: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Groups and members of ``(origin, cluster_id, template, size)``, origin by origin; few origins, many templates."""
    groups, members = None, None
    for row in clusters.select("origin").distinct().orderBy("origin").toLocalIterator():
        own = clusters.filter(F.col("origin") == row["origin"])
        vectors = embed_templates(own.select(F.col("cluster_id").alias("id"), "template"))
        vectors = materialize(vectors.withColumn("origin", F.lit(row["origin"])), "template-vectors")
        grouped = materialize(group_templates(vectors, distance_threshold), "template-labels")
        table, rows = template_groups(own, grouped, vectors), group_members(own, grouped)
        groups = table if groups is None else groups.unionByName(table)
        members = rows if members is None else members.unionByName(rows)
    return materialize(groups, "template-groups"), materialize(members, "template-members")


def generate_templates(messages: DataFrame, best: bool = True, distance_threshold: float = 0.6, **rules) -> Templates:
    """``(origin, seq, message)`` to clusters, groups and rules that wait for a review.

    ``seq`` is the order of arrival, unique per origin; without it messages are numbered by ``file_path`` and ``line_no``.
    ``rules`` are the miner's own settings. Every message that was mined matches the rule of its group; where settings
    cut lines out of messages first, it does after ``prepared_text``.
    """
    numbered = "seq" not in messages.columns
    if numbered:
        messages = materialize(number_arrivals(messages), "arrivals")
    mined = (mine_templates_best_match if best else mine_templates_first_match)(messages, numbered=numbered, **rules)
    groups, members = group_clusters(mined.clusters, distance_threshold)
    stamps = rules.get("timestamps", ())
    dialect = best_match_dialect(rules.get("raw", False), stamps) if best else first_match_dialect(stamps)
    return Templates(mined.clusters, groups, members, materialize(build_rules(groups, members, dialect), "template-rules"))


def prepared_text(message: Column, best: bool = True, ignore: Sequence[str] = ()) -> Column:
    """A message as the miner reads it before masks: traces condensed, ignored lines and ruled lines cut."""
    if best:
        return filter_message_lines(strip_leading_separators(strip(message)), ignore)
    return filter_message_lines(condense_trace_json(message), ignore)


@dataclass(frozen=True)
class OriginProfile:
    """What a sample says about an unknown format: one rule-table row and the largest clusters."""

    timestamp_pattern: str
    timestamp_coverage: float
    has_level: bool
    line_pattern: str
    clusters: DataFrame
    top: DataFrame


def line_pattern(timestamp: str, has_level: bool) -> str:
    """Header rule with a timestamp and, where lines have one, a level; the message is what follows."""
    level = r"\s*\[?(?P<level>" + "|".join(LEVEL_WORDS) + r")\]?" if has_level else ""
    return rf"(?P<timestamp>{timestamp}){level}\s*"


def profile_new_origin(sample: DataFrame, origin: str) -> OriginProfile:
    """Propose rules for a format from a small sample of its lines ``(seq, value)``."""
    best = timestamp_format_coverage(sample).filter("best").first()
    if best is None:
        raise ValueError("no known timestamp format covers enough of the sample")
    timestamp = TIMESTAMP_CATALOGUE[best["ord"]]
    counts = level_word_coverage(sample, timestamp).agg(F.sum("lines").alias("n")).first()["n"] or 0
    has_level = counts / sample.count() > 0.3
    pattern = line_pattern(timestamp, has_level)
    rest = F.regexp_replace("value", "^.*?(?:" + java_regex(pattern) + ")", "")
    messages = sample.select(F.lit(origin).alias("origin"), "seq", rest.alias("message"))
    mined = mine_templates_best_match(messages, params=(4, 0.5, 100))
    return OriginProfile(timestamp, best["coverage"], has_level, pattern, mined.clusters, top_clusters(mined.clusters))
