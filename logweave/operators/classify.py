"""Rules applied to records, and rule tables compared with each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.dialects import Dialect
from logweave.operators.patterns import reviewed, template_to_pattern
from logweave.operators.rule_index import first_rules
from logweave.session import materialize

# Rules per CASE expression; longer tables become several expressions, each one only for rows still without a match.
RULES_PER_STEP = 200
# More reviewed rules than this are joined instead of becoming literals.
LITERAL_RULES = 2_000


def first_match(df: DataFrame, text: str, rules: list[tuple[object, str]], output: str, output_type: str) -> DataFrame:
    """Add ``output``: the key of the first ``(key, regex)`` found in ``text``, null without any.

    Literal expressions let Spark compile each regex once and stop at the first match.
    """
    df = df.withColumn(output, F.lit(None).cast(output_type))
    for start in range(0, len(rules), RULES_PER_STEP):
        hit = F.when(F.col(output).isNotNull(), F.col(output))
        for key, regex in rules[start : start + RULES_PER_STEP]:
            hit = hit.when(F.col(text).rlike(regex), F.lit(key).cast(output_type))
        df = df.withColumn(output, hit)
    return df


def _at_start(pattern: Column) -> Column:
    return F.concat(F.lit(r"\A(?:"), pattern, F.lit(")"))


def classify_by_template(records: DataFrame, rules: DataFrame, order: str = "group_id", text: Column | None = None) -> DataFrame:
    """Event type and severity of the first reviewed rule of the record's origin that matches at the message start.

    ``text`` is what the rules are tried on, the message by default. Reviewed rules were edited by hand one by one, so
    they are usually few and become literals. A table of more than LITERAL_RULES stays distributed and meets the different
    messages by their rarest words.
    """
    text = F.coalesce(F.col("message") if text is None else text, F.lit(""))
    usable = materialize(reviewed(rules).filter("pattern is not null"), "reviewed-rules")
    if usable.count() > LITERAL_RULES:
        return _classify_by_many(records, usable, order, text)
    table = (
        usable.select("origin", order, "group_id", "event_type", "severity", _at_start(F.col("pattern")).alias("regex"))
        .orderBy("origin", order)
        .collect()
    )
    df = records.withColumn("__text", text)
    for column in ("event_type", "severity"):
        if column in df.columns:
            df = df.drop(column)
    for start in range(0, max(len(table), 1), RULES_PER_STEP):
        step = table[start : start + RULES_PER_STEP]
        previous = F.col("__rule") if start else F.lit(None).cast("int")
        hit = F.when(previous.isNotNull(), previous)
        for offset, rule in enumerate(step):
            hit = hit.when((F.col("log_type") == rule["origin"]) & F.col("__text").rlike(rule["regex"]), start + offset)
        df = df.withColumn("__rule", hit)

    def attribute(name: str, kind: str) -> Column:
        values = F.array(*[F.lit(r[name]).cast(kind) for r in table]) if table else F.array().cast(f"array<{kind}>")
        return F.get(values, F.col("__rule"))

    return df.withColumns(
        {
            "event_type": attribute("event_type", "string"),
            "severity": attribute("severity", "string"),
            "template_group_id": attribute("group_id", "bigint"),
        }
    ).drop("__text", "__rule")


def _classify_by_many(records: DataFrame, usable: DataFrame, order: str, text: Column) -> DataFrame:
    """The same for a large rule table, by ``rule_index``; the lowest ``order`` wins."""
    fields = F.struct(F.col(order).alias("o"), "group_id", "event_type", "severity")
    rules = usable.select(F.col("origin").alias("scope"), fields.alias("rule"), _at_start(F.col("pattern")).alias("regex"))
    kept = records.drop("event_type", "severity").withColumn("__text", text)
    messages = kept.where("log_type is not null").select("log_type", "__text").distinct()
    best = first_rules(materialize(messages, "messages"), rules, "log_type", "__text").select(
        F.col("scope").alias("log_type"), F.col("text").alias("__text"), F.col("rule").alias("__rule")
    )
    joined = kept.join(materialize(best, "message-rules").hint("merge"), ["log_type", "__text"], "left")
    return joined.select(
        *[c for c in kept.columns if c != "__text"],
        F.col("__rule.event_type").alias("event_type"),
        F.col("__rule.severity").alias("severity"),
        F.col("__rule.group_id").cast("bigint").alias("template_group_id"),
    )


def unclassified(records: DataFrame) -> DataFrame:
    """Records no rule accounts for, for the learning queue."""
    return records.filter(F.col("template_group_id").isNull())


def first_rule(df: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """``(key, rule_id)``: the lowest ``rule_id`` whose ``regex`` is found in the text, null without any.

    For tables of many rules, whatever they begin with; see ``rule_index``. Each different text is tried once.
    """
    texts = materialize(df.where(F.col(text).isNotNull()).select(F.lit(0).alias("scope"), F.col(text).alias("text")).distinct(), "texts")
    best = first_rules(texts, rules.select(F.lit(0).alias("scope"), F.col("rule_id").alias("rule"), "regex"))
    best = best.select(F.col("text").alias(text), F.col("rule").alias("rule_id"))
    if key == text:
        return df.select(text).distinct().join(best, text, "left")
    # A hot text is one row on the right and many on the left, which the join splits at run time.
    return df.select(key, text).join(materialize(best, "text-rules").hint("merge"), text, "left").select(key, "rule_id")


def classify_by_cluster(
    messages: DataFrame, clusters: DataFrame, key: str = "id", text: str = "message", dialect: Dialect | None = None
) -> DataFrame:
    """``(key, cluster_id)``: first cluster whose template accounts for the whole message, null without any.

    Templates are taken as texts with placeholders; with the dialect of their miner, as what messages were made into.
    """
    template = F.col("template")
    if dialect:
        regex = dialect.whole(dialect.body(F.split(template, r"\s+", -1)))
    else:
        regex = F.concat(F.lit(r"\A"), template_to_pattern(template, anchor=False), F.lit(r"\z"))
    rules = clusters.select(F.col("cluster_id").alias("rule_id"), regex.alias("regex"))
    return first_rule(messages, key, text, rules).withColumnRenamed("rule_id", "cluster_id")


def new_groups_by_key(groups: DataFrame, stored: DataFrame) -> DataFrame:
    """Groups whose representative template has no stored rule yet."""
    return groups.join(stored.select("representative_template"), "representative_template", "left_anti")


def covering_rule(groups: DataFrame, stored: DataFrame, text: str = "representative_template") -> DataFrame:
    """Add ``covered_by``: the first stored group whose pattern accounts for the whole representative template."""
    rules = stored.filter("pattern is not null").select(
        F.col("group_id").alias("rule_id"),
        F.concat(F.lit(r"\A(?:"), F.col("pattern"), F.lit(r")\z")).alias("regex"),
    )
    found = first_rule(groups.select(text).distinct(), text, text, rules)
    return groups.join(found.withColumnRenamed("rule_id", "covered_by"), text, "left")


def uncovered_groups(groups: DataFrame, stored: DataFrame) -> DataFrame:
    """Groups no stored pattern covers."""
    return covering_rule(groups, stored).filter(F.col("covered_by").isNull()).drop("covered_by")


def new_clusters_only(clusters: DataFrame, stored: DataFrame) -> DataFrame:
    """Clusters without a stored pattern."""
    return clusters.join(stored.select("cluster_id"), "cluster_id", "left_anti")


def merge_rules(new: DataFrame, stored: DataFrame, key: str = "representative_template") -> DataFrame:
    """Stored rules stay as they are, new keys are added."""
    added = new.join(stored.select(key), key, "left_anti")
    return stored.unionByName(added, allowMissingColumns=True)


def records_of_run(records: DataFrame, results: DataFrame, key: str = "path") -> DataFrame:
    """Records from result files produced in this run."""
    return records.join(results.select(key), key, "left_semi")
