"""Rules meet texts by words they cannot match without.

A rule is a regular expression; each of its alternatives (those at the top, or of one group around all of it) has words
that every match contains whole. A rule is filed under the rarest of them, counted over the texts, so that a rule that
begins with a placeholder is found as well, and common words bring nobody together. An alternative with a word that no
text has is not tried at all. Alternatives without any such word are tried on every text, which is what they say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.session import materialize, sized_broadcast

# What stands in a simplified pattern for parts that may match anything.
_ANY = "\x01"
# Groups inside groups that are looked through, and groups around the whole pattern.
_DEPTH, _AROUND = 8, 3
_QUANTIFIER = r"(?:[*+?]|\{[^}]*\})[?+]?"


def _sub(text: Column, what: str, to: str) -> Column:
    return F.regexp_replace(text, what, to)


def _alternatives(pattern: Column) -> Column:
    """The pattern's alternatives, simplified: words, spaces where a word surely ends, and ANY."""
    # What rules for messages have around their alternatives: see dialects.Dialect.whole.
    text = _sub(
        pattern,
        r"(?s)\(\?sU\)\^\\s\*\(\?:\[\^\\S\\n\]\*\[\*=\\-\]\{5,\}\[\^\\S\\n\]\*\(\?:\\n\|\\z\)\)\*(\[(?:[^\]\\]|\\.)*\])\*\(\?:(.*)\)\1\*\$",
        r"^(?:$2)\$",
    )
    # Flags may change what words mean.
    text = F.when(text.rlike(r"\\Q|\(\?[a-zA-Z]*[ix]") | text.isNull(), F.lit(_ANY)).otherwise(text)
    text = _sub(text, r"\(\?[a-zA-Z-]+\)", "")
    text = _sub(_sub(text, r"^\\A", "^"), r"\\z$", r"\$")
    # Classes and escapes: white space and punctuation end a word, the rest may be part of one.
    text = _sub(text, r"\[(?!\^)(?:[^\]\w\\]|\\[^A-Za-rt-z0-9])+\](?:\+[?+]?|(?![*+?{]))", " ")
    text = _sub(text, rf"\[\^?\]?(?:[^\]\\]|\\.)*\](?:{_QUANTIFIER})?", _ANY)
    text = _sub(text, r"\\s(?:\+[?+]?|(?![*+?{]))|\\[^A-Za-z0-9](?![*+?{])", " ")
    text = _sub(text, rf"(?:\\.|\.)(?:{_QUANTIFIER})?", _ANY)
    text = _sub(text, rf"[^()|](?:{_QUANTIFIER})", _ANY)
    # Groups around everything are no part of it.
    levels = [text, *[None] * _AROUND]
    closed, begun = [F.lit(False)] * (_AROUND + 1), [F.lit(False)] * (_AROUND + 1)
    for k in range(_AROUND):
        around = r"(?s)^\^*\(\?:(.*)\)\$*$"
        levels[k + 1] = _sub(levels[k], around, "$1")
        some = levels[k].rlike(around)
        closed[k + 1] = closed[k] | (some & levels[k].endswith("$"))
        begun[k + 1] = begun[k] | (some & levels[k].startswith("^"))
    for _ in range(_DEPTH):
        levels = [_sub(t, rf"\((?:\?[:=!<>]+)?[^()]*\)(?:{_QUANTIFIER})?", _ANY) for t in levels]
    balanced = [~t.rlike("[()]") for t in levels]
    # The innermost level whose group, and those around it, did close at the end.
    chosen, ends, starts, fits = F.lit(_ANY), F.lit(False), F.lit(False), F.lit(True)
    for k, text in enumerate(levels):
        fits = fits & balanced[k]
        chosen = F.when(fits, text).otherwise(chosen)
        ends, starts = F.when(fits, closed[k]).otherwise(ends), F.when(fits, begun[k]).otherwise(starts)

    def marked(part: Column) -> Column:
        """A first or last word may go on in the text unless the pattern is held there."""
        before = F.when(starts | part.startswith("^"), "").otherwise(_ANY)
        behind = F.when(ends | part.endswith("$"), "").otherwise(_ANY)
        return F.concat(before, _sub(part, r"[\^$]", " "), behind)

    return F.transform(F.split(chosen, r"\|"), marked)


def required_words(pattern: Column) -> Column:
    """Per alternative of a pattern, the words (ASCII letters, digits, ``_``) that each of its matches contains whole."""
    return F.transform(
        _alternatives(pattern),
        lambda p: F.array_distinct(F.regexp_extract_all(p, F.lit(rf"(?<![A-Za-z0-9_{_ANY}])([A-Za-z0-9_]+)(?![A-Za-z0-9_{_ANY}])"), F.lit(1))),
    )


def words_of(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(text, "[^A-Za-z0-9_]+")), "")


def first_rules(texts: DataFrame, rules: DataFrame, scope: str = "scope", text: str = "text") -> DataFrame:
    """``scope, text, rule``: the least rule of its scope found in each of the texts, which are different ones.

    ``rules`` has ``scope``, ``rule`` (ordered values) and ``regex``; texts without a rule are left out.
    """
    alternatives = rules.select("scope", "rule", "regex", F.explode(required_words(F.col("regex"))).alias("words"))
    alternatives = materialize(alternatives.distinct(), "rule-alternatives")
    wanted = alternatives.select("scope", F.explode("words").alias("word")).distinct()
    wanted = sized_broadcast(wanted, "rule-words")
    scoped = texts.select(F.col(scope).alias("scope"), F.col(text).alias("text"))
    spoken = scoped.select("scope", "text", F.explode(words_of(F.col("text"))).alias("word"))
    counts = spoken.join(wanted, ["scope", "word"]).groupBy("scope", "word").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "rule-word-counts")
    # Words of an alternative with their counts; one that no text has takes the alternative out.
    worded = alternatives.withColumn("alternative", F.monotonically_increasing_id())
    worded = materialize(worded, "numbered-alternatives")
    each = worded.select("alternative", "scope", F.explode("words").alias("word"))
    rarest = each.join(counts.hint("merge"), ["scope", "word"], "left").groupBy("alternative").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("rarest")
    )
    filed = worded.join(rarest.hint("merge"), "alternative", "left").where("rarest is null or rarest.n > 0")
    filed = filed.select("scope", "rule", "regex", F.coalesce("rarest.word", F.lit("")).alias("word")).distinct()
    index = sized_broadcast(filed, "rule-index")
    # An empty word stands for all texts; only scopes that have such rules meet it.
    every = F.array_union(words_of(F.col("text")), F.array(F.lit("")))
    met = scoped.select("scope", "text", F.explode(every).alias("word")).join(index, ["scope", "word"])
    # In the order of their rules, so that an expression is compiled once for many texts.
    tried = met.sortWithinPartitions("rule").where(F.regexp_instr("text", F.col("regex"), 0) > 0)
    return tried.groupBy("scope", "text").agg(F.min("rule").alias("rule"))
