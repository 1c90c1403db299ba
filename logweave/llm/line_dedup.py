"""Repeated runs of lines removed, with a suffix array over sequences of line ids; DataFrame functions only.

Each line is the digest of its text, and a place is a line of a document, numbered in the order in which copies count. The
array orders places by the lines that follow. It is made by prefix doubling: a rank orders places by their next ``h``
lines, and the pair of the ranks here and ``h`` lines on orders them by ``2 h``. Per round, equal pairs are counted (one
row per pair and task), pairs that stand once drop out, since no repeated run goes on there, and the rest are sorted by
range; their number in that order is the new rank. Rounds go on until no pair stands twice.

Places of one rank after ``k`` rounds are an interval of common prefix ``2 ** k`` or more. Of each place the deepest
interval with an earlier place names its source, the first place in it. Places that follow each other and whose sources
do form one copied run, which ends where the next line is no copy or has an earlier source (``copied_runs``).

Later copies of runs of ``min_lines`` lines or more are removed, and those of single lines of ``min_words`` words or more:
a longer run is covered by later copies of its parts of ``min_lines`` lines. No step holds a group: pairs are
aggregated, joins split hot pairs at run time, and windows go over one text's lines only.

Defined cases: null and empty texts have no lines; an empty line is a line; lines end at ``\\n``; the first copy is that of
the smallest doc_id (null last), then of the row read first, then of the smaller line number; a line in several runs goes
if any is a later copy; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.llm.ordering import number_rows
from logweave.session import materialize, sized_broadcast

MIN_LINES, MIN_WORDS = 2, 10
# A place is the document's number above this many bits and the line's below.
_LINE_BITS = 24


def _lines(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "\n", -1)).otherwise(F.array().cast("array<string>"))


def _ranked(counted: DataFrame, keys: list[str]) -> DataFrame:
    """``counted`` with ``number``: a number in the order of the keys. Ranges of keys are sorted apart; the numbers of a later range are
    greater, and writing them fixes them."""
    partitions = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = counted.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)
    return materialize(ordered.withColumn("number", F.monotonically_increasing_id()), "ranks")


def repeated_prefixes(lines: DataFrame) -> list[DataFrame]:
    """Per round ``k`` the places ``place, rank, first`` whose next ``2 ** k`` lines stand at least twice, ranked by these
    lines; ``first`` is the least place of equal rank. ``lines`` has ``place, id``."""
    first, times = F.min("place").alias("first"), F.count(F.lit(1)).alias("times")
    counted = lines.groupBy("id").agg(times, first).where("times > 1")
    ranks = _ranked(counted.select("id", "first"), ["id"])
    joined = lines.join(ranks.hint("merge"), "id")
    levels = [materialize(joined.select("place", F.col("number").alias("rank"), "first"), "places")]
    h = 1
    while True:
        document = W.partitionBy(F.shiftright("place", _LINE_BITS)).orderBy("place")
        ahead = F.lead(F.struct("place", "rank"), h).over(document)
        pairs = levels[-1].withColumn("ahead", ahead).where(F.col("ahead.place") == F.col("place") + h)
        pairs = materialize(pairs.select("place", "rank", F.col("ahead.rank").alias("next")), "pairs")
        counted = pairs.groupBy("rank", "next").agg(times, first).where("times > 1")
        ranks = _ranked(counted.select("rank", "next", "first"), ["rank", "next"])
        if ranks.isEmpty():
            return levels
        joined = pairs.join(ranks.hint("merge"), ["rank", "next"])
        levels.append(materialize(joined.select("place", F.col("number").alias("rank"), "first"), "places"))
        h *= 2


def later_copies(levels: list[DataFrame], length: int) -> DataFrame:
    """``place`` of every later copy of a run of exactly ``length`` lines: of ``2 ** k`` a round's own, else two of its
    prefixes that overlap."""
    k = min(length.bit_length() - 1, len(levels) - 1)
    if length == 1 << k:
        return levels[k].where("place <> first").select("place")
    if length > 2 << k:
        return levels[k].select("place").limit(0)
    document = W.partitionBy(F.shiftright("place", _LINE_BITS)).orderBy("place").rangeBetween(0, length - (1 << k))
    last = F.last(F.struct("place", "rank")).over(document)
    pairs = levels[k].withColumn("ahead", last).where(F.col("ahead.place") == F.col("place") + length - (1 << k))
    pairs = materialize(pairs.select("place", "rank", F.col("ahead.rank").alias("next")), "pairs")
    counted = pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("times"), F.min("place").alias("first")).where("times > 1")
    return pairs.join(counted.hint("merge"), ["rank", "next"]).where("place <> first").select("place")


def deepest_sources(levels: list[DataFrame]) -> DataFrame:
    """``place, lines, source``: places whose next ``lines`` lines (a power of two, the greatest) stand earlier as well."""
    later = [
        level.where("place <> first").select("place", F.struct(F.lit(1 << k).alias("lines"), F.col("first").alias("source")).alias("copy"))
        for k, level in enumerate(levels)
    ]
    # Deeper levels are few rows; the greatest number of lines wins.
    best = reduce(DataFrame.unionByName, later).groupBy("place").agg(F.max("copy").alias("copy"))
    return best.select("place", F.col("copy.lines").cast("bigint").alias("lines"), "copy.source")


def copied_runs(sources: DataFrame) -> DataFrame:
    """``place, source, lines``: copied runs that cannot go on with the same source, from ``deepest_sources``."""
    ordered = W.partitionBy(F.shiftright("place", _LINE_BITS)).orderBy("place")
    goes_on = (F.lag("place").over(ordered) + 1 == F.col("place")) & (F.lag("source").over(ordered) + 1 == F.col("source"))
    marked = sources.withColumn("starts", F.when(goes_on, 0).otherwise(1))
    numbered = marked.withColumn("run", F.sum("starts").over(ordered))
    return numbered.groupBy(F.shiftright("place", _LINE_BITS).alias("document"), "run").agg(
        F.min("place").alias("place"),
        F.min("source").alias("source"),
        (F.max(F.col("place") + F.col("lines")) - F.min("place")).alias("lines"),
    ).select("place", "source", "lines")


def _places(numbered: DataFrame) -> DataFrame:
    """``place, id, words`` of all lines; ``numbered`` has ``row, d, text``."""
    exploded = numbered.select("d", F.posexplode(_lines(F.col("text"))).alias("n", "line"))
    words = F.size(F.array_remove(F.split("line", r"[\x20\x09-\x0D]+"), ""))
    place = F.shiftleft(F.col("d"), _LINE_BITS) + F.col("n")
    return exploded.select(place.alias("place"), F.unhex(F.md5("line")).alias("id"), words.alias("words"))


def numbered_documents(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``row, key, text`` and ``d``, the number of the document in the order of copies."""
    rows = materialize(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text")), "numbered"
    )
    keys = rows.select("row", F.col("key").isNull().alias("none"), "key")
    order = number_rows(keys, ["none", "key", "row"], "d", "document-order").select("row", "d")
    return rows.join(sized_broadcast(order, "document-numbers"), "row")


def remove_repeated_lines(
    docs: DataFrame, text: str = "text", key: str = "doc_id", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS
) -> DataFrame:
    """One row per document: ``key, kept`` (text of the other lines), ``n_lines, n_removed, n_runs``.

    ``n_runs`` counts stretches of adjoining removed lines.
    """
    numbered = numbered_documents(docs, text, key)
    lines = materialize(_places(numbered), "lines")
    levels = repeated_prefixes(lines.select("place", "id"))
    long_lines = lines.where(F.col("words") >= min_words).select("place")
    single = later_copies(levels, 1).join(long_lines, "place", "left_semi").withColumn("lines", F.lit(1))
    removed = later_copies(levels, min_lines).withColumn("lines", F.lit(min_lines)).unionByName(single)
    covered = removed.select(F.explode(F.sequence("place", F.col("place") + F.col("lines") - 1)).alias("place"))
    line = F.col("place").bitwiseAND(F.lit((1 << _LINE_BITS) - 1))
    gone = covered.groupBy(F.shiftright("place", _LINE_BITS).alias("d")).agg(F.array_sort(F.collect_set(line)).alias("gone"))
    gone = materialize(gone, "later-copies")
    joined = numbered.join(gone.hint("merge"), "d", "left").withColumn("lines", _lines(F.col("text")))
    dropped = F.coalesce("gone", F.array().cast("array<bigint>"))
    others = "array_except(sequence(0L, size(lines) - 1L), gone)"
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(
        F.expr(f"transform({others}, i -> lines[cast(i as int)])")
    )
    # A removed line begins a run unless the line before it went too.
    inner = F.array_intersect(F.transform(dropped, lambda n: n + 1), dropped)
    return joined.select(
        F.col("key").alias(key),
        F.concat_ws("\n", kept).alias("kept"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size(dropped).cast("bigint").alias("n_removed"),
        (F.size(dropped) - F.size(inner)).cast("bigint").alias("n_runs"),
    )
