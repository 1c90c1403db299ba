"""Shards by a consistent-hash ring with virtual nodes and bounded loads; DataFrame functions only.

Every shard owns ``nodes`` places on a ring of 60-bit positions, every document the position of its key. Going clockwise
from position 0, each document goes to the first place at or after its own whose shard has room; after the last place the
ring begins again. With ``slack`` 0 the rooms add up to the number of documents and differ by one at most, so all shards
end full; with a positive slack a shard takes up to ``(1 + slack)`` times the mean.

Documents and places are sorted by position in one range shuffle of narrow rows and numbered from the written order. What
lies between two places is then a run of numbers, so the rule needs the numbers of the places only: ``shards * nodes`` rows
and one row per partition reach the driver, which deals the runs and sends back as many intervals. Equal positions are
parted by further columns, so no key is too hot for the sort.

A further shard moves few documents: those that its places take, and those that the smaller rooms push on. With 128 places
the ring of 8 moves about 0.13 of the documents when a ninth comes (0.11 is the least possible).

Defined cases: a null key has the position of the word ``null``; a null text has no bytes; documents of one position are
taken by key (nulls first), size and checksum, so that equal rows may swap places and nothing else; a repeated key is as
many documents; an empty table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.session import materialize

SHARDS, NODES = 8, 128
# Positions have this many hexadecimal digits of an MD5.
_DIGITS = 15
_PART = 33  # monotonically_increasing_id: the partition stands above this many bits


def position(key: Column) -> Column:
    """A place on the ring: the first 60 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, _DIGITS), 16, 10).cast("bigint")


def rooms(rows: int, shards: int, slack: float) -> list[int]:
    """How many documents each shard may take."""
    if slack:
        return [ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def deal(places: Sequence[tuple[int, int]], rows: int, room: list[int]) -> list[tuple[int, int, int, int]]:
    """Runs ``(first, last + 1, shard, slot)`` of document numbers from ``(documents before, shard)`` of each place."""
    room, taken, runs = list(room), [0] * len(room), []
    starts = [0] + [before for before, _ in places]
    ends = [before for before, _ in places] + [rows]
    for arc, (low, high) in enumerate(zip(starts, ends)):
        at = arc
        while low < high:
            shard = places[at % len(places)][1]
            n = min(room[shard], high - low)
            if n:
                runs.append((low, low + n, shard, taken[shard]))
                room[shard] -= n
                taken[shard] += n
                low += n
            at += 1
    return runs


def _intervals(ordered: DataFrame, shards: int, slack: float) -> list[dict]:
    """The dealt runs as intervals of ``number``, cut where a partition of the sort ends."""
    part = F.shiftrightunsigned("number", _PART)
    counts = {r.p: r.n for r in ordered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    marks = sorted((r.number, r.shard) for r in ordered.where("shard is not null").select("number", "shard").collect())
    rows = sum(counts.values()) - len(marks)
    # Documents before each place and, per partition, its first document and the places in it.
    before, start = {}, 0
    for p in sorted(counts):
        before[p] = start
        start += counts[p]
    places = [(before[n >> _PART] + (n & ((1 << _PART) - 1)) - i, shard) for i, (n, shard) in enumerate(marks)]
    # Stretches without a place: documents ``low`` to ``high`` have consecutive numbers from ``number``.
    stretches, seen, passed = [], 0, 0
    for p in sorted(counts):
        rank, inside = 0, [n & ((1 << _PART) - 1) for n, _ in marks if n >> _PART == p]
        for stop in [*inside, counts[p]]:
            if stop > rank:
                stretches.append((seen, seen + stop - rank, (p << _PART) + rank))
                seen += stop - rank
            rank = stop + 1
    found, k = [], 0
    for low, high, shard, slot in deal(places, rows, rooms(rows, shards, slack)):
        while low < high:
            while stretches[k][1] <= low:
                k += 1
            first, last, number = stretches[k]
            n = min(high, last) - low
            begin = number + low - first
            found.append({"part": begin >> _PART, "begin": begin, "end": begin + n, "to": shard, "slot": slot})
            low, slot = low + n, slot + n
    return found


def assign(
    docs: DataFrame,
    shards: int = SHARDS,
    key: str = "doc_id",
    text: str = "text",
    nodes: int = NODES,
    slack: float = 0.0,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per document: ``key, size, text_crc32, shard, slot`` and the columns of ``keep``.

    ``size`` is the bytes of the text and one more, ``slot`` counts a shard's documents from 0 without gaps.
    """
    own = {key, "size", "text_crc32", "shard", "slot"}
    if own & set(keep):
        raise ValueError(f"columns the result has itself: {sorted(own & set(keep))}")
    spark = docs.sparkSession
    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    keyed = docs.select(
        position(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))).alias("position"),
        F.lit(False).alias("place"),
        F.col(f"`{key}`").alias("key"),
        (F.octet_length(raw) + 1).cast("bigint").alias("size"),
        F.crc32(raw).alias("crc"),
        F.monotonically_increasing_id().alias("row"),
        F.lit(None).cast("int").alias("shard"),
        F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)] or [F.lit(0).alias("none")]).alias("kept"),
    )
    keyed = materialize(keyed, "ring-keys")
    of, node = F.expr(f"cast(id div {nodes} as int)"), F.expr(f"id % {nodes}")
    places = spark.range(shards * nodes).select(
        position(F.concat(F.lit("shard "), of.cast("string"), F.lit(" place "), node.cast("string"))).alias("position"),
        F.lit(True).alias("place"),
        of.alias("shard"),
        F.col("id").alias("row"),
    )
    # A place comes after the documents of its position, which are its own.
    order = ["position", "place", "key", "size", "crc", "row"]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = keyed.unionByName(places, allowMissingColumns=True)
    ordered = every.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    ordered = materialize(ordered.withColumn("number", F.monotonically_increasing_id()), "ring-order")
    schema = "array<struct<part bigint, begin bigint, end bigint, to int, slot bigint>>"
    # As many rows as places and partitions.
    runs = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(_intervals(ordered, shards, slack))), schema)))
    runs = runs.withColumnRenamed("slot", "base")
    rows = ordered.where("not place").withColumn("part", F.shiftrightunsigned("number", _PART)).drop("shard")
    dealt = rows.join(F.broadcast(runs), "part").where("number >= begin and number < end")
    return dealt.select(
        F.col("key").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.col("to").alias("shard"),
        (F.col("base") + F.col("number") - F.col("begin")).alias("slot"),
        *[F.col(f"kept.k{i}").alias(c) for i, c in enumerate(keep)],
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", text: str = "text", **options) -> None:
    """Write all rows of ``docs`` below ``path``, a folder ``shard=k`` per shard, with their slots."""
    columns = [c for c in docs.columns if c != key]
    made = assign(docs, shards, key, text, keep=columns, **options).drop("size", "text_crc32")
    made.write.partitionBy("shard").parquet(path)
