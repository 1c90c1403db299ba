"""Repeated byte strings removed from whole texts, with suffix arrays over shards of content.

A string of ``length`` bytes is anchored at the k-byte piece of least hash inside it, so equal strings have equal anchors
at the same place. Consecutive strings with one anchor are a segment. That decides what meets where:

1. Anchors are counted. A string that starts twice has an anchor that occurs twice, so only segments of repeated anchors
   go on; a bitmap of bounded size, in which repeated anchors are marked, picks them where the text is read.
2. Segments are dealt into shards by anchor. A shard of bounded size builds its suffix array (Larsson-Sadakane) and common
   prefixes (Kasai); strings of an interval of common prefix ``length`` or more are repeated. Equal segments are one.
3. An anchor with very many segments is dealt to several shards. Those send one digest per distinct string to merging
   tasks, which look each shard's sorted digests up in all of them by binary search.
4. Repeated starts become byte spans, the spans of a document are merged, and its remaining bytes are joined.

Defined cases: a null text is empty; matches never cross documents; overlapping occurrences count, as do rows that repeat
(also with one doc_id); texts shorter than ``length`` keep all bytes; what is left may end within a character, so it is
bytes; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.exact_dedup import SEGMENT_BITS, filter_bits
from logweave.llm.suffix_array import common_prefixes, suffix_array
from logweave.llm.text import flat, map_arrow, mix, prefix_hashes, record, slice_hashes
from logweave.session import materialize

LENGTH = 200
PIECE = 32
SHARD_BYTES = 1_200_000
# An anchor with more segments than this is dealt to several shards; the list of such anchors has HOT_ROWS rows at most.
HOT_SEGMENTS, HOT_ROWS = 1_500, 1_000_000
# Digests a merging task holds.
MERGE_ROWS = 500_000
_CHUNK = 1 << 21
_PLACE_BITS = 22


def anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """``(start, count, anchor hash)`` of all segments; ``start`` is in ``data``, ``count`` the strings it has.

    A long text is taken in chunks of string starts; an anchor at a chunk's end makes two segments, which is harmless.
    """
    piece = min(PIECE, length)
    width = length - piece + 1
    total = len(data)
    starts, counts, hashes = [], [], []
    for low in range(0, max(total - length + 1, 0), _CHUNK):
        part = data[low : min(low + _CHUNK + length - 1, total)]
        n = len(part) - piece + 1
        sums, down = prefix_hashes(part)
        index = np.arange(n)
        value = slice_hashes(sums, down, index, index + piece)
        key = value >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS) | index.astype(np.uint64)
        # Least key of each run of ``width`` places: the least of a block's end and of the next block's beginning.
        padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max)
        padded[:n] = key
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        strings = n - width + 1
        least = np.minimum(behind[:strings], ahead[width - 1 : width - 1 + strings])
        anchor = (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        # Strings inside one text only.
        document = np.searchsorted(offsets, low + np.arange(strings), side="right") - 1
        whole = np.flatnonzero(low + np.arange(strings) + length <= offsets[document + 1])
        if not len(whole):
            continue
        document, anchor = document[whole], anchor[whole]
        cut = (np.diff(whole) > 1) | (np.diff(anchor) != 0) | (np.diff(document) != 0)
        heads = np.flatnonzero(np.append(True, cut))
        starts.append(low + whole[heads])
        counts.append(np.diff(np.append(heads, len(whole))))
        hashes.append(value[anchor[heads]])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(hashes)


def _count_anchors(docs: DataFrame, length: int) -> DataFrame:
    """``anchor, n`` of anchors that occur twice or more."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, counts = np.unique(anchors(*flat(batch.column(0)), length)[2], return_counts=True)
        return record(anchor=found.view(np.int64), n=counts)

    counted = map_arrow(docs.select("text"), run, "anchor bigint, n bigint").groupBy("anchor")
    return counted.agg(F.sum("n").alias("n")).where("n > 1")


class Plan:
    """Which anchors may be repeated (a bitmap of bounded size), which are split, and how many shards there are."""

    def __init__(self, repeated: DataFrame):
        segments, total = repeated.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.bits = filter_bits(segments)
        at = F.pmod("anchor", F.lit(self.bits)) + 1
        rows = repeated.select(at.alias("at")).groupBy(F.expr("bitmap_bucket_number(at)").alias("segment")).agg(
            F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bitmap")
        )
        self.bitmap = np.zeros(self.bits // 8, np.uint8)
        for row in rows.toLocalIterator():
            low = (row["segment"] - 1) * SEGMENT_BITS // 8
            self.bitmap[low : low + SEGMENT_BITS // 8] = np.frombuffer(row["bitmap"], np.uint8)
        self.shards = max(1, -(-total * 290 // SHARD_BYTES))
        self.limit = max(HOT_SEGMENTS, total // HOT_ROWS)
        hot = repeated.where(F.col("n") > self.limit).toPandas().sort_values("anchor")
        self.hot = hot["anchor"].to_numpy(np.int64)
        self.parts = -(-hot["n"].to_numpy(np.int64) // self.limit)
        self.strings = int(hot["n"].sum())

    def maybe(self, anchor: np.ndarray) -> np.ndarray:
        at = (anchor & np.uint64(self.bits - 1)).astype(np.int64)
        return (self.bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def deal(self, anchor: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard of each segment and whether its anchor is split; ``turn`` spreads the segments of a split anchor."""
        signed = anchor.view(np.int64)
        shard = mix(anchor)
        if not len(self.hot):
            return (shard % np.uint64(self.shards)).astype(np.int64), np.zeros(len(anchor), bool)
        at = np.minimum(np.searchsorted(self.hot, signed), len(self.hot) - 1)
        split = self.hot[at] == signed
        part = mix(turn) % np.where(split, self.parts[at], 1).astype(np.uint64)
        shard = np.where(split, mix(shard + part * np.uint64(0x9E3779B97F4A7C15)), shard)
        return (shard % np.uint64(self.shards)).astype(np.int64), split


def repeated_strings(column: pa.Array, counts: np.ndarray, split: np.ndarray, length: int):
    """Of one shard's segments: spans of repeated strings as ``(segment, low, high)`` arrays, and of split anchors
    ``(segment, string, digest, alone)`` with one row per distinct string; ``alone`` tells that the shard has it once.

    Spans are merged where they touch and count from the segment's begin.
    """
    coded = column.cast(pa.large_binary()).dictionary_encode()
    owner = coded.indices.to_numpy().astype(np.int64)
    first = np.unique(owner, return_index=True)[1]
    copies = np.bincount(owner)
    text, offsets = flat(coded.dictionary)
    sizes, begin = np.diff(offsets), offsets[:-1]
    segment = np.repeat(np.arange(len(first)), sizes)
    place = np.arange(len(text)) - begin[segment]
    starts = place < counts[first][segment]
    sa = suffix_array(text)
    interval = np.cumsum(common_prefixes(text, sa) < length)
    chosen = starts[sa]
    sa, interval = sa[chosen], interval[chosen]
    interval = np.cumsum(np.append(True, np.diff(interval) != 0)) - 1 if len(sa) else interval
    weight = np.bincount(interval, copies[segment[sa]], interval[-1] + 1 if len(sa) else 0)
    again = weight[interval] > 1
    # Strings of split anchors, the first of each interval.
    heads = np.flatnonzero(np.append(True, np.diff(interval) != 0)) if len(sa) else np.zeros(0, np.int64)
    heads = heads[split[first][segment[sa[heads]]]]
    at, raw = sa[heads], text.tobytes()
    keys = [hashlib.blake2b(raw[a : a + length], digest_size=16).digest() for a in at.tolist()]
    distinct = _runs(np.sort(sa[again]), segment, place, length)
    return _copied(*distinct, owner), (first[segment[at]], place[at], keys, ~again[heads])


def _runs(hits: np.ndarray, segment: np.ndarray, place: np.ndarray, length: int):
    """``(segment, low, high)`` of sorted starts of strings, merged where they touch."""
    if not len(hits):
        return (np.zeros(0, np.int64),) * 3
    cut = np.append(True, (np.diff(hits) > length) | (np.diff(segment[hits]) != 0))
    lows, highs = hits[cut], hits[np.append(cut[1:], True)]
    return segment[lows], place[lows], place[highs] + length


def _copied(segment: np.ndarray, low: np.ndarray, high: np.ndarray, owner: np.ndarray):
    """Spans of distinct segments for all segments, where ``owner`` is the distinct one of each."""
    count = np.bincount(segment, minlength=int(owner.max(initial=-1)) + 1)
    begin, times = np.cumsum(count) - count, count[owner]
    rows = np.repeat(np.arange(len(owner)), times)
    at = np.repeat(begin[owner] - (np.cumsum(times) - times), times) + np.arange(len(rows))
    return rows, low[at], high[at]


def duplicate_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``key, print, spans`` of every text with repeated strings; ``docs`` has ``key, print, text``."""
    kind = dict(docs.dtypes)["key"]
    repeated = materialize(_count_anchors(docs, length), "anchors")
    plan = Plan(repeated)
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        data, offsets = flat(batch.column(2))
        start, count, anchor = anchors(data, offsets, length)
        chosen = shared.value.maybe(anchor)
        start, count, anchor = start[chosen], count[chosen], anchor[chosen]
        if not len(start):
            return None
        document = np.searchsorted(offsets, start, side="right") - 1
        prints = batch.column(1).to_numpy(zero_copy_only=False)[document]
        shard, split = shared.value.deal(anchor, prints.view(np.uint64) + start.astype(np.uint64))
        raw = data.tobytes()
        parts = [raw[s : s + c - 1 + length] for s, c in zip(start.tolist(), count.tolist())]
        return record(
            shard=shard,
            key=batch.column(0).take(pa.array(document)),
            print=prints,
            low=start - offsets[document],
            count=count.astype(np.int32),
            split=split,
            part=pa.array(parts, pa.binary()),
        )

    dealt = map_arrow(
        docs.select("key", "print", "text"),
        cut,
        f"shard bigint, key {kind}, print bigint, low bigint, count int, split boolean, part binary",
    )

    def judge(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = {name: table.column(name).chunk(0) for name in table.column_names}
        counts = column["count"].to_numpy().astype(np.int64)
        split = column["split"].to_numpy(zero_copy_only=False)
        low = column["low"].to_numpy()
        (took, begin, end), (rows, strings, keys, alone) = repeated_strings(column["part"], counts, split, length)
        every, n = pa.array(np.concatenate([took, rows])), len(took)
        at = low[rows] + strings
        return pa.table(
            {
                "shard": column["shard"].take(every),
                "key": column["key"].take(every),
                "print": column["print"].take(every),
                "low": np.concatenate([low[took] + begin, at]),
                "high": np.concatenate([low[took] + end, at + length]),
                "digest": pa.array([None] * n + keys, pa.binary()),
                "alone": np.concatenate([np.zeros(n, bool), alone]),
            }
        )

    schema = f"shard bigint, key {kind}, print bigint, low bigint, high bigint, digest binary, alone boolean"
    judged = dealt.groupBy("shard").applyInArrow(judge, schema)
    if not len(plan.hot):
        spans = judged.select("key", "print", "low", "high")
    else:
        judged = materialize(judged, "judged")
        merges = max(1, -(-plan.strings * 100 // MERGE_ROWS))
        digests = judged.where("digest is not null").withColumn("task", F.pmod(F.xxhash64("digest"), F.lit(merges)))
        met = digests.groupBy("task").applyInArrow(_merge, f"key {kind}, print bigint, low bigint, high bigint")
        spans = judged.where("digest is null").select("key", "print", "low", "high").unionByName(met)
    return spans.groupBy("key", "print").agg(F.collect_set(F.struct("low", "high")).alias("spans"))


def _merge(table: pa.Table) -> pa.Table:
    """Strings that several shards sent: each shard's sorted digests are looked up in those of all by binary search."""
    table = table.combine_chunks()
    raw = np.frombuffer(b"".join(table.column("digest").to_pylist()), ">u8").reshape(-1, 2)
    halves = np.unique(raw, axis=0, return_inverse=True)[1].ravel()
    every = np.sort(halves)
    shard = table.column("shard").to_numpy()
    repeated = np.zeros(len(halves), bool)
    order = np.lexsort((halves, shard))
    for rows in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        mine = halves[rows]
        repeated[rows] = np.searchsorted(every, mine, side="right") - np.searchsorted(every, mine, side="left") > 1
    chosen = pa.array(repeated & table.column("alone").to_numpy(zero_copy_only=False))
    return table.filter(chosen).select(["key", "print", "low", "high"])


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """One row per document: ``key, kept`` (remaining bytes), ``n_bytes, n_removed, n_spans``."""
    # Rows of one id are told apart by their text; rows equal in both have equal spans.
    source = docs.select(
        F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("print"), F.col(text).alias("text")
    )
    spans = duplicate_spans(source, length)
    mine, theirs = source.alias("d"), spans.alias("s")
    same = F.expr("d.print = s.print and d.key <=> s.key")
    joined = mine.join(theirs, same, "left").select("d.key", "d.text", "s.spans")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, sizes, removed, runs = [], [], [], []
        for raw, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
            raw = raw or b""
            parts, at, gone, count = [], 0, 0, 0
            for span in sorted(spans or [], key=lambda s: (s["low"], s["high"])):
                if span["low"] > at or not count:
                    parts.append(raw[at : span["low"]])
                    at, count = span["low"], count + 1
                gone += max(span["high"] - at, 0)
                at = max(at, span["high"])
            parts.append(raw[at:])
            kept.append(b"".join(parts))
            sizes.append(len(raw))
            removed.append(gone)
            runs.append(count)
        return record(
            key=batch.column(0),
            kept=pa.array(kept, pa.binary()),
            n_bytes=pa.array(sizes, pa.int64()),
            n_removed=pa.array(removed, pa.int64()),
            n_spans=pa.array(runs, pa.int64()),
        )

    schema = f"key {dict(docs.dtypes)[key]}, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint"
    return map_arrow(joined, run, schema).withColumnRenamed("key", key)
