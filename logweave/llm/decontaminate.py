"""Benchmark passages in training text, found with a distributed positional inverted index.

The index is sharded by document: one row per shard of bounded text size holds the sorted distinct terms of its documents
and, per term, the sorted positions where it stands. Building it shuffles nothing, and a term that every document has is
only a long list within each shard. The index is stored once and read once per block of test windows.

A search brings a block of windows, whose size is bounded, to the shards. In a shard each window starts from its rarest
term: the list of that term, moved back by the term's place in the window, gives the possible starts; the lists of the
other terms, rarest first, are intersected with it. With ``slop`` a term may stand so many words off its place.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; terms are 64-bit hashes of words, and a phrase
needs all its words to agree. Defined cases: a null text has no words and no hits; an item without words has no windows;
repeated windows and items count once; items without an id mark words as hit but are not listed; an empty benchmark
leaves every document clean; matches never cross from one document to another.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from logweave.llm.text import byte_class, flat, map_arrow, record, word_hashes
from logweave.session import materialize, sized_broadcast

WINDOW = 10
# (window, item) pairs a search carries to the shards at once, 100 bytes each.
BLOCK = 200_000
WORD = byte_class(lambda b: not (b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F))


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Store the postings of every word of every document: one row per shard."""
    kind = dict(docs.dtypes)[key]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, first = word_hashes(*flat(batch.column(1)), WORD)
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        heads = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
        rows = pa.array([0, batch.num_rows], pa.int32())
        return record(
            shard=[uuid.uuid4().hex],
            ids=pa.ListArray.from_arrays(rows, batch.column(0)),
            first=[first.astype("<i4").tobytes()],
            terms=[ranked[heads].astype("<u8").tobytes()],
            lists=[np.append(heads, len(ranked)).astype("<i4").tobytes()],
            positions=[order.astype("<i4").tobytes()],
        )

    schema = f"shard string, ids array<{kind}>, first binary, terms binary, lists binary, positions binary"
    return materialize(map_arrow(docs.selectExpr(f"`{key}` as key", f"`{text}` as text"), run, schema), "postings", large_rows=True)


def item_windows(items: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """Distinct ``(item, terms)``: hashes of ``window`` consecutive words, or all words of a shorter item."""

    kind = dict(items.dtypes)[item_id]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, first = word_hashes(*flat(batch.column(1)), WORD)
        raw = hashes.astype("<u8").tobytes()
        rows, terms = [], []
        for row, (low, high) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            size = min(window, high - low)
            for start in range(low, high - size + 1) if size else ():
                rows.append(row)
                terms.append(raw[8 * start : 8 * (start + size)])
        return record(item=batch.column(0).take(pa.array(rows, pa.int64())), terms=pa.array(terms, pa.binary()))

    source = items.selectExpr(f"`{item_id}` as item", f"`{text}` as text")
    return map_arrow(source, run, f"item {kind}, terms binary").distinct()


class Block:
    """Windows of a block: hashes in a padded matrix, lengths and the item of each."""

    def __init__(self, rows: list):
        self.windows = sorted({r["terms"] for r in rows})
        at = {w: k for k, w in enumerate(self.windows)}
        self.lengths = np.array([len(w) // 8 for w in self.windows], np.int64)
        width = int(self.lengths.max(initial=1))
        self.terms = np.zeros((len(self.windows), width), np.uint64)
        for k, w in enumerate(self.windows):
            self.terms[k, : len(w) // 8] = np.frombuffer(w, "<u8")
        self.items: list[list] = [[] for _ in self.windows]
        for r in rows:
            if r["item"] is not None:
                self.items[at[r["terms"]]].append(r["item"])


def matches(block: Block, terms: np.ndarray, lists: np.ndarray, positions: np.ndarray, first: np.ndarray, slop: int):
    """``(window, low, high)`` of all matches in one shard; low and high are the outer positions."""
    width = block.terms.shape[1]
    inside = np.arange(width) < block.lengths[:, None]
    at = np.minimum(np.searchsorted(terms, block.terms), len(terms) - 1)
    found = terms[at] == block.terms
    candidates = np.flatnonzero((found | ~inside).all(axis=1))
    at, inside = at[candidates], inside[candidates]
    size = np.where(inside, lists[at + 1] - lists[at], np.iinfo(np.int64).max)
    order = np.argsort(size, axis=1, kind="stable")
    rarest = np.take_along_axis(at, order[:, :1], 1)[:, 0]
    counts = lists[rarest + 1] - lists[rarest]
    row = np.repeat(np.arange(len(candidates)), counts)
    within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = positions[lists[rarest[row]] + within]
    document = np.searchsorted(first, place, side="right") - 1
    begin, end = first[document], first[document + 1]
    start = place - order[row, 0]
    low, high = place.copy(), place.copy()
    # One sorted list of (term, position) answers "does this term stand here" for all candidates at once.
    posting = (np.repeat(np.arange(len(terms)), np.diff(lists)) << 32) | positions
    for k in range(1, width):
        offset = order[row, k]
        asked = k < block.lengths[candidates[row]]
        target = start + offset
        least = np.maximum(target - slop, begin)
        most = np.minimum(target + slop, end - 1)
        base = at[row, offset] << 32
        spot = np.searchsorted(posting, base | np.maximum(least, 0))
        hit = posting[np.minimum(spot, len(posting) - 1)]
        there = (spot < len(posting)) & (hit >> 32 == at[row, offset]) & (hit & 0xFFFFFFFF <= most) & (least <= most)
        keep = there | ~asked
        stands = np.where(asked, hit & 0xFFFFFFFF, place)
        low, high = np.minimum(low, stands)[keep], np.maximum(high, stands)[keep]
        row, start, begin, end, place = row[keep], start[keep], begin[keep], end[keep], place[keep]
    return candidates[row], low, high


def search(index: DataFrame, windows: DataFrame, slop: int = 0, block_rows: int = BLOCK) -> DataFrame:
    """``shard, row, spans, items``: per document with matches the disjoint word spans they cover and the items found.

    The windows come in blocks of about ``block_rows`` pairs; each block reads the index once.
    """
    spark = index.sparkSession
    windows = materialize(windows, "windows")
    total = windows.count()
    blocks = max(1, -(-total // block_rows))
    kind = dict(windows.dtypes)["item"]
    schema = f"shard string, row int, spans array<struct<low:int,high:int>>, items array<{kind}>"
    span = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
    items = pa.list_(to_arrow_type(windows.schema["item"].dataType))
    fields = pa.schema([("shard", pa.string()), ("row", pa.int32()), ("spans", span), ("items", items)])
    found = []
    for number in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("terms", "item"), F.lit(blocks)) == number) if blocks > 1 else windows
        rows = part.collect()
        shared = spark.sparkContext.broadcast(Block(rows))

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch | None:
            made = []
            for row in range(batch.num_rows):
                made += _search_shard(batch.slice(row, 1).to_pylist()[0], shared.value, slop)
            return pa.RecordBatch.from_pylist(made, fields) if made else None

        if rows:
            shards = index.select("shard", "first", "terms", "lists", "positions")
            found.append(map_arrow(shards, run, schema))
    if not found:
        return spark.createDataFrame([], schema)
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("shard", "row").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )


def _search_shard(shard: dict, block: Block, slop: int) -> list[dict]:
    terms = np.frombuffer(shard["terms"], "<u8")
    if not len(terms):
        return []
    lists, positions, first = (np.frombuffer(shard[c], "<i4").astype(np.int64) for c in ("lists", "positions", "first"))
    window, low, high = matches(block, terms, lists, positions, first, slop)
    if not len(window):
        return []
    document = np.searchsorted(first, low, side="right") - 1
    order = np.lexsort((low, document))
    window, low, high, document = window[order], low[order], high[order], document[order]
    made = []
    for rows in np.split(np.arange(len(window)), np.flatnonzero(np.diff(document)) + 1):
        begin = int(first[document[rows[0]]])
        spans: list[dict] = []
        for a, b in zip((low[rows] - begin).tolist(), (high[rows] - begin + 1).tolist()):
            if spans and a <= spans[-1]["high"]:
                spans[-1]["high"] = max(spans[-1]["high"], b)
            else:
                spans.append({"low": a, "high": b})
        items = {i for w in np.unique(window[rows]).tolist() for i in block.items[w]}
        made.append({"shard": shard["shard"], "row": int(document[rows[0]]), "spans": spans, "items": sorted(items)})
    return made


def find_passages(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    window: int = WINDOW,
    slop: int = 0,
    block_rows: int = BLOCK,
) -> DataFrame:
    """One row per document: ``key, n_words, n_hit, items`` (sorted as strings), ``spans`` (disjoint, in words)."""
    index = build_index(docs, text, key)
    found = search(index, item_windows(items, item_text, item_id, window), slop, block_rows)
    kind = dict(docs.dtypes)[key]

    def sizes(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = [np.diff(np.frombuffer(f, "<i4")) for f in batch.column(2).to_pylist()]
        ids = batch.column(1).flatten()
        repeats = pa.array(np.repeat(np.arange(batch.num_rows), [len(c) for c in counts]), pa.int64())
        rows = np.concatenate([np.arange(len(c), dtype=np.int32) for c in counts])
        words = np.concatenate(counts).astype(np.int64)
        return record(shard=batch.column(0).take(repeats), row=rows, key=ids, n_words=words)

    every = map_arrow(index.select("shard", "ids", "first"), sizes, f"shard string, row int, key {kind}, n_words bigint")
    joined = every.join(found, ["shard", "row"], "left")
    step = """
        aggregate(array_sort(coalesce(spans, array())), cast(array() as array<struct<low:int,high:int>>), (kept, s) ->
            case when size(kept) > 0 and s.low <= element_at(kept, -1).high
                 then concat(slice(kept, 1, size(kept) - 1), array(named_struct('low', element_at(kept, -1).low,
                      'high', greatest(element_at(kept, -1).high, s.high))))
                 else concat(kept, array(s)) end)
    """
    return joined.withColumn("spans", F.expr(step)).select(
        F.col("key").alias(key),
        "n_words",
        F.expr("aggregate(spans, 0L, (n, s) -> n + s.high - s.low)").alias("n_hit"),
        F.expr("array_sort(transform(coalesce(items, array()), i -> cast(i as string)))").alias("items"),
        "spans",
    )


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", **options
) -> DataFrame:
    """The rows of ``docs`` without any window of an item, unchanged.

    A row is known by its id and a hash of its text, so rows are not written again. The contaminated ones are looked up in
    a list that is broadcast where it is small; else both sides shuffle.
    """
    mark = "__mark"
    marked = docs.withColumn(mark, F.struct(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h")))
    hit = find_passages(marked.select(mark, F.col(text).alias("text")), items, "text", mark, **options)
    # Structs compare with null ids as equal.
    dirty = sized_broadcast(hit.where("n_hit > 0").select(F.col(mark).alias("__dirty")).distinct(), "contaminated")
    kept = marked.join(dirty, F.col(mark).eqNullSafe(F.col("__dirty")), "left_anti")
    return kept.select(*[f"`{c}`" for c in docs.columns])
