"""Near duplicates by 64-bit SimHash with pigeonring filtering.

Fingerprints are cut into three segments on a ring. If two differ in at most two bits, some segment starts a chain in
which the first segment differs in no bit, the first two in at most one and all three in at most two (budgets in
proportion: the sum over l segments is at most 2 l / 3). So candidates share a key of a segment and its successor that
are equal or one bit apart, 42 to 43 bits in all: the fingerprint whose differing bit is set clears it in its key.
Only then follows the full Hamming check.

Equal fingerprints are one row from the start, so a text copied a billion times costs one row per task, and links are
sought between different fingerprints only. Components of the links never leave the executors.

Defined cases: a null text has no words; a text without words has fingerprint zero and is linked like any other; a text
of fewer words than a shingle is one shingle; repeated shingles count each time; a null doc_id is in a class like any
other row but names no class, so a class of null ids only has a null id; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.components import components
from logweave.llm.text import LOWER, map_arrow, record, texts
from logweave.session import materialize, sized_broadcast

SHINGLE = 3
SEED = 42
MAX_BITS = 2
# (shift, width) of the segments, in ring order.
SEGMENTS = ((0, 21), (21, 21), (42, 22))


def fingerprints(batch: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The SimHash of each text over hashes of its word shingles."""
    digests, sizes = [], []
    for text in batch:
        words = text.translate(LOWER).split()
        parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle))))
        made = b"".join(map(xxhash.xxh64_digest, parts, repeat(SEED))) if words else b""
        digests.append(made)
        sizes.append(len(made) // 8)
    result = np.zeros(len(batch), np.uint64)
    sizes = np.array(sizes, np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
        ends = np.cumsum(sizes[some])
        counts = np.add.reduceat(bits, ends - sizes[some], axis=0, dtype=np.int32)
        packed = np.packbits(2 * counts > sizes[some][:, None], axis=1)
        result[some] = packed.view(">u8")[:, 0]
    return result


def with_fingerprint(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """``key, fp``: fingerprints as signed 64-bit integers."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return record(key=batch.column(0), fp=fingerprints(texts(batch.column(1)), shingle).view(np.int64))

    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_arrow(source, run, f"key {dict(docs.dtypes)[key]}, fp bigint").withColumnRenamed("key", key)


def chain_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, key, cleared)``: each start segment with its successor, as it is and with each set bit of it cleared."""
    fp = fp.view(np.uint64)
    rows, keys, cleared = [], [], []
    for start, (shift, width) in enumerate(SEGMENTS):
        next_shift, next_width = SEGMENTS[(start + 1) % len(SEGMENTS)]
        first = fp >> np.uint64(shift) & np.uint64((1 << width) - 1)
        second = fp >> np.uint64(next_shift) & np.uint64((1 << next_width) - 1)
        key = np.uint64(start) << np.uint64(44) | first << np.uint64(22) | second
        rows.append(np.arange(len(fp)))
        keys.append(key)
        cleared.append(np.zeros(len(fp), bool))
        bit = np.uint64(1) << np.arange(next_width, dtype=np.uint64)
        row, column = np.nonzero(second[:, None] & bit)
        rows.append(row)
        keys.append(key[row] ^ bit[column])
        cleared.append(np.ones(len(row), bool))
    return np.concatenate(rows), np.concatenate(keys).view(np.int64), np.concatenate(cleared)


def links(distinct: DataFrame) -> DataFrame:
    """``a, b``: pairs of different fingerprints (column ``fp``, distinct) that differ in MAX_BITS bits or fewer."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        row, key, cleared = chain_keys(fp)
        return record(chain=key, fp=fp[row], cleared=cleared)

    keyed = map_arrow(distinct.select("fp"), run, "chain bigint, fp bigint, cleared boolean")
    probe = keyed.select("chain", F.col("fp").alias("a"), "cleared")
    index = keyed.where("not cleared").select("chain", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    pairs = probe.join(index, "chain").where(near & F.expr("a <> b and (cleared or a < b)"))
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: ``key, fingerprint`` (hex), ``component_id`` (smallest id reachable), ``fp``."""
    prints = materialize(with_fingerprint(docs, text, key, shingle), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min(key).alias("least_id")), "distinct-fingerprints")
    found = components(links(distinct), "links")
    # Fingerprint classes of more than one member, and the smallest id of each class.
    linked = found.join(distinct, found["node"] == distinct["fp"]).select("component", "fp", "least_id")
    smallest = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = linked.join(smallest, "component").select("fp", "component_id")
    alone = distinct.join(named, "fp", "left_anti").select("fp", F.col("least_id").alias("component_id"))
    classes = materialize(named.unionByName(alone), "classes")
    joined = prints.join(classes.hint("merge"), "fp")
    return joined.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


def row_mark(key: str, text: str) -> Column:
    """What a row is known by: its id (nulls last) and a hash of its text."""
    return F.struct(
        F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h")
    )


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay, unchanged: of each class the one with the smallest id (nulls last)."""
    marked = docs.select(row_mark(key, text).alias("__order"), F.col(text).alias("text"))
    return keep_first(docs, near_duplicates(marked, "text", "__order", shingle), text, key)


def keep_first(docs: DataFrame, found: DataFrame, text: str, key: str) -> DataFrame:
    """The rows of ``docs`` that are the first of their class in ``found`` (``__order`` as ``row_mark``, ``component_id``).

    A row is known by its id and a hash of its text, so rows need no number and are not written again. What goes is looked
    up in a list that is broadcast where it is small; else both sides shuffle. Of rows equal in id and text one stays.
    """
    order = "__order"
    found = materialize(found.groupBy(order).agg(F.min("component_id").alias("first"), F.count(F.lit(1)).alias("n")), "near")
    marked = docs.withColumn(order, row_mark(key, text))
    gone = sized_broadcast(found.where(F.col("first") != F.col(order)).select(order), "near-copies")
    kept = marked.join(gone, order, "left_anti")
    tied = found.where((F.col("first") == F.col(order)) & (F.col("n") > 1)).select(order)
    if not tied.isEmpty():
        tied = sized_broadcast(tied, "equal-rows")
        columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
        rows = kept.join(tied, order, "left_semi").select(order, F.struct(*columns).alias("row"))
        comparable = [f"row.c{i}" for i, (_, kind) in enumerate(docs.dtypes) if "map<" not in kind and "variant" not in kind]
        one = rows.groupBy(order).agg(F.min_by("row", F.struct(*comparable)).alias("row"))
        one = one.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)], order)
        kept = kept.join(tied, order, "left_anti").select(*[f"`{c}`" for c in docs.columns], order).unionByName(one)
    return kept.select(*[f"`{c}`" for c in docs.columns])
