"""Exact duplicates by two-pass Bloom filtering.

Pass 1 hashes every normalised text once and stores ``(row, doc_id, hash)``. From the hashes, positions of a Bloom filter
that were hit twice or more become a bitmap of bounded size. Pass 2 looks every hash up in that bitmap: a row with a
position nobody else hit has no copy and passes straight through; only the rest shuffle by hash and are compared in full.
A filter that is too small for the data lets more rows shuffle and changes no result.

Defined cases: a null text counts as empty; texts are equal when they are equal after each run of ``[\\x20\\x09-\\x0D]``
became one space. Of equal texts the smallest doc_id stays, a null doc_id only where the group has no other; among rows
of the same doc_id exactly one stays. An empty table gives an empty result. Other columns are kept as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
HASHES = 2
# Bits of the filter: at least BITS_PER_ROW each, at most MAX_BITS, which bounds the broadcast to 16 MB.
BITS_PER_ROW = 16
MAX_BITS = 1 << 27
SEGMENT_BITS = 1 << 15


def text_digest(text: str = "text") -> Column:
    """SHA-256 of the normalised text, as bytes."""
    normal = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")
    return F.unhex(F.sha2(normal.cast("binary"), 256))


def _positions(digest: Column, bits: int) -> list[Column]:
    """Filter positions: disjoint 60-bit slices of the digest, cut to the filter's size (a power of two)."""
    pieces = [F.conv(F.substring(F.hex(digest), 1 + 15 * k, 15), 16, 10).cast("bigint") for k in range(HASHES)]
    return [p.bitwiseAND(F.lit(bits - 1)) for p in pieces]


def filter_bits(rows: int, max_bits: int = MAX_BITS) -> int:
    return max(SEGMENT_BITS, min(max_bits, 1 << (BITS_PER_ROW * max(rows, 1) - 1).bit_length()))


def repeated_filter(hashes: DataFrame, digest: str, bits: int) -> DataFrame:
    """Bitmaps ``(segment, bitmap)`` of the positions hit at least twice; each holds SEGMENT_BITS bits.

    Hits are counted per position before they shuffle, so a text with a third of all rows costs one row per task.
    """
    hit = hashes.select(F.explode(F.array(*_positions(F.col(digest), bits))).alias("position"))
    twice = hit.groupBy("position").agg(F.count(F.lit(1)).alias("hits")).where("hits > 1")
    return twice.groupBy(F.expr("bitmap_bucket_number(position + 1)").alias("segment")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(position + 1))").alias("bitmap")
    )


def maybe_repeated(df: DataFrame, digest: str, bits: int, bitmaps: DataFrame, flag: str) -> DataFrame:
    """``flag``: every position of the row's hash was hit at least twice. The bitmaps are ``bits / 8`` bytes at most."""
    found = []
    for k, position in enumerate(_positions(F.col(digest), bits)):
        segment, bitmap, at = f"{flag}_segment{k}", f"{flag}_bitmap{k}", f"{flag}_at{k}"
        side = bitmaps.select(F.col("segment").alias(segment), F.col("bitmap").alias(bitmap))
        df = df.withColumn(at, position).join(
            F.broadcast(side), F.expr(f"bitmap_bucket_number({at} + 1)") == F.col(segment), "left"
        )
        byte = F.expr(f"conv(hex(substring({bitmap}, cast({at} % {SEGMENT_BITS} div 8 as int) + 1, 1)), 16, 10)")
        found.append(F.coalesce(F.getbit(byte.cast("bigint"), (F.col(at) % 8).cast("int")) == 1, F.lit(False)))
        df = df.withColumn(bitmap, found[-1])
    flags = [F.col(f"{flag}_bitmap{k}") for k in range(HASHES)]
    df = df.withColumn(flag, reduce(Column.__and__, flags))
    return df.drop(*[f"{flag}_{part}{k}" for part in ("segment", "bitmap", "at") for k in range(HASHES)])


def exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    hashed = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), text_digest(text).alias("digest")
        ),
        "digests",
    )
    bits = filter_bits(hashed.count(), max_bits)
    bitmaps = materialize(repeated_filter(hashed, "digest", bits), "bitmaps")
    flagged = maybe_repeated(hashed, "digest", bits, bitmaps, "maybe")
    alone = flagged.where("not maybe").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        "digest",
    )
    shared = flagged.where("maybe").select("row", "doc_id", "digest")
    # A hot digest is one row per task on its way here and many in ``shared``. Written first, so that the join deals both
    # sides by itself and can split a hot partition of ``shared`` at run time.
    groups = materialize(
        shared.groupBy("digest").agg(
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"),
            F.count(F.lit(1)).alias("group_size"),
        ),
        "copy-groups",
    )
    joined = shared.join(groups.hint("merge"), "digest").select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "digest",
    )
    every = alone.unionByName(joined)
    return every.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, unchanged. Rows without a possible copy never shuffle; of the others one whole row
    per text and task does. Among rows of the same doc_id the smallest of the other comparable columns stays.
    """
    columns, mark = docs.columns, "__copies"
    digests = docs.select(text_digest(text).alias("digest"))
    stored = materialize(digests, "digests")
    bits = filter_bits(stored.count(), max_bits)
    bitmaps = materialize(repeated_filter(stored, "digest", bits), "bitmaps")
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    hashed = docs.select(row.alias("row"), text_digest(text).alias("digest"))
    flagged = maybe_repeated(hashed, "digest", bits, bitmaps, mark)
    at = {c: i for i, c in enumerate(columns)}
    comparable = [f"row.c{i}" for i, (_, kind) in enumerate(docs.dtypes) if "map<" not in kind and "variant" not in kind]
    order = F.struct(F.col(f"row.c{at[doc_id]}").isNull(), f"row.c{at[doc_id]}", *comparable)
    firsts = flagged.where(mark).groupBy("digest").agg(F.min_by("row", order).alias("row"))
    every = flagged.where(~F.col(mark)).select("row").unionByName(firsts.select("row"))
    return every.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns)])
