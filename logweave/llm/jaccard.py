"""Near duplicates by the similarity of their word shingles: SimHash links and MinHash bands find pairs, whole sets decide.

A text is the set of its shingles of five words; equal sets are one row from the start. Pairs come from two sides:

1. SimHash fingerprints that differ in two bits, by the pigeonring search of ``simhash``: the closest copies.
2. BANDS keys of ROWS minima each. Two texts of Jaccard similarity 0.8 share one with probability
   1 - (1 - 0.8 ** 7) ** 48, all but 13 in a million.

A band that many texts share is no list of pairs. Its ends are its least and its greatest node; a node meets the ends it
shares most bands with, then those that are in other components. These pairs grow with the members. What they and SimHash
link is one component afterwards, and only members outside the largest component of their band meet the others of it. Before a pair becomes a row, sizes and sketches must let it reach the similarity: a
sketch is one bit of each minimum, of which a pair at 0.8 differs in a tenth; at most SKETCH_BITS may differ (5 standard
deviations more). It also holds the parities of the numbers of shingles in fixed places: two sets differ in at least as many
shingles as parities, so this rules out no similar pair, and of sets of up to about a thousand shingles it rules out nearly
all that are not similar. Then the whole sets are compared, so no pair below the similarity is linked.

Defined cases: words as in ``simhash`` (white space apart, ASCII letters lowered); a text of fewer words than a shingle is
one shingle; texts without words equal each other; repeated shingles count once; null ids and empty tables as in
``simhash``. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.components import components
from logweave.llm.simhash import keep_first, row_mark
from logweave.llm.simhash import links as simhash_links
from logweave.llm.text import SPACES, byte_class, flat, map_arrow, mix, record, word_hashes
from logweave.session import materialize, sized_broadcast

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 48, 7
# Words of a sketch, a bit for each of the first 64 * SKETCH minima, and how many of its bits may differ at similarity 0.8.
SKETCH, SKETCH_BITS = 5, 59
# Words of parities behind them.
PARITIES = 16
# Ends of its bands that a node meets before components are known; it meets the others where they are apart then.
FIRST_ENDS = 3
_IS_WORD = byte_class(lambda b: b not in SPACES)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TURNS = np.random.default_rng(8).integers(0, 1 << 32, (2, BANDS * ROWS), dtype=np.uint32) | np.array([[0], [1]], np.uint32)


def shingle_hashes(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, and where each text's begin (with their number at the end)."""
    words, first = word_hashes(*flat(column), _IS_WORD)
    counts = np.diff(first)
    starts = np.append(0, np.cumsum(np.maximum(counts - shingle + 1, 1)))
    made = np.zeros(len(words), np.uint64)
    for k in range(min(shingle, len(words))):
        made[: len(words) - k] = made[: len(words) - k] * _BASE + words[k:]
    text = np.repeat(np.arange(len(counts)), counts)
    whole = np.arange(len(words)) + shingle <= first[1:][text]
    result = np.zeros(starts[-1], np.uint64)
    result[np.repeat(counts >= shingle, np.diff(starts))] = made[whole]
    for i in np.flatnonzero(counts < shingle):
        value = np.full(1, counts[i], np.uint64)
        for word in words[first[i] : first[i + 1]]:
            value = value * _BASE + word
        result[starts[i]] = value[0]
    return mix(result), starts


def minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row per text and a column per order of the shingles: the least shingle in it."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    found = np.empty((len(starts) - 1, BANDS * ROWS), np.uint32)
    for turn in range(BANDS * ROWS):
        value = (low ^ _TURNS[0, turn]) * _TURNS[1, turn]
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x2C1B3C6D)
        found[:, turn] = np.minimum.reduceat(value, starts[:-1])
    return found


def band_keys(least: np.ndarray) -> np.ndarray:
    """A row per text and a column per band: the hash of ROWS minima."""
    keys = np.empty((len(least), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(least), band, np.uint64)
        for turn in range(band * ROWS, (band + 1) * ROWS):
            key = mix(key * _BASE + least[:, turn])
        keys[:, band] = key
    return keys


def sketches(least: np.ndarray) -> np.ndarray:
    """A bit of each minimum, as SKETCH words."""
    bits = (least[:, : 64 * SKETCH] * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return np.packbits(bits.astype(bool), axis=1).view(np.int64)


def parities(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of sets of shingles, in PARITIES words: whether the number of a set's shingles in each place is odd."""
    places, sets = 64 * PARITIES, len(starts) - 1
    at = np.repeat(np.arange(sets), np.diff(starts)) * places + (hashes % np.uint64(places)).astype(np.int64)
    odd = np.bincount(at, minlength=sets * places).reshape(sets, places) & 1
    return np.packbits(odd.astype(bool), axis=1).view(np.int64)


def simhashes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit fingerprints: a bit is set where it is in over half of the shingles."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = np.add.reduceat(bits, starts[:-1], axis=0, dtype=np.int32) * 2 > np.diff(starts)[:, None]
    return np.packbits(over, axis=1, bitorder="little").view(np.int64).ravel()


def _sets(hashes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    return [np.unique(hashes[a:b]) for a, b in zip(starts, starts[1:])]


def with_bands(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """``key, digest, size, bands, sketch, fp``: of each text's set of shingles; digests are equal where the sets are."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, starts = shingle_hashes(batch.column(1), shingle)
        sets, least = _sets(hashes, starts), minima(hashes, starts)
        flat_sets, ends = np.concatenate(sets), np.append(0, np.cumsum([len(s) for s in sets]))
        keys, short = band_keys(least).view(np.int64), np.hstack([sketches(least), parities(flat_sets, ends)])
        width = SKETCH + PARITIES
        return record(
            key=batch.column(0),
            digest=pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
            size=np.array([len(s) for s in sets], np.int64),
            bands=pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), keys.ravel()),
            sketch=pa.ListArray.from_arrays(np.arange(0, short.size + 1, width, dtype=np.int32), short.ravel()),
            fp=simhashes(flat_sets, ends),
        )

    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = dict(docs.dtypes)[key]
    schema = f"key {kind}, digest binary, size bigint, bands array<bigint>, sketch array<bigint>, fp bigint"
    return map_arrow(source, run, schema).withColumnRenamed("key", key)


def _similar(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """The ``a, b`` whose sets reach the similarity."""
    times, of = similarity.denominator, similarity.numerator

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep[i] = both * times >= of * (len(x) + len(y) - both)
        kept = batch.filter(pa.array(keep))
        return record(a=kept.column(0), b=kept.column(1))

    a, b = (sets.select(F.col("node").alias(c), F.col("set").alias(f"{c}_set")).hint("merge") for c in "ab")
    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "a_set", "b_set")
    return map_arrow(joined, run, "a bigint, b bigint", column="a_set")


def _may_reach(x: str, y: str, similarity: Fraction) -> Column:
    """Whether sizes and sketches of two structs let their sets reach the similarity."""
    less, more = F.least(f"{x}.size", f"{y}.size"), F.greatest(f"{x}.size", f"{y}.size")

    def apart_in(words: range) -> Column:
        # Sketches without parities let a pair pass.
        differ = [F.bit_count(F.get(f"{x}.sketch", F.lit(k)).bitwiseXOR(F.get(f"{y}.sketch", F.lit(k)))) for k in words]
        return sum([F.coalesce(d, F.lit(0)) for d in differ], F.lit(0))

    # The shingles that only one of two sets has are at most this share of both at the similarity.
    p, q = similarity.numerator, similarity.denominator
    possible = apart_in(range(SKETCH, SKETCH + PARITIES)) * (q + p) <= (less + more) * (q - p)
    bits = 64 * SKETCH
    # A tenth differs at 0.8; the same distance in standard deviations at another similarity.
    share = float(1 - similarity) / 2
    allowed = min(bits, round(bits * share + (SKETCH_BITS - bits * 0.1) * (share * (1 - share) / 0.09) ** 0.5))
    return (less * q >= more * p) & (apart_in(range(SKETCH)) <= allowed) & possible


def _in_order(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _simhash_pairs(distinct: DataFrame) -> DataFrame:
    """``a, b`` of nodes whose fingerprints differ in few bits: a node stands for each fingerprint."""
    first = materialize(distinct.groupBy("fp").agg(F.min("node").alias("node")), "fingerprint-nodes")
    equal = distinct.select("fp", F.col("node").alias("a")).join(first.withColumnRenamed("node", "b"), "fp").where("a <> b")
    near = simhash_links(first.select("fp"))
    for side in "ab":
        near = near.join(first.select(F.col("fp").alias(side), F.col("node").alias(f"n{side}")), side)
    return equal.select("a", "b").unionByName(near.select(F.col("na").alias("a"), F.col("nb").alias("b")))


def links(distinct: DataFrame, texts: DataFrame, shingle: int, similarity: Fraction) -> DataFrame:
    """``a, b``: pairs that join all nodes of a component.

    ``distinct`` has ``node, size, bands, sketch, fp, least``, ``texts`` has ``least, text``.
    """
    keyed = distinct.select("node", F.explode("bands").alias("band"))
    ends = keyed.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    members = materialize(keyed.join(materialize(ends, "bands").hint("merge"), "band"), "band-members")
    short = materialize(distinct.select("node", F.struct("node", "size", "sketch").alias("x")), "sketches")

    def near(pairs: DataFrame) -> DataFrame:
        pairs = materialize(_in_order(pairs), "pairs")
        x = short.select(F.col("node").alias("a"), "x").hint("merge")
        y = short.select(F.col("node").alias("b"), F.col("x").alias("y")).hint("merge")
        return materialize(pairs.join(x, "a").join(y, "b").where(_may_reach("x", "y", similarity)).select("a", "b"), "near-pairs")

    def named(of: DataFrame) -> DataFrame:
        found = members.join(of.hint("merge"), "node", "left")
        return materialize(found.withColumn("component", F.coalesce("component", "node")), "named-members")

    # 1. SimHash neighbours, and of the ends of its bands those that a node meets most often, the most similar ones.
    to_ends = members.select(F.col("node").alias("a"), F.explode(F.array("low", "high")).alias("b")).where("a <> b")
    often = to_ends.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    best = often.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "b")), False), 1, FIRST_ENDS).alias("ends"))
    best = best.select("a", F.explode("ends.b").alias("b"))
    found = near(best.unionByName(_simhash_pairs(distinct)))
    wanted = found.select(F.explode(F.array("a", "b")).alias("node")).unionByName(members.select("node"))
    sets = _shingle_sets(wanted.distinct().join(distinct, "node").select("least", "node"), texts, shingle)
    first = materialize(_similar(found, sets, similarity), "first-links")

    # 2. The other ends, as far as they are in other components.
    rows = named(materialize(components(first, "components"), "components"))
    of_ends = rows.groupBy("band").agg(
        F.min_by("component", "node").alias("low_in"), F.max_by("component", "node").alias("high_in"),
        F.min("component").alias("c"), F.max("component").alias("d"),
    )
    apart = rows.join(materialize(of_ends.where("c <> d").select("band", "low_in", "high_in"), "end-components").hint("merge"), "band")
    others = F.array(F.when(F.col("low_in") != F.col("component"), F.col("low")), F.when(F.col("high_in") != F.col("component"), F.col("high")))
    others = apart.select(F.col("node").alias("a"), F.explode(F.filter(others, lambda e: e.isNotNull())).alias("b"))
    second = near(others)
    joined = materialize(first.unionByName(_similar(second, sets, similarity)), "end-links")

    # 3. Members outside the largest component of their band meet the others of it.
    rows = named(materialize(components(joined, "components"), "components"))
    sizes = rows.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("band").agg(F.max(F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts"))
    main = materialize(main.where("parts > 1").select("band", F.col("main.component").alias("main")), "main-components")
    open_members = rows.join(main.hint("merge"), "band").join(short.hint("merge"), "node")
    open_members = materialize(open_members.select("band", "component", "main", "x"), "open-members")
    outside = open_members.where("component <> main").select("band", "component", "x")
    inside = open_members.select("band", F.col("component").alias("other"), F.col("x").alias("y"), (F.col("component") == F.col("main")).alias("in_main"))
    once = F.expr("component <> other and (in_main or x.node < y.node)")
    pairs = outside.hint("merge").join(inside, "band").where(once & _may_reach("x", "y", similarity))
    pairs = materialize(_in_order(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))), "inner-pairs")
    # Pairs that were compared already are not compared again.
    tried = found.unionByName(second)
    return joined.unionByName(_similar(pairs.join(tried.hint("merge"), ["a", "b"], "left_anti"), sets, similarity))


def _shingle_sets(wanted: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """``node, set`` of the wanted ``least, node``, made anew from their texts and written once."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = _sets(*shingle_hashes(batch.column(1), shingle))
        return record(node=batch.column(0), set=pa.array([s.tobytes() for s in made], pa.binary()))

    chosen = texts.join(sized_broadcast(wanted, "band-nodes"), "least").select("node", "text")
    sets = map_arrow(chosen, run, "node bigint, set binary").groupBy("node").agg(F.first("set").alias("set"))
    return materialize(sets, "shingle-sets")


def near_copies(
    docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """One row per document: ``key, component_id`` (smallest id reachable over pairs of the similarity or more)."""
    prints = materialize(with_bands(docs, text, key, shingle), "set-prints")
    sets = prints.groupBy("digest").agg(F.min(key).alias("least"), *[F.first(c).alias(c) for c in ("size", "bands", "sketch", "fp")])
    distinct = materialize(sets.withColumn("node", F.monotonically_increasing_id()), "distinct-sets")
    texts = docs.select(F.col(key).alias("least"), F.col(text).alias("text"))
    found = components(links(distinct, texts, shingle, Fraction(str(similarity))), "links")
    linked = found.join(distinct.select("node", "digest", "least"), "node")
    smallest = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(smallest, "component").select("digest", "component_id")
    alone = distinct.join(named, "digest", "left_anti").select("digest", F.col("least").alias("component_id"))
    classes = materialize(named.unionByName(alone), "classes")
    return prints.join(classes.hint("merge"), "digest").select(key, "component_id")


def drop_near_copies(
    docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """The rows of ``docs`` that stay, unchanged: of each class the one with the smallest id (nulls last)."""
    marked = docs.select(row_mark(key, text).alias("__order"), F.col(text).alias("text"))
    return keep_first(docs, near_copies(marked, "text", "__order", shingle, similarity), text, key)
