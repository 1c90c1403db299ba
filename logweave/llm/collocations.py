"""Phrases of two to four words that stand together more often than their parts, per language.

Sequences are counted in HAT-tries (``hat_trie``), one per task, bounded by entries. Subtrees that leave go as sorted
runs, one packed run per prefix partition (a hash of language and first two words, so that what begins alike meets and no
single first word makes a partition), and each partition adds up its runs. There are as many partitions as the texts have
PART_BYTES, PARTS at most; a partition holds the different sequences of its prefixes.

A phrase that stands ``min_count`` times has only parts that do. So words are counted first, then pairs of words that
reach the count, then sequences of three and four whose pairs all do. What reached it goes to the next pass as a bitmap of
hashes, at most MAX_BITS long; where different sequences share a bit, or the bitmap is full, more is counted and nothing
is lost. Counts are exact: the trie's ids stand for words, not hashes.

The score of a phrase is ``floor(2000000 a / (l + r))`` for the cut that makes it least (then the first such cut), with
``a``, ``l`` and ``r`` the counts of the phrase, the part before and the part behind the cut. A phrase inside a longer one
that reaches ``cover`` percent of its count is left out. Products are decimals of 38 digits.

Defined cases: a null text is empty, a null language is ``und``; ASCII letters are lowered; repeated rows count each time;
ties in the ranking go by phrase; an empty table gives an empty result; other columns do not matter. A text longer than
``text.PIECE_BYTES`` is read in windows that overlap by three words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.llm.hat_trie import ID_BITS, HatTrie, pack, unpack
from logweave.llm.text import LOWER, PIECE_BYTES, byte_class, flat, give_back, mix, pieces, prefix_hashes, safe_hashes, small_batches, word_bounds
from logweave.session import materialize, sized_broadcast

LONGEST, MIN_COUNT, COVER, TOP = 4, 30, 80, 2000
# Entries of a trie, words of its vocabulary and bytes of these words, per task.
ENTRIES, WORDS, WORD_BYTES = 300_000, 150_000, 16 << 20
# Slots of a task's vocabulary: 2 ** SLOT_BITS, 12 bytes each.
SLOT_BITS = 19
# Occurrences sorted at once before they reach the trie.
BUFFER = 600_000
# A bitmap has at least BITS_PER_ROW bits for each sequence, at most MAX_BITS: 16 MB.
BITS_PER_ROW, MAX_BITS, SEGMENT_BITS = 16, 1 << 27, 1 << 15
_LOWER = np.frombuffer(LOWER, np.uint8)
_STOPS = byte_class(lambda b: b in b".,;:!?\n\x0b\x0c\r")
_INSIDE = ~(_STOPS | byte_class(lambda b: b in b" \t"))
_BASE = np.uint64(0x9E3779B97F4A7C15)
# Text for each prefix partition, and how many partitions there may be.
PART_BYTES, PARTS = 4 << 20, 1 << 16
_RUN = "part int, lang string, run binary"
_COUNTED = "lang string, phrase string, n int, hash bigint, times bigint"


@dataclass
class Bits:
    """Hashes that may have reached the count."""

    data: np.ndarray
    mask: int

    def of(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(self.mask)
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _word_key(words: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return mix(words * _BASE + lang)


def _pair_key(first: np.ndarray, second: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return mix((first * _BASE + second) * _BASE + lang)


class Words:
    """The words of a task, numbered from 1 as they come.

    A word's hash says in which slot its number may be; the bytes of every occurrence are compared with those of the word it
    is taken for, so that numbers stand for words whatever their hashes. Slots are never dealt anew: a word whose slot is
    taken is looked up by its bytes, once a call.
    """

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.count, self.held = 1, 0
        self.text = np.empty(1 << 16, np.uint8)
        # Where a word begins in the text, how long it is and its hash, by number.
        self.begins, self.lengths = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.hashes = np.zeros(1 << 12, np.uint64)
        self.slot_hash, self.slot_id = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int32)

    def ids(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, given by its place among the bytes and its hash; new words get one."""
        slots = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        found = np.where(self.slot_hash[slots] == hashes, self.slot_id[slots], 0).astype(np.int64)
        other = np.flatnonzero(found == 0)
        if len(other):
            distinct, index, inverse = np.unique(hashes[other], return_index=True, return_inverse=True)
            index = other[index]
            numbers = self._by_bytes(low, starts[index], ends[index], distinct)
            found[other] = numbers[inverse]
            free = self.slot_id[slots[index]] == 0
            # Sorted by hash, so that those of one slot stand together: the first gets it.
            at, first = np.unique(slots[index][free], return_index=True)
            self.slot_hash[at], self.slot_id[at] = distinct[free][first], numbers[free][first]
        wrong = self._unlike(low, starts, ends, found)
        found[wrong] = self._by_bytes(low, starts[wrong], ends[wrong], hashes[wrong])
        return found

    def _by_bytes(self, low, starts, ends, hashes) -> np.ndarray:
        raw, found, new = low.tobytes() if len(starts) else b"", np.empty(len(starts), np.int64), []
        count = self.count
        for k, (begin, end) in enumerate(zip(starts.tolist(), ends.tolist())):
            word = raw[begin:end]
            at = self.known.get(word)
            if at is None:
                at = self.known[word] = count
                count += 1
                new.append(k)
            found[k] = at
        if new:
            self._append([raw[starts[k] : ends[k]] for k in new], hashes[new])
        return found

    def _append(self, words: list[bytes], hashes: np.ndarray) -> None:
        low, high = self.count, self.count + len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        stops = self.held + np.cumsum(lengths)
        self.begins, self.lengths, self.hashes = (_grown(a, high) for a in (self.begins, self.lengths, self.hashes))
        self.text = _grown(self.text, int(stops[-1]))
        self.begins[low:high], self.lengths[low:high], self.hashes[low:high] = stops - lengths, lengths, hashes
        self.text[self.held : stops[-1]] = np.frombuffer(b"".join(words), np.uint8)
        self.count, self.held = high, int(stops[-1])

    def _unlike(self, low, starts, ends, numbers) -> np.ndarray:
        """Which words have other bytes than those their numbers stand for."""
        lengths = ends - starts
        wrong = self.lengths[numbers] != lengths
        lengths = np.where(wrong, 0, lengths)
        stops = np.cumsum(lengths)
        at = np.arange(stops[-1] if len(stops) else 0)
        own = low[np.repeat(starts - stops + lengths, lengths) + at]
        unlike = own != self.text[np.repeat(self.begins[numbers] - stops + lengths, lengths) + at]
        wrong[np.searchsorted(stops, np.flatnonzero(unlike), side="right")] = True
        return np.flatnonzero(wrong)

    def take(self, numbers: np.ndarray) -> pa.Array:
        """The words of these numbers."""
        ends = np.append(self.begins[: self.count], self.held)
        ends[0] = 0
        words = pa.Array.from_buffers(pa.large_binary(), self.count, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(self.text[: self.held].tobytes())])
        return words.take(pa.array(numbers)).cast(pa.binary())


def _grown(values: np.ndarray, size: int) -> np.ndarray:
    """The same values with room for ``size`` at least."""
    if size <= len(values):
        return values
    made = np.zeros(max(size, 2 * len(values)), values.dtype)
    made[: len(values)] = values
    return made


class _Counter:
    """Sequences of ``low`` to ``high`` words of a task's texts; single words are counted at the trie's first level."""

    def __init__(self, low: int, high: int, words: Bits | None, pairs: Bits | None, parts: int = 1):
        self.parts = parts
        self.low, self.high, self.known_words, self.known_pairs = low, high, words, pairs
        self.lang_ids: dict[str, int] = {}
        self.lang_names: list[str] = []
        self.lang_hashes: list[int] = []
        self._begin()

    def _begin(self) -> None:
        self.words = Words()
        self.trie = HatTrie(ENTRIES)
        self.buffer: list[tuple[np.ndarray, np.ndarray]] = []
        self.buffered = 0
        self.alone: list[np.ndarray] = []

    def langs(self, column: pa.Array) -> np.ndarray:
        names = pc.fill_null(column, "und").dictionary_encode()
        for name in names.dictionary.to_pylist():
            if name not in self.lang_ids:
                self.lang_ids[name] = len(self.lang_names)
                self.lang_names.append(name)
                self.lang_hashes.append(xxhash.xxh3_64_intdigest(name.encode()))
        known = np.array([self.lang_ids[name] for name in names.dictionary.to_pylist()], np.int64)
        return known[names.indices.to_numpy()]

    def add(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray, own: int) -> Iterator[pa.RecordBatch]:
        """Texts of one language each; sequences count where their first word begins before ``own``."""
        low = _LOWER[data]
        starts, ends, first = word_bounds(_INSIDE[low], offsets)
        if not len(starts):
            return
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        lang = lang[text]
        lang_hash = np.array(self.lang_hashes, np.uint64)[lang]
        hashes = safe_hashes(low, *prefix_hashes(low), starts, ends)
        wanted = np.ones(len(starts), bool) if self.known_words is None else self.known_words.of(_word_key(hashes, lang_hash))
        ids = np.zeros(len(starts), np.int64)
        ids[wanted] = self.words.ids(low, starts[wanted], ends[wanted], hashes[wanted])
        mine = starts < own
        if self.low == 1:
            self._count_words(ids[mine], lang[mine])
        else:
            stops = np.concatenate([[0], np.cumsum(_STOPS[low])])
            joined = (text[1:] == text[:-1]) & (stops[starts[1:]] == stops[ends[:-1]]) & (ids[1:] > 0) & (ids[:-1] > 0)
            if self.known_pairs is not None:
                joined[joined] = self.known_pairs.of(_pair_key(hashes[:-1][joined], hashes[1:][joined], lang_hash[1:][joined]))
            yield from self._count_sequences(ids, lang, joined, mine)
        if self.words.count > WORDS or self.words.held > WORD_BYTES:
            yield from self.leave()

    def _count_words(self, ids: np.ndarray, lang: np.ndarray) -> None:
        for code in np.unique(lang).tolist():
            while len(self.alone) <= code:
                self.alone.append(np.zeros(0, np.int64))
            counts = np.bincount(ids[lang == code], minlength=len(self.alone[code]))
            counts[: len(self.alone[code])] += self.alone[code]
            self.alone[code] = counts

    def _count_sequences(self, ids, lang, joined, mine) -> Iterator[pa.RecordBatch]:
        run = joined
        for n in range(2, self.high + 1):
            if n > 2:
                run = run[:-1] & joined[n - 2 :]
            if n < self.low:
                continue
            at = np.flatnonzero(run & mine[: len(run)])
            first = (lang[at] << ID_BITS) | ids[at]
            self.buffer.append((first, pack(np.stack([ids[at + k] for k in range(1, n)], axis=1)) if len(at) else first))
            self.buffered += len(at)
        if self.buffered >= BUFFER:
            yield from self._flush()

    def _flush(self) -> Iterator[pa.RecordBatch]:
        """Buffered occurrences, counted where they are equal, to the trie."""
        if not self.buffered:
            return
        first, rest = (np.concatenate(c) for c in zip(*self.buffer))
        self.buffer, self.buffered = [], 0
        if self.high == 2 and int(first.max()) < 1 << 2 * ID_BITS:
            # A language and two words fit one number.
            pair, counts = np.unique((first << ID_BITS) | (rest >> 2 * ID_BITS), return_counts=True)
            first, rest = pair >> ID_BITS, (pair & ((1 << ID_BITS) - 1)) << 2 * ID_BITS
        else:
            order = np.lexsort((rest, first))
            first, rest = first[order], rest[order]
            change = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])))
            counts = np.diff(np.append(change, len(first)))
            first, rest = first[change], rest[change]
        yield from map(self._packed, self.trie.add(first, rest, counts))

    def _packed(self, run) -> pa.RecordBatch:
        """A run of the trie cut by partition."""
        first, keys, counts = run
        return self._record(first >> ID_BITS, [first & ((1 << ID_BITS) - 1), *unpack(keys)], counts)

    def _record(self, lang: np.ndarray, parts: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
        hashes, lang_hash = self.words.hashes, np.array(self.lang_hashes, np.uint64)[lang]
        second = hashes[parts[1]] if len(parts) > 1 else np.uint64(0)
        part = (_pair_key(hashes[parts[0]], second, lang_hash) % np.uint64(self.parts)).astype(np.int64)
        # By partition and language; inside, as the trie had it.
        place = part * len(self.lang_names) + lang
        order = np.argsort(place, kind="stable")
        place, counts, parts = place[order], counts[order], [p[order] for p in parts]
        used, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        words = self.words.take(used)
        columns = [words.take(pa.array(i, mask=p == 0)) for i, p in zip(np.split(inverse, len(parts)), parts)]
        phrases = pc.binary_join_element_wise(*columns, b" ", null_handling="skip")
        cuts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        ends = np.append(cuts[1:], len(place))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(place[cuts] // len(self.lang_names), pa.int32()),
                pa.array(self.lang_names).take(pa.array(place[cuts] % len(self.lang_names))),
                pa.array([pack_run(phrases.slice(a, b - a), counts[a:b]) for a, b in zip(cuts.tolist(), ends.tolist())], pa.binary()),
            ],
            ["part", "lang", "run"],
        )

    def leave(self) -> Iterator[pa.RecordBatch]:
        """All that is counted, and begin anew."""
        yield from self._flush()
        if self.trie.entries:
            yield self._packed(self.trie.leave_all())
        for code, counts in enumerate(self.alone):
            at = np.flatnonzero(counts)
            if len(at):
                yield self._record(np.full(len(at), code), [at], counts[at])
        self._begin()


def pack_run(phrases: pa.Array, counts: np.ndarray) -> bytes:
    """Phrases and counts, compressed: their number, the lengths, the counts, the bytes."""
    data, offsets = flat(phrases)
    raw = b"".join([np.int64(len(counts)).tobytes(), np.diff(offsets).astype(np.uint32).tobytes(), counts.astype(np.int64).tobytes(), data.tobytes()])
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack_run(run: bytes) -> tuple[pa.Array, np.ndarray]:
    raw = pa.Codec("zstd").decompress(run[8:], int.from_bytes(run[:8], "little"), asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(np.frombuffer(raw, np.uint32, n, 8), out=offsets[1:])
    counts = np.frombuffer(raw, np.int64, n, 8 + 4 * n) if n % 2 == 0 else np.frombuffer(raw[8 + 4 * n : 8 + 12 * n], np.int64)
    data = pa.py_buffer(raw[8 + 12 * n :])
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets.tobytes()), data]), counts


def _phrase_keys(phrases: pa.Array, lang: str) -> tuple[np.ndarray, np.ndarray]:
    """How many words each phrase has, and the hash by which a bitmap knows words and pairs."""
    data, offsets = flat(phrases)
    starts, ends, first = word_bounds(data != ord(" "), offsets)
    hashes = safe_hashes(data, *prefix_hashes(data), starts, ends)
    n, at = np.diff(first), first[:-1]
    of = np.full(len(n), xxhash.xxh3_64_intdigest(lang.encode()), np.uint64)
    second = np.minimum(at + 1, max(len(hashes) - 1, 0))
    return n, np.where(n == 1, _word_key(hashes[at], of), _pair_key(hashes[at], hashes[second], of))


def windows(data: np.ndarray, limit: int) -> Iterator[tuple[int, int, int]]:
    """``(begin, end, own)`` of stretches of a long text: words that begin before ``own`` are the stretch's, three more follow."""
    begin, n = 0, len(data)

    def word_end(at: int, words: int) -> int:
        """Behind the word at ``at`` and so many more."""
        step = 4096
        while True:
            stop = min(n, at + step)
            ends = np.flatnonzero(_INSIDE[data[at : stop - 1]] & ~_INSIDE[data[at + 1 : stop]]) + at + 1
            if len(ends) > words:
                return int(ends[words])
            if stop == n:
                return n
            step *= 4

    while n - begin > limit:
        own = word_end(begin + limit - 1, 0)
        yield begin, word_end(own, LONGEST - 1) if own < n else n, own
        begin = own
    if begin < n:
        yield begin, n, n


def _counts(docs: DataFrame, low: int, high: int, words: Bits | None, pairs: Bits | None, parts: int, min_count: int) -> DataFrame:
    """``lang, phrase, n, hash, times`` of sequences of ``low`` to ``high`` words that stand ``min_count`` times.

    Each partition adds a row per language without a phrase: the sum of all its counts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = [None if b is None else (spark.sparkContext.broadcast(b.data.tobytes()), b.mask) for b in (words, pairs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = [None if b is None else Bits(np.frombuffer(b[0].value, np.uint8), b[1]) for b in known]
        counter = _Counter(low, high, *opened, parts)
        for batch in batches:
            for piece in pieces(batch):
                lang = counter.langs(piece.column(1))
                data, offsets = flat(piece.column(0))
                if len(data) <= 2 * PIECE_BYTES:
                    yield from counter.add(data, offsets, lang, len(data))
                    continue
                for begin, end, own in windows(data, PIECE_BYTES):
                    yield from counter.add(data[begin:end], np.array([0, end - begin]), lang, own - begin)
            pa.default_memory_pool().release_unused()
        yield from counter.leave()
        del counter
        give_back()

    def merge(table: pa.Table) -> pa.Table:
        made = merge_runs(table, min_count)
        give_back()
        return made

    return materialize(docs.mapInArrow(run, _RUN).groupBy("part").applyInArrow(merge, _COUNTED), f"counts-{low}")


def merge_runs(table: pa.Table, min_count: int) -> pa.Table:
    """The runs of a partition added up, those of a language one after the other."""
    made, langs = [], table["lang"].combine_chunks()
    for lang in pc.unique(langs).to_pylist():
        held, rows, size = [], 0, 0

        def added():
            whole = pa.table({"phrase": pa.chunked_array([p for p, _ in held]), "times": pa.chunked_array([t for _, t in held])})
            whole = whole.group_by("phrase", use_threads=False).aggregate([("times", "sum")])
            return whole["phrase"].combine_chunks(), whole["times_sum"].combine_chunks()

        for run in table["run"].filter(pc.equal(langs, lang)):
            phrases, counts = unpack_run(run.as_py())
            held.append((phrases, pa.array(counts)))
            rows += len(counts)
            # Added up whenever the rows have doubled, so that no more than twice the different ones are held.
            if rows > max(200_000, 2 * size):
                held = [added()]
                rows = size = len(held[0][0])
        phrases, times = added()
        total = pc.sum(times)
        often = pc.greater_equal(times, min_count)
        phrases, times = phrases.filter(often), times.filter(often)
        n, keys = _phrase_keys(phrases, lang)
        made.append(
            pa.table(
                {
                    "lang": pa.array([lang] * (len(times) + 1)),
                    "phrase": pa.concat_arrays([phrases.cast(pa.string()), pa.nulls(1, pa.string())]),
                    "n": pa.array(np.append(n, 0), pa.int32()),
                    "hash": pa.array(np.append(keys, np.uint64(0)).view(np.int64)),
                    "times": pa.concat_arrays([times, pa.array([total.as_py()], pa.int64())]),
                }
            )
        )
    return pa.concat_tables(made)


def _bits(frequent: DataFrame) -> Bits:
    """The bitmap of the hashes of a table, whose size is bounded."""
    rows = max(frequent.count(), 1)
    bits = max(SEGMENT_BITS, min(MAX_BITS, 1 << (BITS_PER_ROW * rows - 1).bit_length()))
    at = F.col("hash").bitwiseAND(F.lit(bits - 1))
    segments = frequent.groupBy((at / SEGMENT_BITS).cast("int").alias("segment")).agg(
        F.expr(f"bitmap_construct_agg(hash & {SEGMENT_BITS - 1})").alias("bitmap")
    )
    data = np.zeros(bits // 8, np.uint8)
    for row in segments.toLocalIterator():
        begin = row["segment"] * (SEGMENT_BITS // 8)
        data[begin : begin + SEGMENT_BITS // 8] = np.frombuffer(row["bitmap"], np.uint8)
    return Bits(data, bits - 1)


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, n, times`` of all sequences of up to four words that stand ``min_count`` times, and ``lang, total``."""
    source = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    size = source.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    parts = int(max(1, min(PARTS, size // PART_BYTES)))
    words = _counts(source, 1, 1, None, None, parts, min_count)
    totals = materialize(words.where("phrase is null").groupBy("lang").agg(F.sum("times").alias("total")), "totals")
    often = [words.where("phrase is not null")]
    known = _bits(often[0])
    often.append(_counts(source, 2, 2, known, None, parts, min_count).where("phrase is not null"))
    often.append(_counts(source, 3, LONGEST, known, _bits(often[1]), parts, min_count).where("phrase is not null"))
    return materialize(often[0].unionByName(often[1]).unionByName(often[2]).drop("hash"), "phrase-counts"), totals


def _part(words: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def _wide(value: Column) -> Column:
    return value.cast("decimal(38,0)")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, cover: int = COVER, top: int = TOP
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``top`` phrases."""
    counted, totals = phrase_counts(docs, text, lang, min_count)
    candidates = counted.where("n > 1").select("lang", "phrase", "n", F.col("times").alias("a"))
    words = F.split("phrase", " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1))).select(
        "lang", "phrase", "a", "k",
        _part(words, F.lit(1), F.col("k")).alias("left"), _part(words, F.col("k") + 1, F.col("n") - F.col("k")).alias("right"),
    )
    sides = sized_broadcast(counted.select("lang", "phrase", "times"), "sides")
    left = sides.select("lang", F.col("phrase").alias("left"), F.col("times").alias("l"))
    right = sides.select("lang", F.col("phrase").alias("right"), F.col("times").alias("r"))
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    scored = scored.withColumn("score", F.expr("(cast(a as decimal(31,0)) * 2000000BD) div (cast(l as decimal(38,0)) + r)"))
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # A longer phrase and each shorter run of words in it.
    places = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("n") - 1),
            lambda m: F.transform(F.sequence(F.lit(1), F.col("n") - m + 1), lambda s: _part(words, s, m)),
        )
    )
    longer = candidates.where("n > 2").select("lang", F.explode(places).alias("phrase"), F.col("a").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    met = best.join(longer, ["lang", "phrase"], "left")
    covered = _wide(F.col("longer")) * 100 >= _wide(F.col("a")) * cover
    kept = met.where(F.col("longer").isNull() | ~covered)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    named = ranked.join(sized_broadcast(totals, "language-totals"), "lang")
    return named.select("lang", F.col("rank").cast("bigint"), "phrase", "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("bigint"))
