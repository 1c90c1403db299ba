"""Language of a text by cross-parsing against suffix automata of labelled text.

Each language has a suffix automaton over a bounded sample of its labelled text. A text is parsed greedily: the longest
match in the language's sample is a phrase, then parsing begins anew. Few phrases mean long matches; with the number of
phrases times log2 of the sample's size, per byte of text, the language that needs fewest wins (ties: the first name).

Automata become dense tables with the restart built in, so that many stretches of text walk all at once, one byte per
step. A text is cut into stretches of STRETCH bytes; a phrase never crosses into the next one.

Defined cases: a null text and a text without letters are ``und`` with score 0; without any labelled text every text is
``und``; text is lower-cased, and what is no letter is one space; rows repeat as they come; an empty table gives an empty
result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.text import map_arrow, record, texts
from logweave.session import materialize

# Bytes of labelled text per language and of all languages together; bytes of a slice of one document.
SAMPLE_BYTES, TOTAL_BYTES, SLICE = 32_768, 262_144, 2_000
STRETCH = 512
UNKNOWN = "und"
_BUCKETS = 1 << 30
_LETTER = re.compile(rb"[A-Za-z]")
# ASCII letters as they are, other ASCII as a space, bytes of other characters as they are.
_PLAIN = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def normal(text: bytes) -> bytes:
    """Lower-cased text in which each run of ASCII that is no letter is one space."""
    lowered = text if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    return b" ".join(lowered.translate(_PLAIN).split())


def has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or (
        not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace"))
    )


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the start. Every substring of ``data`` is a path from it."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for byte in data:
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and byte not in moves[p]:
            moves[p][byte] = state
            p = link[p]
        if p >= 0:
            q = moves[p][byte]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(byte) == q:
                    moves[p][byte] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
    return moves


class Parser:
    """The automata of all languages; only the sample texts are sent to executors, tables are built where they are used."""

    def __init__(self, samples: dict[str, bytes]):
        self.samples = {k: samples[k] for k in sorted(samples) if samples[k]}
        self._tables = None

    def __getstate__(self):
        return {**self.__dict__, "_tables": None}

    def _open(self) -> None:
        """Dense tables: classes of bytes (0: no sample has it), then a last class for padding.

        States are stored times the number of classes. A missing transition holds the complement of the state that
        follows the restart, so its sign is the end of a phrase.
        """
        if self._tables is not None:
            return
        seen = sorted(set().union(*self.samples.values()))
        self._class = np.zeros(256, np.uint8)
        self._class[seen] = np.arange(1, len(seen) + 1)
        self._width = width = len(seen) + 2
        self._tables = []
        for data in self.samples.values():
            moves = suffix_automaton(data)
            table = np.full((len(moves), width), -1, np.int32)
            size = sum(map(len, moves))
            state = np.fromiter((s for s, m in enumerate(moves) for _ in m), np.int64, size)
            byte = np.fromiter((b for m in moves for b in m), np.int64, size)
            after = np.fromiter((t for m in moves for t in m.values()), np.int64, size)
            restart = np.zeros(width, np.int32)
            root = state == 0
            restart[self._class[byte[root]]] = after[root] * width
            table[:] = ~restart
            table[state, self._class[byte]] = after * width
            table[:, -1] = np.arange(len(moves)) * width
            self._tables.append(table.ravel())

    def phrases(self, batch: list[bytes]) -> np.ndarray:
        """Phrases of each normalised text (rows) in each language (columns)."""
        self._open()
        sizes = np.array([len(t) for t in batch], np.int64)
        parts = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(batch)), parts)
        lanes = int(parts.sum())
        cells = np.full((lanes, STRETCH), self._width - 1, np.uint8)
        first = np.cumsum(parts) - parts
        data = self._class[np.frombuffer(b"".join(batch), np.uint8)]
        offset = np.cumsum(sizes) - sizes
        at = np.arange(len(data)) + np.repeat(first * STRETCH - offset, sizes)
        cells.ravel()[at] = data
        # Full stretches first, so that the walk narrows to the lanes that still have text.
        length = np.full(lanes, STRETCH)
        some = parts > 0
        length[(first + parts - 1)[some]] = (sizes - (parts - 1) * STRETCH)[some]
        order = np.argsort(-length, kind="stable")
        steps = np.ascontiguousarray(cells[order].T)
        open_lanes = lanes - np.searchsorted(np.sort(length), np.arange(STRETCH), side="right")
        result = np.zeros((len(batch), len(self._tables)))
        for number, table in enumerate(self._tables):
            state, breaks = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
            for step, count in zip(steps, open_lanes.tolist()):
                if not count:
                    break
                found = table[state[:count] + step[:count]]
                ended = found >> 31
                np.bitwise_xor(found, ended, out=state[:count])
                breaks[:count] -= ended
            result[:, number] = np.bincount(owner[order], breaks + 1, len(batch))
        return result

    def predict(self, batch: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; the score is the runner-up's share of the two least normalised counts."""
        names = list(self.samples)
        known = np.array([bool(names) and has_letter(t) for t in batch], bool)
        if not known.any():
            return [UNKNOWN] * len(batch), np.zeros(len(batch))
        plain = [normal(t) if k else b"" for t, k in zip(batch, known)]
        weight = np.log2([len(s) + 1 for s in self.samples.values()])
        size = np.maximum([len(t) for t in plain], 1)[:, None]
        cost = self.phrases(plain) * weight / size
        best = cost.argmin(axis=1)
        two = np.sort(cost, axis=1)[:, :2]
        total = np.maximum(two.sum(axis=1), 1e-12)
        score = two[:, 1] / total if two.shape[1] > 1 else np.ones(len(batch))
        return [names[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, score, 0.0)


def train(docs: DataFrame, held_out: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Parser:
    """Samples of SAMPLE_BYTES per language at most, from slices of documents chosen by a hash of their ids."""
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out)
    usable = usable.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key).alias("hash"))
    length = F.least(F.length("text"), F.lit(SLICE))
    totals = materialize(usable.groupBy("lang").agg(F.sum(length).alias("total")), "languages")
    languages = max(1, totals.count())
    each = max(1, min(SAMPLE_BYTES, TOTAL_BYTES // languages))
    shares = totals.select("lang", (F.least(F.lit(1.0), 4.0 * each / F.col("total")) * _BUCKETS).alias("share"))
    # One short row per language; more languages than sample bytes would be joined by a shuffle.
    shares = shares.hint("broadcast") if languages <= TOTAL_BYTES else shares
    taken = usable.join(shares, "lang").where(F.pmod("hash", F.lit(_BUCKETS)) < F.col("share"))
    start = 1 + F.pmod("hash", F.greatest(F.lit(1), F.length("text") - SLICE))
    rows = taken.select("lang", "hash", F.substring("text", start, F.lit(SLICE)).alias("text")).distinct().collect()
    parts: dict[str, list[bytes]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["hash"], r["text"])):
        parts.setdefault(row["lang"], []).append(normal(row["text"].encode()))
    return Parser({name: b" ".join(found)[:each] for name, found in parts.items()})


def predict(docs: DataFrame, parser: Parser, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, lang_pred, score`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = shared.value.predict(texts(batch.column(1)))
        return record(key=batch.column(0), lang_pred=pa.array(names, pa.string()), score=scores)

    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {dict(docs.dtypes)[key]}, lang_pred string, score double"
    return map_arrow(source, run, schema).withColumnRenamed("key", key)
