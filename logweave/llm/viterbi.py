"""Token counts of a unigram vocabulary: Aho-Corasick matches and a Viterbi pass that only counts.

The text is cut into words as the Metaspace pre-tokenizer does: a space becomes U+2581, one is put in front, and each
U+2581 begins a word. All vocabulary matches of a word come from one Aho-Corasick automaton, ordered by their end and, at
equal ends, longest first. That is the order of their starts, so "replace only if strictly better" resolves ties exactly
as the tokenizer does. Each place carries the best score and its number of pieces; no path is kept.

A character without a piece of its own costs the least score of the vocabulary less 10 and counts its UTF-8 bytes
(byte fallback) or, with its unknown neighbours, one unknown piece.

Defined cases: a null or empty text has no tokens, words or score; rows repeat as they come; an empty table gives an empty
result.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from logweave.llm.text import map_arrow, record, texts

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
# Words held in memory per Python worker.
MEMORY = 600_000


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter:
    """Counts pieces of the best segmentation; the vocabulary is small enough to be sent to every executor."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.vocabulary = vocabulary
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        known = {piece for piece, _ in vocabulary}
        self.byte_fallback = all(f"<0x{b:02X}>" in known for b in range(256))
        self._automaton = None
        self._held: dict[str, tuple[int, float]] = {}

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None, "_held": {}}

    def _open(self) -> None:
        if self._automaton is None:
            automaton = ahocorasick.Automaton()
            # A piece that is listed twice has its last score, as in a map filled in order.
            for piece, score in self.vocabulary:
                if piece:
                    automaton.add_word(piece, (len(piece), score))
            automaton.make_automaton()
            self._automaton = automaton

    def word(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best segmentation of one word."""
        self._open()
        scores, counts, open_run = [0.0], [0], [False]
        unknown, fallback = self.unknown, self.byte_fallback
        at, best, pieces, single = -1, None, 0, False

        def close(place: int, best: float | None, pieces: int, single: bool) -> None:
            run = False
            if not single:
                score = unknown + scores[place]
                if best is None or score > best:
                    run, best = True, score
                    if fallback:
                        pieces = counts[place] + len(word[place].encode())
                    else:
                        pieces = counts[place] + (not open_run[place])
            scores.append(best)
            counts.append(pieces)
            open_run.append(run)

        for end, (length, score) in self._automaton.iter(word):
            if end != at:
                if at >= 0:
                    close(at, best, pieces, single)
                for place in range(at + 1, end):
                    close(place, None, 0, False)
                at, best, single = end, None, False
            start = end + 1 - length
            score = score + scores[start]
            if best is None or score > best:
                best, pieces = score, counts[start] + 1
            single = single or length == 1
        if at >= 0:
            close(at, best, pieces, single)
        for place in range(at + 1, len(word)):
            close(place, None, 0, False)
        return counts[-1], scores[-1]

    def text(self, text: str) -> tuple[int, int, float]:
        """Words, pieces and the sum of scores of a text."""
        if not text:
            return 0, 0, 0.0
        words = text.replace(SPACE, " ").split(" ")
        if not words[0]:
            del words[0]  # the text begins with its own mark
        held = self._held
        new = {w for w in words if w not in held}
        if new:
            if len(held) + len(new) > MEMORY:
                held.clear()
                new = set(words)
            for w in new:
                held[w] = self.word(SPACE + w)
        found = [held[w] for w in words]
        return len(words), sum([c for c, _ in found]), sum([s for _, s in found])


def count_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``key, n_words, n_tokens, score``."""
    shared = docs.sparkSession.sparkContext.broadcast(UnigramCounter(load_vocabulary(path)))
    kind = dict(docs.dtypes)[key]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [shared.value.text(t.decode("utf-8", "replace")) for t in texts(batch.column(1))]
        return record(
            key=batch.column(0),
            n_words=pa.array([m[0] for m in made], pa.int64()),
            n_tokens=pa.array([m[1] for m in made], pa.int64()),
            score=pa.array([m[2] for m in made], pa.float64()),
        )

    schema = f"key {kind}, n_words bigint, n_tokens bigint, score double"
    return map_arrow(docs.selectExpr(f"`{key}` as key", f"`{text}` as text"), run, schema).withColumnRenamed("key", key)
