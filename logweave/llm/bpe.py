"""Byte-level BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A pre-token is a row of byte tokens. The leaves of a segment tree hold ``(rank, place)`` of each adjacent pair, inner
nodes the smaller child, so the root is the leftmost pair of lowest rank. A merge changes the leaf of the pair, of its
left neighbour and of the token that went, each with one walk to the root, until no pair can merge.

Short pre-tokens of a batch are encoded together: trees of equal size are rows of one array and all merge in step. Long
ones have a tree of their own. Each distinct pre-token is encoded once while a bounded memory holds it.

Defined cases: a null text is empty and has no tokens; the strings of special tokens in a text become their ids, as the
library does by default; ids outside the vocabulary decode to nothing; bytes that are no UTF-8 decode to U+FFFD. Rows
repeat as they come, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from logweave.llm.text import map_arrow, record, texts

PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# A space before white space or the end of the text: there a pre-token can begin elsewhere than at a space.
OPEN_SPACE = re.compile(r" (?:\s|\Z)")
NONE = 1 << 30
# Pre-tokens of at most so many bytes share trees; longer ones have their own.
SHARED_LEAVES = 64
# Bytes of text encoded at once; large, so that many new pre-tokens merge in step.
PIECE = 1 << 20
# Pre-tokens, and chunks between spaces, held in memory per Python worker.
MEMORY = 250_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {b: chr(b) for b in plain}
    for number, b in enumerate(b for b in range(256) if b not in shown):
        shown[b] = chr(256 + number)
    return [shown[b] for b in range(256)]


def load_tokenizer(path: str) -> "ByteBpe":
    """Read a byte-level BPE tokenizer file (JSON)."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocabulary = spec["model"]["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return ByteBpe(vocabulary, merges, special)


class ByteBpe:
    """Tables of a vocabulary; small enough to be sent to every executor."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        characters = byte_characters()
        back = {c: b for b, c in enumerate(characters)}
        self.byte_ids = np.array([vocabulary[c] for c in characters], np.int64)
        size = max([*vocabulary.values(), *special.values()]) + 1
        self.size = size
        left = np.array([vocabulary[a] for a, _ in merges], np.int64)
        right = np.array([vocabulary[b] for _, b in merges], np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        keys = left * size + right
        # A pair that is listed twice has the rank of its last place, as in a map filled in order.
        order = np.lexsort((np.arange(len(keys)), keys))
        last = np.append(keys[order][1:] != keys[order][:-1], True) if len(keys) else np.zeros(0, bool)
        self.pair_keys, self.pair_ranks = keys[order][last], order[last].astype(np.int64)
        if len(merges) << SHARED_LEAVES.bit_length() >= NONE:
            raise ValueError("too many merges for the packed ranks")
        self.ranks = dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist()))
        self.special = special
        self.strings = [b""] * size
        for token, number in vocabulary.items():
            if all(c in back for c in token):
                self.strings[number] = bytes(back[c] for c in token)
            else:
                self.strings[number] = token.encode()
        for token, number in special.items():
            self.strings[number] = token.encode()
        self._held: dict[str, bytes] = {}  # ids of pre-tokens
        self._chunks: dict[str, bytes] = {}  # ids of what stands between two spaces, behind a space
        self._find = None

    def __getstate__(self):
        return {**self.__dict__, "_held": {}, "_chunks": {}, "_find": None, "_special": None}

    # --- ranks ---------------------------------------------------------------------------------------------------

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    # --- one long pre-token ----------------------------------------------------------------------------------------

    def merge_one(self, data: bytes) -> list[int]:
        """Token ids of one pre-token by a segment tree of its own."""
        tokens = self.byte_ids[np.frombuffer(data, np.uint8)].tolist()
        n = len(tokens)
        if n < 2:
            return tokens
        leaves = 1 << (n - 1).bit_length()
        none, ranks, size, merged = (NONE, 0), self.ranks, self.size, self.merged.tolist()
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            rank = ranks.get(tokens[i] * size + tokens[i + 1])
            if rank is not None:
                tree[leaves + i] = (rank, i)
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(place: int, value: tuple[int, int]) -> None:
            node = leaves + place
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    return
                tree[node] = least

        def pair(i: int, j: int) -> tuple[int, int]:
            rank = ranks.get(tokens[i] * size + tokens[j])
            return none if rank is None else (rank, i)

        while tree[1] != none:
            rank, i = tree[1]
            gone = after[i]
            tokens[i], tokens[gone] = merged[rank], -1
            after[i] = j = after[gone]
            put(gone, none)
            if j < n:
                before[j] = i
            put(i, pair(i, j) if j < n else none)
            if before[i] >= 0:
                put(before[i], pair(before[i], i))
        return [t for t in tokens if t >= 0]

    # --- many short pre-tokens -------------------------------------------------------------------------------------

    def merge_many(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, leaves: int):
        """Ids of pre-tokens of 2 to ``leaves`` bytes, whose trees merge in step: ``(ids, number per pre-token)``."""
        count = len(starts)
        shift = leaves.bit_length()
        low = (1 << shift) - 1
        places = np.arange(leaves, dtype=np.int32)
        there = places < lengths[:, None]
        tokens = np.full((count, leaves + 1), -1, np.int32)
        tokens[:, :leaves][there] = self.byte_ids[data[(starts[:, None] + places)[there]]]
        tree = np.full((count, 2 * leaves), NONE, np.int32)
        pairs = places[:-1] < lengths[:, None] - 1
        rank = self._rank(tokens[:, : leaves - 1][pairs], tokens[:, 1:leaves][pairs])
        tree[:, leaves : 2 * leaves - 1][pairs] = np.where(
            rank < NONE, rank << shift | np.broadcast_to(places[:-1], pairs.shape)[pairs], NONE
        )
        for node in range(leaves - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        after = np.where(places + 1 < lengths[:, None], places + 1, leaves)
        before = np.broadcast_to(places - 1, (count, leaves)).copy()
        before = np.concatenate([before, np.zeros((count, 1), np.int32)], axis=1)
        tree, tokens, after, before = tree.ravel(), tokens.ravel(), after.ravel(), before.ravel()
        rows = np.arange(count)

        def put(row: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
            base = row * (2 * leaves)
            node = place + leaves
            tree[base + node] = value
            for _ in range(leaves.bit_length() - 1):
                node = node >> 1
                child = base + 2 * node
                tree[base + node] = np.minimum(tree[child], tree[child + 1])

        while True:
            root = tree[rows * (2 * leaves) + 1]
            rows, root = rows[root < NONE], root[root < NONE]
            if not len(rows):
                break
            place = root & low
            base, link = rows * (leaves + 1), rows * leaves
            gone = after[link + place]
            following = after[link + gone]
            tokens[base + place] = new = self.merged[root >> shift]
            tokens[base + gone] = -1
            after[link + place] = following
            before[base + following] = place
            put(rows, gone, NONE)
            rank = np.where(following < leaves, self._rank(new, tokens[base + following]), NONE)
            put(rows, place, np.where(rank < NONE, rank << shift | place, NONE))
            left = before[base + place]
            has = left >= 0
            row, left = rows[has], left[has]
            rank = self._rank(tokens[row * (leaves + 1) + left], new[has])
            put(row, left, np.where(rank < NONE, rank << shift | left, NONE))
        tokens = tokens.reshape(count, leaves + 1)
        alive = tokens >= 0
        return tokens[alive], alive.sum(axis=1)

    def learn(self, words: list[str]) -> None:
        """Encode distinct pre-tokens and hold their ids as bytes."""
        held = self._held
        encoded = [w.encode() for w in words]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(encoded), np.uint8)
        leaves = 1
        while leaves <= SHARED_LEAVES:
            chosen = np.flatnonzero((lengths <= leaves) & (lengths > leaves // 2))
            if len(chosen) and leaves == 1:
                ids, counts = self.byte_ids[data[starts[chosen]]], np.ones(len(chosen), np.int64)
            elif len(chosen):
                ids, counts = self.merge_many(data, starts[chosen], lengths[chosen], leaves)
            if len(chosen):
                flat, ends = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
                low = 0
                for k, high in zip(chosen.tolist(), ends):
                    held[words[k]] = flat[low:high]
                    low = high
            leaves *= 2
        for k in np.flatnonzero(lengths > SHARED_LEAVES).tolist():
            held[words[k]] = np.array(self.merge_one(encoded[k]), "<u4").tobytes()

    # --- texts -----------------------------------------------------------------------------------------------------

    def _open(self) -> None:
        if self._find is None:
            self._find = regex.compile(PATTERN).findall
            self._special = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")

    def _learn_chunks(self, chunks: list[str]) -> None:
        """Ids of chunks as they stand behind a space."""
        split = [self._find(" " + c) for c in chunks]
        held = self._held
        new = [w for w in set().union(*split) if w not in held]
        if new:
            self.learn(new)
        self._chunks.update(zip(chunks, (b"".join([held[w] for w in parts]) for parts in split)))

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A pre-token that holds a space begins with it where something else than white space follows each space. Such
        texts are cut at their spaces, and what lies between two spaces is encoded once; other texts go through the
        pattern whole.
        """
        self._open()
        find, held, chunks = self._find, self._held, self._chunks
        plan, new_chunks, new_words = [], set(), set()
        for text in batch:
            mine, at = [], 0
            for match in self._special.finditer(text) if any(s in text for s in self.special) else ():
                mine += [text[at : match.start()], self.special[match[0]]]
                at = match.end()
            mine.append(text[at:])
            steps = []
            for part in mine:
                if isinstance(part, int):
                    steps.append(part)
                elif OPEN_SPACE.search(part):
                    steps.append((find(part), []))
                    new_words.update(steps[-1][0])
                else:
                    first, *rest = part.split(" ")
                    steps.append((find(first), rest))
                    new_words.update(steps[-1][0])
                    new_chunks.update(rest)
            plan.append(steps)
        if len(held) + len(new_words) > MEMORY or len(chunks) + len(new_chunks) > MEMORY:
            held.clear()
            chunks.clear()
        missing = [c for c in new_chunks if c not in chunks]
        if missing:
            self._learn_chunks(missing)
        missing = [w for w in new_words if w not in held]
        if missing:
            self.learn(missing)
        word, chunk = held.__getitem__, chunks.__getitem__
        return [
            b"".join(
                [
                    step.to_bytes(4, "little")
                    if isinstance(step, int)
                    else b"".join(map(word, step[0])) + b"".join(map(chunk, step[1]))
                    for step in steps
                ]
            )
            for steps in plan
        ]

    def decode(self, ids: bytes | np.ndarray | list[int]) -> str:
        """The text of ids; invalid UTF-8 becomes U+FFFD."""
        numbers = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else np.asarray(ids, np.int64)
        numbers = numbers[numbers < self.size]
        return b"".join(map(self.strings.__getitem__, numbers.tolist())).decode("utf-8", "replace")


def _strings(column: pa.Array) -> list[str]:
    return [t.decode("utf-8", "replace") for t in texts(column)]


def _id_lists(encoded: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *[len(m) // 4 for m in encoded]]).astype(np.int32)
    values = np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def encode_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, ids``: the ids of every whole text, as an array."""
    shared = docs.sparkSession.sparkContext.broadcast(load_tokenizer(path))
    kind = dict(docs.dtypes)[key]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return record(key=batch.column(0), ids=_id_lists(shared.value.encode(_strings(batch.column(1)))))

    return map_arrow(docs.selectExpr(f"`{key}` as key", f"`{text}` as text"), run, f"key {kind}, ids array<int>", PIECE).withColumnRenamed("key", key)


def decode_documents(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """``key, text`` from ``key, ids``; a null list is an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_tokenizer(path))
    kind = dict(encoded.dtypes)[key]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = [[] if x is None else x for x in batch.column(1).to_pylist()]
        return record(key=batch.column(0), text=pa.array([shared.value.decode(x) for x in lists], pa.string()))

    return map_arrow(encoded.selectExpr(f"`{key}` as key", "ids"), run, f"key {kind}, text string").withColumnRenamed("key", key)


def round_trip_digests(
    docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", keep_ids: bool = False
) -> DataFrame:
    """Encode and decode every whole text: ``key, n_tokens, ids_sha256, decoded_sha256`` and, if wanted, ``ids``."""
    shared = docs.sparkSession.sparkContext.broadcast(load_tokenizer(path))
    kind = dict(docs.dtypes)[key]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = shared.value
        made = coder.encode(_strings(batch.column(1)))
        columns = {
            "key": batch.column(0),
            "n_tokens": pa.array([len(m) // 4 for m in made], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in made], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(coder.decode(m).encode()).hexdigest() for m in made], pa.string()),
        }
        return record(**columns, **({"ids": _id_lists(made)} if keep_ids else {}))

    schema = f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    source = docs.selectExpr(f"`{key}` as key", f"`{text}` as text")
    return map_arrow(source, run, schema, PIECE).withColumnRenamed("key", key)
