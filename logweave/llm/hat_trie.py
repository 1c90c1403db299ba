"""Counts of word sequences in a HAT-trie: a shallow trie over word ids with hash containers as leaves.

The root has a child per first word. A child begins as one container, a hash table from the packed ids of the other words
to counts. A container of more than BURST entries bursts into one container per second word. When the trie holds more than
``limit`` entries, its largest subtrees leave as sorted runs until half is free, and their counts begin anew; runs of the
same sequence are added up wherever they meet. Word ids are the trie's own and last as long as its words do.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np

# Ids of words: 1 to 2 ** 21 - 1, so that three of them fill a key.
ID_BITS = 21
BURST = 4096
_MASK = (1 << ID_BITS) - 1
#: First words, packed others and counts, sorted.
Run = tuple[np.ndarray, np.ndarray, np.ndarray]


class HatTrie:
    """Counts of sequences of one to four words, given as ids."""

    def __init__(self, limit: int):
        self.limit, self.entries = limit, 0
        # First word -> container, or second word -> container.
        self.root: dict[int, dict] = {}
        self.deep: dict[int, dict[int, dict]] = {}
        self.sizes: dict[int, int] = {}

    def add(self, first: np.ndarray, rest: np.ndarray, counts: np.ndarray) -> Iterator[Run]:
        """Count sequences sorted by ``first``, with ``rest`` the packed ids behind it; yields runs that had to leave."""
        if not len(first):
            return
        cuts = np.append(np.flatnonzero(np.diff(first, prepend=first[0] - 1)), len(first))
        keys, times = rest.tolist(), counts.tolist()
        for word, low, high in zip(first[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
            self._count(word, keys[low:high], times[low:high])
            if self.entries > self.limit:
                yield self._shrink()

    def _count(self, word: int, keys: list[int], times: list[int]) -> None:
        children = self.deep.get(word)
        if children is None:
            container = self.root.setdefault(word, {})
            before = len(container)
            for key, n in zip(keys, times):
                container[key] = container.get(key, 0) + n
            grown = len(container) - before
            if len(container) > BURST:
                self._burst(word)
        else:
            grown = 0
            for key, n in zip(keys, times):
                container = children.setdefault(key >> 2 * ID_BITS, {})
                before = len(container)
                container[key] = container.get(key, 0) + n
                grown += len(container) - before
        self.entries += grown
        self.sizes[word] = self.sizes.get(word, 0) + grown

    def _burst(self, word: int) -> None:
        children = self.deep.setdefault(word, {})
        for key, n in self.root.pop(word).items():
            children.setdefault(key >> 2 * ID_BITS, {})[key] = n

    def _shrink(self) -> Run:
        """The largest subtrees, so many that half of the limit is left."""
        words, left = [], self.entries
        for word in sorted(self.sizes, key=self.sizes.get, reverse=True):
            if left <= self.limit // 2:
                break
            words.append(word)
            left -= self.sizes[word]
        return self._leave(words)

    def _leave(self, words: list[int]) -> Run:
        containers, sizes = [], []
        for word in words:
            children = self.deep.pop(word, None)
            containers += [self.root.pop(word)] if children is None else children.values()
            sizes.append(self.sizes.pop(word))
        n = sum(sizes)
        self.entries -= n
        keys = np.fromiter(chain.from_iterable(containers), np.int64, n)
        counts = np.fromiter(chain.from_iterable(c.values() for c in containers), np.int64, n)
        first = np.repeat(np.array(words, np.int64), sizes)
        order = np.lexsort((keys, first))
        return first[order], keys[order], counts[order]

    def leave_all(self) -> Run:
        return self._leave(list(self.sizes))


def pack(ids: np.ndarray) -> np.ndarray:
    """Rows of up to three ids (0: none) as one key, the first in the highest bits."""
    packed = np.zeros(len(ids), np.int64)
    for k in range(3):
        packed = (packed << ID_BITS) | (ids[:, k] if k < ids.shape[1] else 0)
    return packed


def unpack(keys: np.ndarray) -> list[np.ndarray]:
    return [(keys >> (ID_BITS * (2 - k))) & _MASK for k in range(3)]
