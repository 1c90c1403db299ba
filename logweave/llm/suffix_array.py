"""Suffix arrays of byte strings in numpy: Larsson-Sadakane refinement and Kasai's common prefixes."""

from __future__ import annotations

import numpy as np

_FIRST = 5
_BITS = 21


def _sorted_pairs(high: np.ndarray, low: np.ndarray, index: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by (high, low): a sort of packed integers where they fit, else of the pair's code. Returns index and code."""
    if n <= 1 << _BITS:
        packed = np.sort(high << (2 * _BITS) | low << _BITS | index)
        return packed & ((1 << _BITS) - 1), packed >> _BITS
    code = high << 32 | low
    order = np.argsort(code, kind="stable")
    return index[order], code[order]


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order (a suffix that ends is less).

    Ranks are places of a group's first member. Suffixes equal in their first ``h`` bytes form a group; each round orders
    only groups of several members, by the rank ``h`` bytes on, and doubles ``h``.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate([data.astype(np.int64) + 1, np.zeros(_FIRST, np.int64)])
    first = np.zeros(n, np.int64)
    for k in range(_FIRST):
        first = first * 257 + padded[k : k + n]
    if n <= 1 << _BITS:
        packed = np.sort(first << _BITS | np.arange(n))  # 257 ** 5 needs 41 bits
        order, code = packed & ((1 << _BITS) - 1), packed >> _BITS
    else:
        order = np.argsort(first, kind="stable")
        code = first[order]
    head = np.append(True, code[1:] != code[:-1])
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    # Rank 0 is kept for the place behind the last byte.
    rank = np.zeros(n + 1, np.int64)
    rank[order] = group + 1
    sa, h = order, _FIRST
    alone = head & np.append(head[1:], True)
    places = np.flatnonzero(~alone)
    while len(places) and h < n:
        index = sa[places]
        old = rank[index]
        second = rank[np.minimum(index + h, n)]
        index, code = _sorted_pairs(old - 1, second, index, n + 1)
        # Groups keep their places, so the ordered members go back to the same places.
        sa[places] = index
        head = np.append(True, code[1:] != code[:-1])
        rank[index] = places[np.maximum.accumulate(np.where(head, np.arange(len(index)), 0))] + 1
        alone = head & np.append(head[1:], True)
        places = places[~alone]
        h *= 2
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in ``sa`` (0 for the first).

    Kasai: in text order the value drops by one at most from a suffix to the next. It drops by exactly one where the bytes
    before a suffix and before its predecessor agree; only the others are compared, eight bytes at a time.
    """
    n = len(data)
    if n < 2:
        return np.zeros(n, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    index = np.arange(n)
    fresh = (index == 0) | (before <= 0)
    fresh[1:] |= data[index[1:] - 1] != data[before[1:] - 1]
    todo = np.flatnonzero(fresh & (before >= 0))
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    word = np.zeros(n + 8, np.uint64)
    for k in range(8):
        word |= padded[k : k + n + 8].astype(np.uint64) << np.uint64(8 * k)
    length = np.zeros(n, np.int64)
    a, b = todo, before[todo]
    at = np.zeros(len(todo), np.int64)
    live = np.arange(len(todo))
    while len(live):
        x, y = a[live] + at[live], b[live] + at[live]
        differs = word[np.minimum(x, n)] ^ word[np.minimum(y, n)]
        same = np.where(differs == 0, 8, 0)
        # The lowest set bit tells the first byte that differs.
        some = differs != 0
        lowest = differs[some] & (~differs[some] + np.uint64(1))
        same[some] = (np.bitwise_count(lowest - np.uint64(1)) // 8).astype(np.int64)
        room = n - np.maximum(x, y)
        same = np.minimum(same, np.maximum(room, 0))
        at[live] += same
        live = live[(same == 8) & (room > 8)]
    length[todo] = at
    value = np.where(fresh, length + index, 0)
    plcp = np.maximum(np.maximum.accumulate(value) - index, 0)
    plcp[before < 0] = 0
    return plcp[sa]
