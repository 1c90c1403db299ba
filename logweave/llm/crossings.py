"""Cheapest edit paths of conversations by Hirschberg's divide and conquer over four states, many at once.

A step is a row (or a run of rows) as two 4 x 4 tables: the least cost from a state to a state and a code that orders the
edits of equal cost. The states are what was said so far: nothing, ``system``, ``user`` last, ``assistant`` last.

Forward vectors carry, beside the costs, the order of the four least audits. Edits of a step are inserts and then one
other letter, so no audit over the same rows begins another, and two audits compare like their first difference. Hence the
least audit through a crossing is the least one before it followed by the least one behind it, and the crossing to take is
the one whose front stands first in that order.
"""

from __future__ import annotations

import numpy as np

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 40
KEEP, RETITLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: Kinds of rows: 3 * initial (s, u, a, other) + (0 plain, 1 truncated, 2 to be deleted); then the end of a conversation.
END = 12
_SAYS = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "x": {}}


def spoken(state: int) -> str:
    """The role that an insert or a new title gives after a state."""
    return "a" if state == USER else "u"


def _blocks(kind: int, state: int):
    """All ``(edits, cost, next state)`` of a row of a kind, with up to two inserts before it."""
    if kind == END:
        yield from {NOTHING: [("", 0)], SYSTEM: [("II", 2 * INSERT)], USER: [("I", INSERT)], ASSISTANT: [("", 0)]}[state]
        return
    initial, sort = "suax"[kind // 3], kind % 3
    at, before, cost = state, "", 0
    for _ in range(3):
        yield before + "D", cost + DELETE, at
        if sort < 2:
            cut = CUT if sort == 1 else 0
            if at in _SAYS[initial]:
                yield before + "K", cost + KEEP + cut, _SAYS[initial][at]
            yield before + "R", cost + RETITLE + cut, _SAYS[spoken(at)][at]
        before, cost, at = before + "I", cost + INSERT, _SAYS[spoken(at)][at]


def _tables() -> tuple[np.ndarray, np.ndarray, list[str]]:
    best = {}
    for kind in range(END + 1):
        for state in range(4):
            for edits, cost, *after in _blocks(kind, state):
                key = kind, state, after[0] if after else ASSISTANT
                best[key] = min(best.get(key, (NEVER, "")), (cost, edits))
    names = sorted({edits for _, edits in best.values()})
    cost, code = np.full((END + 1, 4, 4), NEVER, np.int64), np.zeros((END + 1, 4, 4), np.int64)
    for key, (c, edits) in best.items():
        cost[key], code[key] = c, names.index(edits)
    return cost, code, names


COST, CODE, EDITS = _tables()
_CODES = 64


def _forward(cost, code, kinds, low, high, state):
    """Costs and audit order of the four states after the steps ``low`` to ``high`` of each problem, longest first."""
    n = len(low)
    total, order = np.full((n, 4), NEVER, np.int64), np.zeros((n, 4), np.int64)
    total[np.arange(n), state] = 0
    length = high - low
    active = n - np.searchsorted(length[::-1], np.arange(1, length[0] + 1)) if n else []
    for j, m in enumerate(active):
        kind = kinds[low[:m] + j]
        tie = order[:m, :, None] * _CODES + code[kind]
        whole = np.minimum(total[:m, :, None] + cost[kind], NEVER) * (4 * _CODES) + tie
        best = whole.min(axis=1)
        total[:m] = best // (4 * _CODES)
        rest = np.where(total[:m] < NEVER, best % (4 * _CODES), 4 * _CODES)
        order[:m] = (rest[:, None, :] < rest[:, :, None]).sum(axis=2)
        order[:m][total[:m] >= NEVER] = 0
    return total, order


def _backward(cost, kinds, low, high, state):
    """Costs from the four states before the steps ``low`` to ``high`` to ``state`` behind them, longest first."""
    n = len(low)
    total = np.full((n, 4), NEVER, np.int64)
    total[np.arange(n), state] = 0
    length = high - low
    active = n - np.searchsorted(length[::-1], np.arange(1, length[0] + 1)) if n else []
    for j, m in enumerate(active):
        kind = kinds[high[:m] - 1 - j]
        total[:m] = np.minimum((cost[kind] + total[:m, None, :]).min(axis=2), NEVER)
    return total


def transfer(cost, code, kinds, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps ``low`` to ``high`` as one step."""
    starts = np.arange(4)
    return _forward(cost, code, kinds, np.full(4, low), np.full(4, high), starts)


def solve(cost, code, kinds, low, high, start, end) -> np.ndarray:
    """The state after each step on the cheapest, then audit-least, path of each problem ``low`` to ``high``."""
    after = np.full(len(kinds), -1, np.int64)
    low, high, start, end = (np.asarray(a, np.int64) for a in (low, high, start, end))
    some = high > low
    low, high, start, end = low[some], high[some], start[some], end[some]
    after[high - 1] = end
    while True:
        some = high - low > 1
        low, high, start, end = low[some], high[some], start[some], end[some]
        if not len(low):
            return after
        middle = (low + high) // 2
        first = np.argsort(low - middle, kind="stable")
        total, order = np.empty((len(low), 4), np.int64), np.empty((len(low), 4), np.int64)
        total[first], order[first] = _forward(cost, code, kinds, low[first], middle[first], start[first])
        second = np.argsort(middle - high, kind="stable")
        back = np.empty((len(low), 4), np.int64)
        back[second] = _backward(cost, kinds, middle[second], high[second], end[second])
        crossing = ((total + back) * 4 + order).argmin(axis=1)
        after[middle - 1] = crossing
        low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
        start, end = np.concatenate([start, crossing]), np.concatenate([crossing, end])
