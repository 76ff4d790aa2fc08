"""Sorted string runs that carry common prefix lengths, and their merge."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def prefix_lengths(rows: np.ndarray) -> np.ndarray:
    """Common prefix of each row of a sorted byte matrix with the row before."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differs = rows[1:] != rows[:-1]
        out[1:] = np.where(differs.any(1), differs.argmax(1), rows.shape[1])
    return out


def front_code(rows: np.ndarray, common: np.ndarray) -> bytes:
    """The bytes of each row after its common prefix with the row before."""
    return rows[np.arange(rows.shape[1]) >= common[:, None]].tobytes()


def front_decode(rest: bytes, common: Sequence[int], width: int) -> list[bytes]:
    out, before, at = [], b"", 0
    for n in common:
        size = width - n
        before = before[:n] + rest[at: at + size]
        at += size
        out.append(before)
    return out


def _common(a: bytes, b: bytes, at: int) -> int:
    """Common prefix of two strings of equal length known to agree before ``at``."""
    if a == b:
        return len(a)
    step = 16
    while a[at: at + step] == b[at: at + step]:
        at += step
    while a[at] == b[at]:
        at += 1
    return at


def merge_runs(runs: Sequence[Sequence[bytes]], common: Sequence[Sequence[int]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs of strings of equal length: the run of each string of the
    result, and its common prefix with the one before.

    A loser tree in which every waiting string knows how far it agrees with the
    last winner. Of two strings the one that agrees further is the smaller; only if
    both agree equally far are bytes read, and only those after that.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads = [iter(zip(r, c)) for r, c in zip(runs, common)]
    string: list[bytes | None] = [None] * k
    agree = [-1] * k  # an empty run loses against all
    for i, head in enumerate(heads):
        first = next(head, None)
        if first is not None:
            string[i], agree[i] = first[0], 0
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser learns how far it agrees with the winner."""
        if agree[a] != agree[b]:
            return (a, b) if agree[a] > agree[b] else (b, a)
        if agree[a] < 0:
            return a, b
        x, y = string[a], string[b]
        n = _common(x, y, agree[a])
        if n == len(x):
            win, lose = (a, b) if a < b else (b, a)
        else:
            win, lose = (a, b) if x[n] < y[n] else (b, a)
        agree[lose] = n
        return win, lose

    best = list(range(k))
    node = k
    while node > 1:  # first round, pairs from the leaves up
        node //= 2
        winners = []
        for i in range(node):
            win, losers[node + i] = play(best[2 * i], best[2 * i + 1])
            winners.append(win)
        best = winners
    top = best[0]
    order, lengths = [], []
    while agree[top] >= 0:
        order.append(top)
        lengths.append(agree[top])
        following = next(heads[top], None)
        if following is None:
            string[top], agree[top] = None, -1
        else:
            string[top], agree[top] = following
        at = (k + top) // 2
        while at:
            other = losers[at]
            if agree[top] < agree[other]:
                losers[at], top = top, other
            elif agree[top] == agree[other]:
                top, losers[at] = play(top, other)
            at //= 2
    return order, lengths
