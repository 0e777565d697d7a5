"""Enhanced suffix arrays: sorted suffixes, common prefixes, and the interval tree over them.

The tree's nodes are found by a stack scan over the common prefixes. A node is a string and all places where it
occurs; it is a maximal repeat if no longer string occurs at the same places: on the right by being a node, on the left
if the bytes before its occurrences differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: What stands before a suffix when nothing does, and the mark of a subtree whose bytes before differ.
NOTHING, DIVERSE = -1, -2


def intervals(common: np.ndarray, before: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Maximal repeats as (length, first, last) over a suffix array: ``common[i]`` is the common prefix of suffixes
    i - 1 and i (common[0] is not read), ``before`` the byte left of each suffix or NOTHING, which differs from all."""
    marks = np.where(before == NOTHING, DIVERSE, before).tolist()
    lengths = [*common[1:].tolist(), 0] if len(marks) else []
    stack: list[list[int]] = []  # length, first suffix, what stands before
    for i, length in enumerate(lengths):
        first, mark = i, marks[i]
        while stack and stack[-1][0] > length:
            top_length, top_first, top_mark = stack.pop()
            if top_mark != mark:
                top_mark = DIVERSE
            if top_mark == DIVERSE and top_length >= least:
                yield top_length, top_first, i
            first, mark = top_first, top_mark
        if length:
            if stack and stack[-1][0] == length:
                if stack[-1][2] != mark:
                    stack[-1][2] = DIVERSE
            else:
                stack.append([length, first, mark])


def suffix_array(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of whole numbers by prefix doubling, and its common prefixes (common[0] = 0)."""
    n = len(values)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    ranks, step = [rank], 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + nxt
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            break
        ranks.append(rank)
        step *= 2
    # neighbours share 2**k symbols where their ranks of that round agree
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
        same &= np.maximum(a, b) + (1 << k) <= n
        common[1:][same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return order, common


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Every maximal repeat of at least ``least`` bytes in the texts, as (length, [(text, start), ...]) with all its
    occurrences. Matches never cross texts: each ends with a separator of its own."""
    parts, owner = [], []
    for i, t in enumerate(texts):
        parts += [np.frombuffer(t, np.uint8).astype(np.int64) + len(texts), np.array([i])]
        owner += [(i, p) for p in range(len(t) + 1)]
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    order, common = suffix_array(values)
    before = np.where(order > 0, values[order - 1], NOTHING) if len(order) else order
    before = np.where(before < len(texts), NOTHING, before)
    return [(n, sorted(owner[order[k]] for k in range(a, b + 1))) for n, a, b in intervals(common, before, least)]
