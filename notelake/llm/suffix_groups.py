"""Suffix sorting by grouping: Lyndon-prefix groups in descending order, then one pass that emits."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array of a sequence of non-negative integers, in linear time but for the first sort.

    Phase one groups suffixes by their longest Lyndon prefix. Groups are taken from the highest down;
    each member hands its group's string to the nearest position before it that is still lower (the
    previous-smaller pointer, shortened as groups are done), and receivers move to a new group right
    above their old one, higher the more copies they received. Phase two walks the order from the
    smallest suffix: a suffix is its Lyndon prefix followed by the next smaller suffix, so whenever a
    suffix is emitted, those that continue with it take the next places of their groups.
    """
    if not len(symbols):
        return np.zeros(0, np.int64)
    n = len(symbols) + 1
    _, inverse = np.unique(symbols, return_inverse=True)
    group = [*(inverse + 1).tolist(), 0]
    count = max(group) + 1
    members: list[list[int]] = [[] for _ in range(count)]
    for i, g in enumerate(group):
        members[g].append(i)
    length = [1] * count
    below, above = list(range(-1, count - 1)), [*range(1, count), -1]
    left, done = list(range(-1, n - 1)), bytearray(n)

    current = count - 1
    while current > 0:
        own = [i for i in members[current] if group[i] == current]
        for i in own:
            done[i] = 1
        received: dict[int, int] = {}
        for i in own:
            p = i
            while p >= 0 and done[p]:
                p = left[p]
            q = i
            while q >= 0 and done[q]:
                left[q], q = p, left[q]
            if p >= 0:
                received[p] = received.get(p, 0) + 1
        split: dict[tuple[int, int], list[int]] = {}
        for p, k in received.items():
            split.setdefault((group[p], k), []).append(p)
        highest: dict[int, int] = {}
        for old, k in sorted(split):
            made, under = len(members), highest.get(old, old)
            members.append(split[old, k])
            length.append(length[old] + k * length[current])
            over = above[under]
            below.append(under)
            above.append(over)
            above[under] = made
            if over >= 0:
                below[over] = made
            highest[old] = made
            for p in split[old, k]:
                group[p] = made
        current = below[current]
    return _emitted(group, above, length)


def _emitted(group: list[int], above: list[int], length: list[int]) -> np.ndarray:
    """The order of the suffixes, without the end mark, from their groups in ascending order."""
    n = len(group)
    sizes = np.bincount(np.asarray(group), minlength=len(length))
    following, place, at = [0] * len(length), 0, 0
    while at >= 0:
        following[at] = place
        place += int(sizes[at])
        at = above[at]
    lengths = np.asarray(length)[np.asarray(group)]
    nexts = np.minimum(np.arange(n) + lengths, n - 1)
    nexts[n - 1] = n
    waiting = np.argsort(nexts, kind="stable")
    bounds = np.searchsorted(nexts[waiting], np.arange(n + 1)).tolist()
    waiting = waiting.tolist()
    order = [0] * n
    order[0] = n - 1
    for t in range(n):
        j = order[t]
        for i in waiting[bounds[j] : bounds[j + 1]]:
            g = group[i]
            order[following[g]] = i
            following[g] += 1
    return np.asarray(order[1:], np.int64)
