"""Suffix arrays by grouping: linear time, without recursion or renaming.

Phase 1 keeps suffixes in groups, first by their first symbol, and takes groups in
descending order. For each suffix of a group the pointer to the nearest earlier suffix of a lower
group is set; suffixes that are pointed at leave their group for a new one right behind it, those pointed at more often further
behind. At the end a group holds the suffixes with one longest Lyndon prefix, and groups lie in the order of these
prefixes. Phase 2 reads the array from the left and places, for each suffix, the one before it and
all that its pointers lead to at the front of their groups, which orders every group.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray | list[int]) -> list[int]:
    """Start positions of all suffixes in lexicographic order. The last symbol must be smaller than all others."""
    text = np.asarray(text, np.int64)
    n = len(text)
    if n == 0:
        return []
    by = np.argsort(text, kind="stable")
    new = np.concatenate([[True], text[by][1:] != text[by][:-1]])
    begin = np.flatnonzero(new)
    at, own = np.empty(n, np.int64), np.empty(n, np.int64)
    at[by] = np.arange(n)
    own[by] = begin[np.cumsum(new) - 1]
    sizes = np.zeros(n, np.int64)
    sizes[begin] = np.diff(np.append(begin, n))
    order, where = by.tolist(), at.tolist()
    group = own.tolist()  # where a suffix's group begins in the order
    size = sizes.tolist()

    prev = [-1] * n
    end = n
    while end > 0:
        i = order[end - 1]
        first = group[i]
        if end - first == 1:
            p = i - 1
            while p >= 0 and group[p] >= first:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                g = group[p]
                k = size[g]
                if k > 1:
                    tail = g + k - 1
                    at, other = where[p], order[tail]
                    order[at], order[tail] = other, p
                    where[other], where[p] = at, tail
                    size[g] = k - 1
                    size[tail] = 1
                    group[p] = tail
            end = first
            continue
        count: dict[int, int] = {}
        for i in sorted(order[first:end]):
            p = i - 1
            while p >= 0 and group[p] >= first:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        if count:
            most = max(count.values())
            if most == 1:
                levels = [list(count)]
            else:
                by: dict[int, list[int]] = {}
                for p, c in count.items():
                    by.setdefault(c, []).append(p)
                levels = [by[c] for c in sorted(by, reverse=True)]
            for level in levels:
                moved: dict[int, list[int]] = {}
                for p in level:
                    g = group[p]
                    if size[g] > 1:
                        if g in moved:
                            moved[g].append(p)
                        else:
                            moved[g] = [p]
                for g, members in moved.items():
                    k, m = size[g], len(members)
                    if m == k:
                        continue
                    new = tail = g + k
                    new -= m
                    for p in members:
                        tail -= 1
                        at = where[p]
                        if at != tail:
                            other = order[tail]
                            order[at], order[tail] = other, p
                            where[other], where[p] = at, tail
                        group[p] = new
                    size[g] = k - m
                    size[new] = m
        end = first

    out = [-1] * n
    head = list(range(n))
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        s = out[k] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[head[g]] = s
            head[g] += 1
            placed[s] = 1
            s = prev[s]
    return out
