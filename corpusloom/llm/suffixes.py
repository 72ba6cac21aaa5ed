"""Suffix sorting in linear grouping steps, without recursive renaming."""

from __future__ import annotations

from collections import Counter

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a sequence of integers in lexicographic order; a shorter one comes before its extensions.

    First, suffixes are grouped by their first symbol, and the groups are
    taken in descending order. For each member of a group, the pointer to the
    nearest place before it that lies in a lower group is found; the places
    pointed at are moved into new groups just above their own, those with more
    pointers higher. In the end a group holds the suffixes with one longest
    Lyndon prefix. Second, groups are filled from the front in ascending order:
    each suffix places those whose Lyndon prefix ends just before it.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    first = np.argsort(text, kind="stable")
    cut = np.flatnonzero(np.diff(text[first], prepend=text[first[0]] - 1))
    order = first.tolist()
    size = dict(zip(cut.tolist(), np.diff(cut, append=n).tolist()))
    at = np.empty(n, np.int64)
    at[first] = np.repeat(cut, np.diff(cut, append=n))
    group = at.tolist()  # of a suffix: where its group starts in order
    at[first] = np.arange(n)
    place = at.tolist()
    before = [-1] * n
    end = n
    while end:
        g = group[order[end - 1]]
        members = sorted(order[g:end])
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= g:
                p = before[p]
            before[s] = p
        pointed = Counter([before[s] for s in members])
        pointed.pop(-1, None)
        by_count: dict[int, list[int]] = {}
        for p, c in pointed.items():
            by_count.setdefault(c, []).append(p)
        for c in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for p in by_count[c]:
                h = group[p]
                k = moved.get(h, 0)
                moved[h] = k + 1
                # swap p to the end of what is left of its group
                a, b = place[p], h + size[h] - 1 - k
                q = order[b]
                order[a], order[b] = q, p
                place[q], place[p] = a, b
            for h, k in moved.items():
                if k < size[h]:
                    new = h + size[h] - k
                    size[h] -= k
                    size[new] = k
                    for b in range(new, new + k):
                        group[order[b]] = new
        end = g
    out = [-1] * n
    front = {g: g for g in size}
    done = bytearray(n)

    def fill(p: int) -> None:
        while p >= 0 and not done[p]:
            g = group[p]
            out[front[g]] = p
            front[g] += 1
            done[p] = 1
            p = before[p]

    fill(n - 1)
    for i in range(n):
        fill(out[i] - 1)
    return np.array(out)
