"""Linear suffix sorting by grouping (Baier, "Linear-time suffix sorting", CPM 2016).

Phase 1 sorts suffixes into groups by their Lyndon prefix. Groups are processed in descending order; each member points to
the nearest position before it that stands in a lower group (its previous smaller suffix), and the positions pointed to are
moved, within their groups, behind those pointed to less often. Phase 2 emits suffixes in order: the one before each emitted
suffix, and those that its pointers lead to, are next in their groups. Nothing is renamed or solved recursively.
"""

from __future__ import annotations

from collections import defaultdict


def suffix_array(s: list[int]) -> list[int]:
    """The starts of s's suffixes in ascending order. The last symbol has to be the least, and be there once."""
    n = len(s)
    if n < 2:
        return list(range(n))
    # Groups are ranges of `order`; a group is named by where its range begins.
    order = sorted(range(n), key=s.__getitem__)
    place, group = [0] * n, [0] * n
    begin = 0
    for k, i in enumerate(order):
        if s[i] != s[order[begin]]:
            begin = k
        place[i], group[i] = k, begin
    size: defaultdict[int, int] = defaultdict(int)
    for g in group:
        size[g] += 1
    smaller = [-1] * n
    end = n
    while end:
        g = group[order[end - 1]]
        members = order[g:end] if end - g == 1 else sorted(order[g:end])
        counts: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        if counts:
            if len(counts) == 1 or max(counts.values()) == 1:
                levels = [list(counts)]
            else:
                by: dict[int, list[int]] = {}
                for p, c in counts.items():
                    by.setdefault(c, []).append(p)
                levels = [by[c] for c in sorted(by, reverse=True)]
            for level in levels:
                moved: dict[int, int] = {}
                for p in level:
                    a = group[p]
                    m = moved.get(a, 0)
                    to, at = a + size[a] - 1 - m, place[p]
                    other = order[to]
                    order[at], order[to] = other, p
                    place[other], place[p] = at, to
                    moved[a] = m + 1
                for a, m in moved.items():
                    left = size[a] - m
                    if left:
                        b = a + left
                        size[a], size[b] = left, m
                        for k in range(b, b + m):
                            group[order[k]] = b
        end = g
    out, filled = [-1] * n, [0] * n
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[g + filled[g]] = j
            filled[g] += 1
            placed[j] = 1
            j = smaller[j]
    return out
