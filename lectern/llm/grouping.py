"""Suffix array by linear grouping construction.

Phase 1 keeps suffixes in groups, ordered ranges of one array, that at the end hold the suffixes of one longest
Lyndon prefix each. Groups are processed in descending order. Each suffix of the group points to the nearest suffix
before it that lies in a lower group (its previous smaller suffix); the suffixes pointed at move, those with most
pointers highest, to new groups right after their old ones. Phase 2 emits the order: from the smallest suffix on, each
suffix's left neighbour and its chain of pointers take the next free places of their groups. Nothing is renamed and
nothing recurses.
"""

from __future__ import annotations


def suffix_array(symbols: list[int]) -> list[int]:
    """Start positions of the suffixes of symbols in ascending order. An empty list gives an empty one."""
    n = len(symbols)
    if n == 0:
        return []
    low = min(symbols) - 1
    text = [*symbols, low]  # the end, below every symbol
    order = sorted(range(n + 1), key=text.__getitem__)
    place = [0] * (n + 1)
    group = [0] * (n + 1)  # a group's name is where its range starts
    end = [0] * (n + 1)
    start = 0
    for i, s in enumerate(order):
        place[s] = i
        if text[s] != text[order[start]]:
            start = i
        group[s] = start
        end[start] = i
    before = [-2] * (n + 1)  # -2: not known yet
    hi = n
    while hi >= 0:
        lo = group[order[hi]]
        members = order[lo : hi + 1] if hi == lo else sorted(order[lo : hi + 1])
        pointed: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= lo:
                p = before[p] if before[p] != -2 else p - 1
            before[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if len(pointed) == 1:
            (p,) = pointed
            _raise_up([p], group[p], order, place, group, end)
        elif pointed:
            levels: dict[int, dict[int, list[int]]] = {}
            for p, count in pointed.items():
                levels.setdefault(count, {}).setdefault(group[p], []).append(p)
            for count in sorted(levels, reverse=True):
                for name, moved in levels[count].items():
                    _raise_up(moved, name, order, place, group, end)
        hi = lo - 1
    out = [-1] * (n + 1)
    out[0] = n
    placed = bytearray(n + 1)
    placed[n] = 1
    free = list(range(n + 1))
    for i in range(n + 1):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = before[s]
    return out[1:]


def _raise_up(moved: list[int], name: int, order: list[int], place: list[int], group: list[int], end: list[int]) -> None:
    """Make moved, members of group `name`, a group of their own right after it."""
    last = to = end[name]
    if len(moved) == last - name + 1:
        return
    for s in moved:
        at, other = place[s], order[to]
        order[at], order[to] = other, s
        place[other], place[s] = at, to
        to -= 1
    end[name] = to
    end[to + 1] = last
    for s in moved:
        group[s] = to + 1
