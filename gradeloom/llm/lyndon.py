"""Suffix arrays by linear grouping.

Suffixes are grouped by their Lyndon prefix. Groups are finished from the greatest to the
smallest: each suffix of a group is hung onto the nearest smaller suffix to its left, and
those get moved to new groups by how many of the group they have taken up. Then the array is
emitted from left to right: a placed suffix places the suffixes whose next smaller suffix it
is, each at the front of its group. No step renames and sorts again.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions in order of their suffixes; a suffix that ends sorts before one that
    goes on. Symbols are numbers of any size."""
    n = len(text)
    if n == 0:
        return []
    # Position n stands for the end, smaller than every symbol.
    of_symbol = {s: k + 1 for k, s in enumerate(sorted(set(text)))}
    group = [of_symbol[s] for s in text]
    group.append(0)
    members: list[list[int]] = [[] for _ in range(len(of_symbol) + 1)]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [len(m) for m in members]
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))
    left = list(range(-1, n))
    right = list(range(1, n + 2))
    hung = bytearray(n + 1)
    finished: list[tuple[int, int]] = []  # groups and their sizes, the greatest first
    at = len(members) - 1
    while at > 0:
        own = members[at]
        if len(own) != size[at]:
            own = [i for i in own if group[i] == at]
        members[at] = ()
        finished.append((at, len(own)))
        moves: dict[int, dict[int, list[int]]] = {}
        for i in own:
            p = left[i]
            if hung[i] or p >= 0 and group[p] == at:
                continue  # inside a run, hung up with its first
            j, count = right[i], 1
            while group[j] == at:
                left[j] = p
                hung[j] = 1
                j = right[j]
                count += 1
            left[j] = p
            if p >= 0:
                right[p] = j
                g = group[p]
                if size[g] > 1:  # a group of one keeps its place
                    by = moves.get(g)
                    if by is None:
                        moves[g] = {count: [p]}
                    elif count in by:
                        by[count].append(p)
                    else:
                        by[count] = [p]
        for g, by in moves.items():
            # New groups stand right above g; the more taken up, the higher.
            parts = [by[c] for c in sorted(by)]
            if sum(map(len, parts)) == size[g]:
                parts = parts[1:]  # the least can stay
            low, high = g, above[g]
            for moved in parts:
                new = len(members)
                members.append(moved)
                size.append(len(moved))
                size[g] -= len(moved)
                for p in moved:
                    group[p] = new
                below.append(low)
                above.append(high)
                above[low] = new
                low = new
            below[high] = low
        at = below[at]
    # left[i] is now the nearest smaller suffix to the left of i.
    slot, start = {}, 1
    for g, count in reversed(finished):
        slot[g] = start
        start += count
    out = [n] * (n + 1)
    placed = bytearray(n + 1)
    placed[n] = 1
    for i in out:
        j = i - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            k = slot[g]
            out[k] = j
            slot[g] = k + 1
            placed[j] = 1
            j = left[j]
    return out[1:]
