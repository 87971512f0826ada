"""Suffix sorting by linear grouping, without recursion or renaming.

First the suffixes are refined to groups of equal Lyndon prefix: groups are taken in descending
order; each suffix of a group points to the previous position of a smaller group, and positions so
pointed to move to new groups just above their old one, those with more pointers higher. Then the
order inside the groups follows by one pass over the result: each suffix placed puts the suffix to
its left, and those on that one's chain of pointers, at the next place of their groups.
"""

from __future__ import annotations


def suffix_array(symbols: list[int]) -> list[int]:
    """Start positions of all suffixes in ascending order; a suffix sorts before its extensions."""
    n = len(symbols)
    if n == 0:
        return []
    # Position n is the end mark, in a group of its own below all others.
    members: list[list[int]] = [[n]]
    by_symbol: dict[int, list[int]] = {}
    for i, symbol in enumerate(symbols):
        by_symbol.setdefault(symbol, []).append(i)
    members += [by_symbol[symbol] for symbol in sorted(by_symbol)]
    below = [-1, *range(len(members) - 1)]
    above = [*range(1, len(members)), -1]
    group = [0] * (n + 1)
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    size = [len(own) for own in members]
    done = [False] * (n + 1)
    smaller = [-1] * (n + 1)     # previous position of a smaller group
    skip = list(range(-1, n))    # where to look next on the left of a processed position
    current = len(members) - 1
    while current > 0:
        if size[current] == 1:
            # A group of one: at most one position is pointed to, and if it is alone it stays.
            i = members[current][0] if len(members[current]) == 1 else next(i for i in members[current] if group[i] == current)
            done[i] = True
            j = skip[i]
            while j >= 0 and done[j]:
                j = skip[j]
            k = i
            while k >= 0 and done[k] and skip[k] != j:
                skip[k], k = j, skip[k]
            smaller[i] = j
            if j >= 0:
                old = group[j]
                if size[old] > 1:
                    new, up = len(members), above[old]
                    members.append([j])
                    size.append(1)
                    size[old] -= 1
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    below[up] = new
                    group[j] = new
            current = below[current]
            continue
        own = [i for i in members[current] if group[i] == current]
        members[current] = own
        for i in own:
            done[i] = True
        pointers: dict[int, int] = {}
        for i in own:
            j = skip[i]
            while j >= 0 and done[j]:
                j = skip[j]
            # The walk is shortened for later visits.
            k = i
            while k >= 0 and done[k] and skip[k] != j:
                skip[k], k = j, skip[k]
            smaller[i] = j
            if j >= 0:
                pointers[j] = pointers.get(j, 0) + 1
        if pointers:
            by_count: dict[int, list[int]] = {}
            for j, count in pointers.items():
                by_count.setdefault(count, []).append(j)
            for count in sorted(by_count, reverse=True):
                fresh: dict[int, int] = {}
                for j in by_count[count]:
                    old = group[j]
                    new = fresh.get(old)
                    if new is None:
                        new = fresh[old] = len(members)
                        members.append([])
                        size.append(0)
                        up = above[old]
                        below.append(old)
                        above.append(up)
                        above[old] = new
                        below[up] = new
                    members[new].append(j)
                    size[new] += 1
                    size[old] -= 1
                    group[j] = new
        current = below[current]
    # Places of the groups, in ascending order.
    place, at, g = [0] * len(members), 0, 0
    while g >= 0:
        place[g] = at
        at += size[g]
        g = above[g]
    order, placed = [-1] * (n + 1), [False] * (n + 1)
    order[0], placed[n] = n, True
    for k in range(n + 1):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[place[g]] = j
            place[g] += 1
            placed[j] = True
            j = smaller[j]
    return order[1:]
