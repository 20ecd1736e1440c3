"""A suffix array in linear time by grouping on Lyndon prefixes, without recursion or renaming.

Phase 1 starts from groups of suffixes with the same first value and takes groups in descending order. For each
suffix of the group in hand it finds the previous-smaller pointer, the nearest earlier suffix of a lower group, and
moves the suffixes so found into new groups right above their old ones, higher the more pointers they get. In the end
a group holds the suffixes with the same longest Lyndon prefix. Phase 2 emits each group's order: it scans the
array from its least suffix and lets every suffix place the one before it, and those up its chain of pointers.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(values: Sequence[int]) -> list[int]:
    """Start positions of all suffixes in lexicographic order; a suffix that is a prefix of another comes first."""
    n = len(values)
    if not n:
        return []
    # Groups are numbered as they are made; above[g] is the next higher group, below[g] the next lower one.
    number: dict[int, int] = {v: i for i, v in enumerate(sorted(set(values)))}
    group = [number[v] for v in values]
    members: list[list[int]] = [[] for _ in number]
    for s, g in enumerate(group):
        members[g].append(s)
    size = list(map(len, members))
    below = list(range(-1, len(number) - 1))
    above = list(range(1, len(number) + 1))
    above[-1] = -1
    smaller = [0] * n  # previous-smaller pointers, -1 for none
    left = list(range(n + 1))  # left[s + 1]: itself while the group of s is lower, else the way to the nearest such
    top = current = len(number) - 1
    while current >= 0:
        mine = members[current]
        if size[current] < len(mine):
            members[current] = mine = [s for s in mine if group[s] == current]
        if len(mine) == 1:
            s = mine[0]
            left[s + 1] = p = s
            while left[p] != p:
                left[p] = p = left[left[p]]
            p -= 1
            smaller[s] = p
            batches = ((p,),) if p >= 0 else ()
        else:
            for s in mine:
                left[s + 1] = s
            found: dict[int, int] = {}
            for s in mine:
                p = s
                while left[p] != p:
                    left[p] = p = left[left[p]]
                p -= 1
                smaller[s] = p
                found[p] = found.get(p, 0) + 1
            found.pop(-1, None)
            many = max(found.values(), default=0)
            if many <= 1:
                batches = (found,)
            else:
                batches = [[] for _ in range(many)]
                for p, k in found.items():
                    batches[many - k].append(p)
        for batch in batches:
            fresh: dict[int, int] = {}
            for p in batch:
                old = group[p]
                new = fresh.get(old)
                if new is None:
                    if size[old] == 1:
                        continue  # alone in its group, it stays where it is
                    new = fresh[old] = len(members)
                    up = above[old]
                    above.append(up)
                    below.append(old)
                    above[old] = new
                    below[up] = new  # a group below the one in hand always has one above
                    members.append([p])
                    size.append(1)
                else:
                    members[new].append(p)
                    size[new] += 1
                size[old] -= 1
                group[p] = new
        current = below[current]
    # The lowest group has nothing below it; walk up from it to number the places.
    order = top
    while below[order] >= 0:
        order = below[order]
    place = [0] * len(members)
    at = 0
    while order >= 0:
        place[order] = at
        at += size[order]
        order = above[order]
    out = [-1] * n
    done = bytearray(n)
    i, s = -1, n
    while True:
        p = s - 1
        while p >= 0 and not done[p]:
            g = group[p]
            out[place[g]] = p
            place[g] += 1
            done[p] = 1
            p = smaller[p]
        i += 1
        if i == n:
            return out
        s = out[i]
