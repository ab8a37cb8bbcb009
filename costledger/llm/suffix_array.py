"""Suffix array by linear grouping construction.

A suffix's group is its longest Lyndon prefix found so far; groups are ordered like those prefixes.
Phase one goes through the groups from the largest down.  Each suffix of a group points to the
nearest position before it whose group is smaller (previous-smaller pointers, followed with path
compression over groups already done).  A position that a run of k members of the group leads back
to has its prefix extended by k copies of the group's, so it moves up into a new group behind its
old one.  Phase two reads the array from the left: each suffix places the chain of positions before
it at the next free place of their groups.  Nothing is sorted by comparison and no shorter string is
renamed and solved again.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of the suffixes in ascending order; a suffix is less than its extensions.

    ``text`` holds non-negative integers of any size.
    """
    n = len(text)
    if n < 2:
        return list(range(n))
    count: dict[int, int] = {}
    for c in text:
        count[c] = count.get(c, 0) + 1
    free: dict[int, int] = {}
    total = 1  # the empty suffix is the least and has place 0
    for c in sorted(count):
        free[c] = total
        total += count[c]
    size = [0] * (n + 1)  # by a group's first place
    for c, at in free.items():
        size[at] = count[c]
    size[0] = 1
    order, place, group = [n] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    start = dict(free)
    for i, c in enumerate(text):
        at = free[c]
        free[c] = at + 1
        order[at], place[i], group[i] = i, at, start[c]
    previous = [-1] * (n + 1)

    top = n
    while top >= 0:
        low = group[order[top]]
        if low == top:  # a single member
            i = order[top]
            p = i - 1
            while p >= 0 and group[p] > low:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                old = group[p]
                left = size[old] - 1
                if left:
                    end = old + left
                    other, at = order[end], place[p]
                    order[at], place[other] = other, at
                    order[end], place[p] = p, end
                    size[old], size[end], group[p] = left, 1, end
            top = low - 1
            continue
        # From left to right: a member that stands right behind another is one more copy in its run.
        run: dict[int, int] = {}
        copies: dict[int, int] = {}
        for i in sorted(order[low : top + 1]):
            p, k = i - 1, 1
            while p >= 0 and group[p] > low:
                p = previous[p]
            if p >= 0 and group[p] == low:
                p, k = previous[p], run[p] + 1
            previous[i], run[i] = p, k
            if p >= 0:
                copies[p] = k
        by_copies: dict[int, list[int]] = {}
        for p, k in copies.items():
            by_copies.setdefault(k, []).append(p)
        for k in sorted(by_copies, reverse=True):
            moved: dict[int, list[int]] = {}
            for p in by_copies[k]:
                moved.setdefault(group[p], []).append(p)
            for old, ps in moved.items():
                left = size[old] - len(ps)
                if not left:
                    continue
                end = old + size[old] - 1
                for p in ps:
                    other, at = order[end], place[p]
                    order[at], place[other] = other, at
                    order[end], place[p] = p, end
                    end -= 1
                new = old + left
                size[old], size[new] = left, len(ps)
                for p in ps:
                    group[p] = new
        top = low - 1

    done, result, following = [False] * (n + 1), [0] * (n + 1), list(range(n + 1))
    result[0] = n
    done[n] = True
    for at in range(n + 1):
        i = result[at] - 1
        while i >= 0 and not done[i]:
            g = group[i]
            result[following[g]] = i
            following[g] += 1
            done[i] = True
            i = previous[i]
    return result[1:]
