"""Suffix arrays by linear grouping.

Suffixes are grouped by their longest Lyndon prefix.  Groups are taken from the
highest down: each member's nearest place to the left that no taken group holds is
its previous-smaller pointer, and the places so pointed at move to a new group
just above their own, the more often pointed at the higher.  Then places are emitted from
the lowest suffix up: each emitted place lets those whose next smaller suffix it
is take the next slot of their group.  Nothing is renamed and nothing recurses.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start places of all suffixes of a sequence of integers, in lexicographic order (a prefix comes first)."""
    n = len(text)
    slots: dict[int, list[int]] = {}
    for i, x in enumerate(text):
        slots.setdefault(x, []).append(i)
    order, group, place, size = [], [0] * n, [0] * n, {}  # a group is named by its first slot
    for x in sorted(slots):
        start = len(order)
        size[start] = len(slots[x])
        for i in slots[x]:
            group[i], place[i] = start, len(order)
            order.append(i)
    left = list(range(-1, n - 1))  # a place that is not right of the nearest untaken one
    taken, before = bytearray(n + 1), [-1] * n

    end = n
    while end:
        start = group[order[end - 1]]
        members = order[start:end]
        for i in members:
            taken[i] = 1
        often: dict[int, int] = {}
        for i in members:
            j = left[i]
            while j >= 0 and taken[j]:
                j = left[j]
            k = i
            while k >= 0 and taken[k] and left[k] != j:
                left[k], k = j, left[k]
            before[i] = j
            if j >= 0:
                often[j] = often.get(j, 0) + 1
        by_count: dict[int, list[int]] = {}
        for j, c in often.items():
            by_count.setdefault(c, []).append(j)
        for c in sorted(by_count, reverse=True):
            moved: dict[int, list[int]] = {}
            for j in by_count[c]:
                moved.setdefault(group[j], []).append(j)
            for g, some in moved.items():
                if len(some) == size[g]:
                    continue  # the whole group has this context
                to = g + size[g]
                for j in some:
                    to -= 1
                    other, at = order[to], place[j]
                    order[at], order[to], place[other], place[j] = other, j, at, to
                size[g] -= len(some)
                size[to] = len(some)
                for j in some:
                    group[j] = to
        end = start

    sorted_, put = [0] * n, bytearray(n)
    next_slot = {g: g for g in size}

    def emit(j: int) -> None:
        while j >= 0 and not put[j]:
            put[j] = 1
            g = group[j]
            sorted_[next_slot[g]] = j
            next_slot[g] += 1
            j = before[j]

    emit(n - 1)  # what precedes the empty suffix
    for i in range(n):
        emit(sorted_[i] - 1)
    return sorted_
