"""Suffix arrays by grouping (Baier 2016): Lyndon-prefix groups in descending order, then each group's order.

Many texts are sorted at once, each on its own: a round takes the next group of every text that has one left, so that
the work of a round is done by array operations over all texts.

Phase 1 keeps the suffixes in slots, a group's slots side by side, groups in ascending order of the prefix that their
suffixes share. It walks from the highest group down. The previous-smaller pointer of a suffix leads to the nearest
place to its left that no processed group holds. Places reached by k suffixes of the current group have that group's
prefix k times after their own, and move, by k, into new groups at the end of their old group's slots. Phase 2 walks
the array as it grows: the suffixes that the current one follows are placed next in their groups, by the same pointers;
nothing is renamed and nothing sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - count), count)


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def suffix_arrays(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The suffixes of every text in ascending order, a suffix before those that it is a prefix of.

    symbols: the texts joined, values from 0 to 511; lengths: of each. The result holds, text after text, places in
    ``symbols``.
    """
    symbols, lengths = np.asarray(symbols, np.int64), np.asarray(lengths, np.int64)
    total = len(symbols) + len(lengths)
    # The place before each text holds no suffix; pointers that lead nowhere end there.
    begin = np.cumsum(lengths + 1) - lengths
    text = np.repeat(np.arange(len(lengths)), lengths)
    places = np.arange(len(symbols)) + text + 1
    group, size, slot, member, pointer = (np.full(total, -1, np.int32) for _ in range(5))

    order = np.argsort(symbols.astype(np.uint16), kind="stable")
    order = order[np.argsort(text[order].astype(np.uint16 if len(lengths) < 1 << 16 else np.int64), kind="stable")]
    first = firsts(text[order], symbols[order])
    count = np.diff(np.append(first, len(order)))
    member[places] = places[order]
    slot[places[order]] = places
    group[places[order]] = np.repeat(places[first], count)
    size[places[first]] = count
    del order

    moving = np.zeros(total, bool)
    top = begin + lengths
    active = np.flatnonzero(lengths)
    while len(active):
        ends = top[active]
        low = group[member[ends - 1]]
        i = member[ranges(low, ends - low)]
        own = np.repeat(low, ends - low)
        j = i - 1
        pointer[i] = j
        walking = np.flatnonzero(group[j] >= own)
        while len(walking):
            on = pointer[j[walking]]
            j[walking] = on
            pointer[i[walking]] = on
            walking = walking[group[on] >= own[walking]]
        reached = np.sort(j[group[j] >= 0])
        if len(reached):
            first = firsts(reached)
            who, times = reached[first], np.diff(np.append(first, len(reached)))
            by = np.argsort(group[who].astype(np.int64) * (total + 1) + times)
            who, times = who[by], times[by]
            old = group[who]
            first = firsts(old)
            heads, moved = old[first], np.diff(np.append(first, len(old)))
            tail = heads + size[heads] - moved
            target = ranges(tail, moved)
            moving[who] = True
            inside = member[target]
            staying = inside[~moving[inside]]
            now = slot[who]
            left = np.sort(now[now < np.repeat(tail, moved)])
            member[left] = staying
            slot[staying] = left
            member[target] = who
            slot[who] = target
            moving[who] = False
            size[heads] -= moved
            first = firsts(old, times)
            count = np.diff(np.append(first, len(old)))
            group[who] = np.repeat(target[first], count)
            size[target[first]] = count
        top[active] = low
        active = active[low > begin[active]]

    free = np.arange(total, dtype=np.int32)
    out = np.zeros(total, np.int32)
    placed = np.zeros(total, bool)
    placed[begin - 1] = True

    def follow(j: np.ndarray) -> None:
        while len(j := j[~placed[j]]):
            g = group[j]
            s = free[g]
            out[s] = j
            free[g] = s + 1
            placed[j] = True
            j = pointer[j]

    longest = np.argsort(-lengths, kind="stable")
    starts, sizes = begin[longest], lengths[longest]
    follow((begin + lengths - 1)[lengths > 0])  # the suffixes that the empty one follows
    more = len(sizes)
    for k in range(int(sizes[0]) if len(sizes) else 0):
        while sizes[more - 1] <= k:
            more -= 1
        follow(out[starts[:more] + k] - 1)
    return out[places] - text - 1


def suffix_array(text: Sequence[int]) -> list[int]:
    """Places of all suffixes of one text in ascending order."""
    return suffix_arrays(np.asarray(text, np.int64), np.array([len(text)])).tolist()
