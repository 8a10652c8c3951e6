"""Suffix arrays by linear grouping, for many short texts at a time.

A suffix's Lyndon prefix ends before its next smaller suffix. The first phase sorts suffixes into groups
of equal Lyndon prefixes: groups are taken in descending order, each member's previous smaller suffix is
found over pointers, and those parents move behind the rest of their own groups, by how many members
point at them. The second phase walks the order from its start and puts the suffix before each one, and
its chain of previous smaller suffixes, at the front of what is left of their groups. Nothing is renamed
or sorted again. Texts are independent, so one step handles one group of every text in numpy.
"""

from __future__ import annotations

import numpy as np


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .., one after the other."""
    ends = np.cumsum(size)
    out = np.ones(int(ends[-1]), np.int64)
    out[0] = start[0]
    out[ends[:-1]] = start[1:] - (start[:-1] + size[:-1] - 1)
    return np.cumsum(out)


def suffix_arrays(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort the suffixes of each text, a text being a list of non-empty parts.

    A mark smaller than all bytes stands before each part and at the end; a later mark is the larger one,
    so a suffix that ends with its part is smaller than a longer one that starts with it. Returns the
    symbols of all texts (marks are negative), where each text starts, and the suffix array: the sorted
    positions of the first text, then those of the second, and so on.
    """
    pieces, starts, at = [], [], 0
    for parts in texts:
        starts.append(at)
        marks = len(parts) + 1
        for k, part in enumerate(parts):
            pieces.append(np.array([k - marks], np.int16))
            pieces.append(np.frombuffer(part, np.uint8).astype(np.int16))
            at += 1 + len(part)
        pieces.append(np.array([-1], np.int16))
        at += 1
    symbols, first = np.concatenate(pieces), np.array(starts)
    size = np.diff(np.append(first, len(symbols)))
    sorted_, group, before = _group(symbols, first, size)
    return symbols, first, _emit(symbols, first, sorted_, group, before)


def _group(symbols, first, size):
    """Phase 1: positions in the order of their groups, each position's group (its first place), previous smaller suffixes."""
    n = len(symbols)
    text = np.repeat(np.arange(len(first)), size)
    order = np.lexsort((symbols, text))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    fresh = np.ones(n, bool)
    fresh[1:] = (symbols[order][1:] != symbols[order][:-1]) | (text[order][1:] != text[order][:-1])
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    group = np.empty(n, np.int64)
    group[order] = head
    count = np.bincount(head, minlength=n)
    before = np.arange(-1, n - 1)
    real = symbols >= 0
    low = first + np.bincount(text, weights=~real, minlength=len(first)).astype(np.int64)  # marks come first
    end = first + size
    while True:
        open_ = end > low
        low, end = low[open_], end[open_]
        if not len(end):
            return order, group, before
        start = group[order[end - 1]]
        members = order[_ranges(start, end - start)]
        own = np.repeat(start, end - start)
        parent = members - 1
        wait = np.flatnonzero(group[parent] >= own)
        while len(wait):
            parent[wait] = before[parent[wait]]
            wait = wait[group[parent[wait]] >= own[wait]]
        before[members] = parent
        end = start
        parent = parent[real[parent]]
        if not len(parent):
            continue
        parent.sort()
        edge = np.flatnonzero(np.diff(parent, prepend=-1))
        hit, times = parent[edge], np.diff(np.append(edge, len(parent)))
        old = group[hit]
        by = np.lexsort((times, old))
        hit, times, old = hit[by], times[by], old[by]
        cut = np.flatnonzero(np.diff(old, prepend=-1))
        held = np.diff(np.append(cut, len(old)))
        slots = _ranges(old[cut] + count[old[cut]] - held, held)
        leaving = order[slots]  # what stood in the last places of the old groups goes where the hit ones were
        was = place[hit]
        span_low, span_high = np.repeat(slots[cut], held), np.repeat(slots[cut] + held, held)
        inside = (was >= span_low) & (was < span_high)
        vacated, vacated_old = was[~inside], old[~inside]
        moved = ~np.isin(slots, was[inside], assume_unique=True)
        away, to = leaving[moved], vacated[np.argsort(vacated_old, kind="stable")]
        order[to] = away
        place[away] = to
        order[slots] = hit
        place[hit] = slots
        run = np.flatnonzero((np.diff(old, prepend=-1) != 0) | (np.diff(times, prepend=-1) != 0))
        length = np.diff(np.append(run, len(old)))
        count[old[cut]] -= held
        count[slots[run]] = length
        group[hit] = np.repeat(slots[run], length)


def _emit(symbols, first, order, group, before):
    """Phase 2: the final order."""
    n = len(symbols)
    out = order.copy()
    front = np.arange(n)  # by a group's first place: the place its next member takes
    done = symbols < 0
    end = np.append(first[1:], n)
    at = first.copy()
    while len(at):
        s = out[at] - 1
        s = s[s >= 0]
        s = s[~done[s]]
        while len(s):
            g = group[s]
            out[front[g]] = s
            front[g] += 1
            done[s] = True
            s = before[s]
            s = s[~done[s]]
        at += 1
        going = at < end
        at, end = at[going], end[going]
    return out
