"""Suffix arrays by linear grouping: suffixes grouped by their Lyndon prefixes, then put in order group by group.

Phase 1 takes the groups in descending order. Every suffix of a group looks up
its previous smaller suffix; the suffixes so found extend their prefix by the
group's, once for each suffix that points at them, and move into new groups
just above the rest of their old one. Phase 2 emits the order of each group
from the front: its suffixes share a prefix and go by the rank of the suffix
that follows it, which lies in an earlier group or earlier in the same one.
Nothing is renamed or sorted recursively.
"""

from __future__ import annotations

from array import array

import numpy as np

#: Groups of at least this many suffixes are taken with numpy, smaller ones in plain Python.
WIDE = 48


def _groups(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1: the suffixes by group, the start of each suffix's group and the length of its Lyndon prefix.

    The last symbol must be the only smallest.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    sa, isa, start, size, prev, length = (array("i", bytes(4 * n)) for _ in range(6))
    SA, ISA, START, SIZE, PREV, LENGTH = (np.frombuffer(x, np.int32) for x in (sa, isa, start, size, prev, length))
    LENGTH[:] = 1
    member = np.zeros(n, bool)
    SA[:] = order
    ISA[order] = np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], text[order][1:] != text[order][:-1]]))
    widths = np.diff(np.append(first, n))
    SIZE[first] = widths
    START[order] = np.repeat(first, widths)
    end = n
    while end > 0:
        g = start[sa[end - 1]]
        step = length[sa[g]]
        if end - g >= WIDE:
            s = np.sort(SA[g:end])
            p = s - 1
            active = np.flatnonzero(p >= 0)
            while len(active):  # step over larger groups
                active = active[START[p[active]] >= end]
                p[active] = PREV[p[active]]
                active = active[p[active] >= 0]
            inside = np.flatnonzero((p >= 0) & (START[np.maximum(p, 0)] == g))
            if len(inside):  # the nearest is of the same group: take over what that one has
                at = np.full(len(s), -1, np.int64)
                at[inside] = np.searchsorted(s, p[inside])
                while len(inside):
                    p[inside], at[inside] = p[at[inside]], at[at[inside]]
                    inside = inside[at[inside] >= 0]
            PREV[s] = p
            q = np.sort(p[p >= 0])
            if len(q):
                cut = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
                q, times = q[cut], np.diff(np.append(cut, len(q)))
                old = START[q]
                by = np.lexsort((times, old))
                q, times, old = q[by], times[by], old[by]
                LENGTH[q] += times * step
                cut = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
                k = np.diff(np.append(cut, len(old)))
                groups = old[cut]
                low = groups + SIZE[groups] - k  # where the moved suffixes of each group begin
                slots = np.arange(len(q)) + np.repeat(low - cut, k)
                member[q] = True
                there = SA[slots]
                staying = there[~member[there]]
                at = ISA[q]
                vacated = at[at < np.repeat(low, k)]
                SA[vacated], ISA[staying] = staying, vacated
                SA[slots], ISA[q] = q, slots
                member[q] = False
                run = np.flatnonzero(np.concatenate([[True], (old[1:] != old[:-1]) | (times[1:] != times[:-1])]))
                width = np.diff(np.append(run, len(q)))
                SIZE[groups] -= k
                SIZE[slots[run]] = width
                START[q] = np.repeat(slots[run], width)
        else:
            found: dict[int, int] = {}
            for s in sorted(sa[g:end]) if end - g > 1 else (sa[g],):
                p = s - 1
                while p >= 0:
                    at = start[p]
                    if at < g:
                        break
                    p = prev[p]
                    if at == g:
                        break
                prev[s] = p
                if p >= 0:
                    found[p] = found.get(p, 0) + 1
            if len(found) == 1:
                for p, times in found.items():
                    length[p] += times * step
                    at = start[p]
                    w = size[at]
                    if w > 1:
                        size[at] = w - 1
                        slot = at + w - 1
                        other, hole = sa[slot], isa[p]
                        sa[hole], isa[other] = other, hole
                        sa[slot], isa[p] = p, slot
                        size[slot], start[p] = 1, slot
            elif found:
                old_groups: dict[int, list[tuple[int, int]]] = {}
                for p, times in found.items():
                    length[p] += times * step
                    old_groups.setdefault(start[p], []).append((times, p))
                for at, moved in old_groups.items():
                    if len(moved) > 1:
                        moved.sort(reverse=True)
                    slot = at + size[at]
                    size[at] -= len(moved)
                    last, width = 0, 0
                    for times, p in moved:  # from the top: most repeats first
                        slot -= 1
                        other, hole = sa[slot], isa[p]
                        sa[hole], isa[other] = other, hole
                        sa[slot], isa[p] = p, slot
                        if times != last and width:
                            size[slot + 1] = width
                            for j in range(slot + 1, slot + 1 + width):
                                start[sa[j]] = slot + 1
                            width = 0
                        last = times
                        width += 1
                    size[slot] = width
                    for j in range(slot, slot + width):
                        start[sa[j]] = slot
        end = g
    return SA, START, LENGTH


def _emit(sa: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Phase 2: put the suffixes of each group in order; ``sa`` is completed in place."""
    n = len(sa)
    first = np.flatnonzero(np.concatenate([[True], start[sa][1:] != start[sa][:-1]]))
    sizes = np.diff(np.append(first, n))
    rank = np.empty(n, np.int32)
    rank[sa] = start[sa]  # right for groups of one
    several = sizes > 1
    follower = (np.arange(n) + length).astype(np.int32)
    ranks = array("i", rank.tobytes())
    RANK = np.frombuffer(ranks, np.int32)
    follow = array("i", follower.tobytes())
    begin = array("i", start.tobytes())
    for g, size in zip(first[several].tolist(), sizes[several].tolist()):
        members = sa[g : g + size]
        if size < WIDE:
            ready, later = [], []
            for s in members.tolist():
                f = follow[s]
                if begin[f] == g:
                    later.append((f, s))
                else:
                    ready.append((ranks[f], s))
            at = g
            ready.sort()
            while True:
                for _, s in ready:
                    sa[at] = s
                    ranks[s] = at
                    at += 1
                if not later:
                    break
                placed = {s for _, s in ready}
                ready = sorted((ranks[f], s) for f, s in later if f in placed)
                later = [x for x in later if x[0] not in placed]
        else:
            f = follower[members]
            inside = start[f] == g
            ready, f_ready, at = members[~inside], f[~inside], g
            after = np.sort(f[inside])  # suffixes of this group that follow others of it
            while len(ready):
                ready = ready[np.argsort(RANK[f_ready], kind="stable")]
                sa[at : at + len(ready)] = ready
                RANK[ready] = np.arange(at, at + len(ready))
                at += len(ready)
                if not len(after):
                    break
                f_ready = ready[after[np.minimum(np.searchsorted(after, ready), len(after) - 1)] == ready]
                ready = f_ready - int(length[members[0]])
    return sa


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of a byte string below 2 GB, in order."""
    n = len(data)
    if n < 2:
        return np.arange(n)
    text = np.zeros(n + 1, np.int64)
    text[:-1] = data.astype(np.int64) + 1
    return _emit(*_groups(text))[1:]
