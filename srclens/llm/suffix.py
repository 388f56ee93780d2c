"""Suffix array of bytes by induced sorting, and permuted common prefixes.

Suffixes are classified as larger or smaller than the next one; the leftmost
smaller ones of each run are sorted by their substrings, named, and ranked
recursively; the order of all others follows by two scans over the buckets of
first bytes.  Each scan handles the entries of a bucket together, so the work is
linear in numpy operations rather than in Python steps.  The reduced string has
an alphabet of its own size, where buckets would hold single entries; its ranks
are therefore refined by doubling.
"""

from __future__ import annotations

import numpy as np


def _smaller(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (the last: true)."""
    n = len(t)
    out = np.ones(n, bool)
    if n > 1:
        differs = np.append(np.flatnonzero(t[:-1] != t[1:]), n - 1)
        at = differs[np.searchsorted(differs, np.arange(n - 1))]
        out[:-1] = (at == n - 1) | (t[at] < t[np.minimum(at + 1, n - 1)])
    return out


def _append(sa: np.ndarray, t: np.ndarray, found: np.ndarray, place: np.ndarray, step: int) -> None:
    """Put suffixes, in this order, at the running place of the bucket of their first symbol."""
    first = t[found]
    order = np.argsort(first, kind="stable")
    found, first = found[order], first[order]
    many = np.bincount(first, minlength=len(place))
    rank = np.arange(len(found)) - np.repeat(np.cumsum(many) - many, many)
    sa[place[first] + (rank if step > 0 else -1 - rank)] = found
    place += step * many


def _induce(t: np.ndarray, smaller: np.ndarray, ends: np.ndarray, sorted_lms: np.ndarray) -> np.ndarray:
    """All suffixes from the leftmost smaller ones, which are in the order given."""
    n, starts = len(t), np.append(0, ends[:-1])
    sa = np.full(n, -1, np.int64)
    tail = ends.copy()
    _append(sa, t, sorted_lms[::-1], tail, -1)
    held = [sa[a:b].copy() for a, b in zip(tail, ends)]
    head = starts.copy()

    def larger(entries):
        before = entries[entries > 0] - 1
        before = before[~smaller[before]]
        if len(before):
            _append(sa, t, before, head, 1)

    used = np.flatnonzero(ends > starts)
    for c in used:
        at = starts[c]
        while at < head[c]:
            stop = head[c]
            larger(sa[at:stop].copy())
            at = stop
        larger(held[c])
    tail = ends.copy()

    def less(entries):
        before = entries[entries > 0] - 1
        before = before[smaller[before]]
        if len(before):
            _append(sa, t, before, tail, -1)

    last = n - 1  # the end of the text is a suffix of its own, before all others
    for c in used[::-1]:
        if c == t[last]:
            tail[c] -= 1
            sa[tail[c]] = last
        at = ends[c]
        while at > tail[c]:
            stop = tail[c]
            less(sa[stop:at][::-1].copy())
            at = stop
        less(sa[starts[c]:head[c]][::-1].copy())
    return sa


def _names(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks, in text order, of the substrings between successive leftmost smaller positions."""
    stops = np.append(lms[1:], lms[-1])
    length = np.zeros(len(t), np.int64)
    length[lms] = stops - lms
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        x, y = a[live] + k, b[live] + k
        equal = (t[x] == t[y]) & (smaller[x] == smaller[y])
        same[live[~equal]] = False
        live = live[equal]
        live = live[length[a[live]] > k]
        k += 1
    rank = np.zeros(len(t), np.int64)
    rank[order] = np.append(0, np.cumsum(~same))
    return rank[lms]


def _doubled(names: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of ``names``; each round sorts only those still tied.

    A rank is the place of the first suffix of its group, so ranks of one group
    never have to move when another is split.
    """
    n = len(names)
    order = np.argsort(names, kind="stable")
    sorted_names = names[order]
    first = np.append(True, sorted_names[1:] != sorted_names[:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    tied = order[~(first & np.append(first[1:], True))]
    step = 1
    while len(tied):
        later = np.where(tied + step < n, rank[np.minimum(tied + step, n - 1)] + 1, 0)
        by = np.argsort(rank[tied] * (n + 1) + later, kind="stable")
        tied, later = tied[by], later[by]
        group = rank[tied]
        start = np.append(True, group[1:] != group[:-1])
        first = start | np.append(True, later[1:] != later[:-1])
        place = np.arange(len(tied))
        rank[tied] = group + np.maximum.accumulate(np.where(first, place, 0)) - np.maximum.accumulate(
            np.where(start, place, 0))
        tied = tied[~(first & np.append(first[1:], True))]
        step *= 2
    return rank


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffixes of a string that ends in its only least symbol, in order."""
    n = len(t)
    if n < 3:
        return np.argsort(t, kind="stable")
    smaller = _smaller(t)
    ends = np.cumsum(np.bincount(t))
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = _induce(t, smaller, ends, lms)
    order = order[is_lms[order]]
    names = _names(t, smaller, lms, order)
    if names.max() < len(lms) - 1:
        order = np.empty_like(lms)
        order[_doubled(names)] = lms
    return _induce(t, smaller, ends, order)


def common_prefixes(data: np.ndarray, left: np.ndarray, phi: np.ndarray, most: int) -> np.ndarray:
    """Length of the prefix each position shares with position ``phi`` (-1: none), up to ``most``.

    In text order such a length is at least the one before it less one, so every
    second position starts from what its predecessor is known to share.
    ``left``: bytes to the end of each position's text; no prefix goes beyond it.
    """
    n = len(data)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = data
    words = np.ndarray((n + 8,), "<u8", padded, strides=(1,))
    other = np.where(phi >= 0, phi, 0)
    bound = np.where(phi >= 0, np.minimum(left, left[other]), 0)
    # Lengths reach beyond ``most``, so that a successor up to 64 further on starts high enough.
    bound = np.minimum(bound, most + 64)
    out = np.zeros(n, np.int64)
    step = 64
    while step:
        if step == 64:
            at = np.arange(0, n, step)
        else:
            at = np.arange(step, n, 2 * step)
            out[at] = np.minimum(np.maximum(out[at - step] - step, 0), bound[at])
        live = at[out[at] < bound[at]]
        while len(live):
            x = words[live + out[live]] ^ words[other[live] + out[live]]
            low = x & (~x + np.uint64(1))
            gain = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int64)
            out[live] = np.minimum(out[live] + gain, bound[live])
            live = live[(gain == 8) & (out[live] < bound[live])]
        step //= 2
    return np.minimum(out, most)


def repeated(data: np.ndarray, bounds: np.ndarray, least: int) -> np.ndarray:
    """True where a string of ``least`` bytes starts that also starts elsewhere.

    ``bounds``: starts of the texts and the end of the last; no string crosses them.
    """
    n, k = len(data), len(bounds) - 1
    if not n:
        return np.zeros(0, bool)
    # Texts are parted by 1, the whole ends in 0, bytes are moved up by 2.
    text = np.ones(n + k + 1, np.uint16)
    place = np.arange(n) + np.repeat(np.arange(k), np.diff(bounds))
    text[place] = data.astype(np.uint16) + 2
    text[-1] = 0
    sa = suffix_array(text)
    raw = np.zeros(n + k + 1, np.uint8)
    raw[place] = data
    left = np.zeros(n + k + 1, np.int64)
    left[place] = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    phi = np.full(n + k + 1, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    shared = common_prefixes(raw, left, phi, least) >= least
    out = shared.copy()
    out[phi[shared]] = True
    return out[place]
