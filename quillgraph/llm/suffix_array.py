"""Suffix arrays by induced sorting and permuted common prefixes, vectorised over whole buckets.

``suffix_array`` classifies suffixes, sorts the leftmost-smaller (LMS) substrings by one induced
pass, names them, orders the string of names recursively, and induces the full order from it. The
induced passes handle one first-symbol bucket at a time; a bucket's members that induce into the
same bucket go in waves, so the work is linear and free of per-suffix Python steps. Where a string
of names has more than ``FEW_NAMES`` different ones, buckets are too small for that; it is ordered by
doubling over the names that still tie.
"""

from __future__ import annotations

import numpy as np

#: Different names up to which the string of names is sorted by a further induced pass.
FEW_NAMES = 1 << 11


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True for S-type positions; the last symbol must be the unique least one."""
    n = len(t)
    ends = np.r_[np.flatnonzero(t[1:] != t[:-1]), n - 1]
    rises = np.r_[t[ends[:-1]] < t[ends[:-1] + 1], True]
    return np.repeat(rises, np.diff(np.r_[-1, ends]))


def _induce(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The order of all suffixes that the given order of LMS positions induces."""
    lms_cut = np.searchsorted(t[lms], np.arange(sigma + 1))
    pushed: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    larger: list[np.ndarray] = [lms[:0]] * sigma

    def spread(at: np.ndarray, want_s: bool, own: int) -> np.ndarray:
        """Pushes predecessors of the wanted type to their buckets; returns those of this bucket."""
        prev = at[at > 0] - 1
        prev = prev[s_type[prev] == want_s]
        if not len(prev):
            return prev
        ch = t[prev]
        order = np.argsort(ch, kind="stable")
        prev, ch = prev[order], ch[order]
        cuts = np.r_[0, np.flatnonzero(ch[1:] != ch[:-1]) + 1, len(ch)]
        same = prev[:0]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            c = int(ch[a])
            if c == own:
                same = prev[a:b]
            else:
                pushed[c].append(prev[a:b])
        return same

    for c in range(sigma):
        parts, pushed[c] = pushed[c], []
        wave = np.concatenate(parts) if parts else lms[:0]
        waves = [wave]
        while len(wave):
            wave = spread(wave, False, c)
            waves.append(wave)
        larger[c] = np.concatenate(waves)
        own = lms[lms_cut[c] : lms_cut[c + 1]]
        if len(own):
            spread(own, False, c)
    smaller: list[np.ndarray] = [lms[:0]] * sigma
    for c in range(sigma - 1, -1, -1):
        parts, pushed[c] = pushed[c], []
        wave = np.concatenate(parts) if parts else lms[:0]
        waves = [wave]
        while len(wave):
            wave = spread(wave, True, c)
            waves.append(wave)
        smaller[c] = np.concatenate(waves)
        if len(larger[c]):
            spread(larger[c][::-1], True, c)
    smaller[0] = np.array([len(t) - 1], lms.dtype) if not len(smaller[0]) else smaller[0]
    return np.concatenate([x for c in range(sigma) for x in (larger[c], smaller[c][::-1])])


def _doubling(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string over a large alphabet; only ties are sorted again."""
    m = len(names)
    order = np.argsort(names, kind="stable")
    sorted_names = names[order]
    starts = np.flatnonzero(np.r_[True, sorted_names[1:] != sorted_names[:-1]])
    rank = np.empty(m, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.r_[starts, m]))
    step = 1
    size = np.diff(np.r_[starts, m])
    slots = np.flatnonzero(np.repeat(size, size) > 1)  # places in the order that still tie
    while len(slots):
        at = order[slots]
        nxt = at + step
        second = np.where(nxt < m, rank[np.minimum(nxt, m - 1)] + 1, 0)
        first = rank[at]
        perm = np.argsort(first * (m + 2) + second, kind="stable")
        at, first, second = at[perm], first[perm], second[perm]
        order[slots] = at
        fresh = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        begin = np.flatnonzero(fresh)
        size = np.diff(np.r_[begin, len(at)])
        rank[at] = np.repeat(slots[begin], size)
        slots = slots[np.repeat(size, size) > 1]
        step *= 2
    return order


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of ``t`` (symbols 0 .. sigma-1, the last one a unique 0)."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    s_type = suffix_types(t)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    # LMS substrings: any order inside a first-symbol bucket will do for the first pass.
    rough = _induce(t, s_type, lms[np.argsort(t[lms], kind="stable")], sigma)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    number = np.empty(n, np.int64)
    number[lms] = np.arange(len(lms))
    length = np.r_[np.diff(lms) + 1, 1]
    k = number[ordered]
    same = np.r_[False, length[k][1:] == length[k][:-1]]
    active = np.flatnonzero(same)
    depth = 0
    while len(active):
        active = active[length[k[active]] > depth]
        differ = t[ordered[active] + depth] != t[ordered[active - 1] + depth]
        same[active[differ]] = False
        active = active[~differ]
        depth += 1
    names = np.cumsum(~same) - 1
    reduced = np.empty(len(lms), np.int64)
    reduced[k] = names
    different = int(names[-1]) + 1
    if different == len(lms):
        return _induce(t, s_type, ordered, sigma)
    # The last name is that of the last symbol alone, which is the least and unique.
    sorted_lms = lms[suffix_array(reduced, different) if different <= FEW_NAMES else _doubling(reduced)]
    return _induce(t, s_type, sorted_lms, sigma)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """LCP of each entry with the one before it, by way of the permuted (text-order) array.

    A position whose predecessor symbol equals that of its neighbour is reducible: its value is one
    less than the value before it in the text. The others are compared directly, all at once.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    has = phi >= 0
    reducible = has.copy()
    reducible[0] = False
    prev = phi[1:] - 1
    reducible[1:] &= (prev >= 0) & (t[np.maximum(prev, 0)] == t[:-1])
    base = np.flatnonzero(~reducible)
    value = np.zeros(n, np.int64)
    live = base[has[base]]
    depth = 0
    while len(live):
        other = phi[live] + depth
        own = live + depth
        ok = (own < n) & (other < n)
        ok[ok] = t[own[ok]] == t[other[ok]]
        value[live[~ok]] = depth
        live = live[ok]
        depth += 1
    last = np.maximum.accumulate(np.where(reducible, 0, at))
    plcp = np.maximum(value[last] - (at - last), 0)
    return plcp[sa]
