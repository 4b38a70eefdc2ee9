"""Suffix arrays by induced sorting (Nong, Zhang & Chan, DCC 2009), with whole buckets
moved at a time in numpy, and permuted common prefixes (Kärkkäinen, Manzini & Puglisi,
CPM 2009).
"""

from __future__ import annotations

import numpy as np

from .common import ranges

#: Above so many symbols a string of names is ranked by doubling: one step for each bucket
#: would be one step for nearly every name.
MAX_BUCKETS = 2048


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True: the suffix is smaller than the next one.  The last suffix counts as smaller."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int64))).astype(np.int8)
    where = np.where(step != 0, np.arange(n - 1), n)
    nxt = np.minimum.accumulate(where[::-1])[::-1] if n > 1 else where
    out = np.ones(n, bool)
    known = nxt < n
    out[:-1][known] = step[nxt[known]] > 0
    return out


def _place(sa: np.ndarray, j: np.ndarray, symbols: np.ndarray, at: np.ndarray, down: bool) -> None:
    """Appends positions ``j`` to the buckets of their ``symbols``, in order; ``at`` is the
    next free place of each bucket and moves on."""
    order = np.argsort(symbols, kind="stable")
    counts = np.bincount(symbols, minlength=len(at))
    first = np.cumsum(counts) - counts
    rank = np.arange(len(j)) - np.repeat(first, counts)
    base = np.repeat(at, counts)
    if down:
        sa[base - rank] = j[order]
        at -= counts
    else:
        sa[base + rank] = j[order]
        at += counts


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All suffixes from the leftmost-smaller ones in the order ``lms``."""
    n, k = len(t), len(size)
    ends = np.cumsum(size)
    starts = ends - size
    sa = np.full(n, -1, np.int64)
    by_symbol = lms[np.argsort(t[lms], kind="stable")]
    of = np.bincount(t[lms], minlength=k)
    cut = np.cumsum(of) - of
    head = starts.copy()
    for c in range(k):
        at = starts[c]
        while at < head[c]:
            block = sa[at:head[c]]
            at = head[c]
            j = block[block > 0] - 1
            j = j[~small[j]]
            if len(j):
                _place(sa, j, t[j], head, False)
        if of[c]:
            j = by_symbol[cut[c]:cut[c] + of[c]] - 1
            j = j[j >= 0]
            if len(j):
                _place(sa, j, t[j], head, False)
    large_end = head  # the larger suffixes of a bucket lie before this place
    tail = ends - 1
    sa[0] = n - 1
    for c in range(k - 1, 0, -1):
        at = ends[c] - 1
        while at > tail[c]:
            block = sa[tail[c] + 1:at + 1][::-1]
            at = tail[c]
            j = block[block > 0] - 1
            j = j[small[j]]
            if len(j):
                _place(sa, j, t[j], tail, True)
        block = sa[starts[c]:large_end[c]][::-1]
        j = block[block > 0] - 1
        j = j[small[j]]
        if len(j):
            _place(sa, j, t[j], tail, True)
    return sa


def _equal(t: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Which substrings t[a:a+n] and t[b:b+n] are equal."""
    out = np.ones(len(a), bool)
    ends = np.cumsum(n)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + step, "right")))
        same = t[ranges(a[lo:hi], n[lo:hi])] == t[ranges(b[lo:hi], n[lo:hi])]
        out[lo:hi] = np.logical_and.reduceat(same, np.cumsum(n[lo:hi]) - n[lo:hi])
        lo = hi
    return out


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffix array of a string of names by rank doubling; suffixes whose rank is their own
    already leave the sort."""
    n = len(names)
    sa = np.argsort(names, kind="stable")
    s = names[sa]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 1
    alone = new & np.concatenate([new[1:], [True]])
    at = np.flatnonzero(~alone)
    while len(at):
        p = sa[at]
        second = np.where(p + h < n, rank[np.minimum(p + h, n - 1)] + 1, 0)
        first = rank[p]
        order = np.lexsort((second, first))
        p, first, second = p[order], first[order], second[order]
        sa[at] = p
        group = np.concatenate([[True], first[1:] != first[:-1]])
        new = group | np.concatenate([[True], second[1:] != second[:-1]])
        rank[p] = np.maximum.accumulate(np.where(new, at, 0))
        alone = new & np.concatenate([new[1:], [True]])
        at = at[~alone]
        h *= 2
    return sa


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of ``t`` (non-negative integers; the last is 0 and occurs only there)."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    size = np.bincount(t)
    small = suffix_types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sa = _induce(t, small, lms, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ranked = sa[is_lms[sa]]  # by leftmost-smaller substrings
    length = np.zeros(n, np.int64)
    length[lms] = np.diff(np.concatenate([lms, [n - 1]])) + 1
    a, b = ranked[:-1], ranked[1:]
    differs = length[a] != length[b]
    alike = np.flatnonzero(~differs)
    differs[alike] = ~_equal(t, a[alike], b[alike], length[a[alike]])
    name = np.concatenate([[0], np.cumsum(differs)])
    at = np.zeros(n, np.int64)
    at[ranked] = name
    names = at[lms]
    if name[-1] + 1 == len(lms):
        order = ranked
    else:
        order = lms[suffix_array(names) if name[-1] < MAX_BUCKETS else _doubled(names)]
    return _induce(t, small, order, size)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: at text position p the length shared by the suffix p and its
    predecessor in ``sa`` (0 for the first).  Only where the symbols before the two differ
    is the length counted; elsewhere it is one less than at the position before."""
    n = len(t)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    p = np.arange(n)
    fresh = (p == 0) | (before <= 0)
    rest = np.flatnonzero(~fresh)
    fresh[rest] = t[rest - 1] != t[before[rest] - 1]
    x = np.flatnonzero(fresh & (before >= 0))
    y, got = before[x], np.zeros(len(x), np.int64)
    per = 8 // t.itemsize
    padded = np.concatenate([t, np.zeros(per, t.dtype)])
    words = np.ndarray((n + 1,), "<u8", padded, strides=(t.itemsize,))
    live = np.arange(len(x))
    while len(live):
        i, j = x[live] + got[live], y[live] + got[live]
        d = words[i] ^ words[j]
        full = d == 0
        low = d & (~d + np.uint64(1))
        got[live] += np.where(full, per, np.bitwise_count(low - np.uint64(1)) // (8 * t.itemsize))
        live = live[full]
    value = np.zeros(n, np.int64)
    value[x] = got
    last = np.maximum.accumulate(np.where(fresh, p, 0))
    return value[last] - (p - last)
