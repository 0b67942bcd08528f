"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are S (smaller than the next) or L. The leftmost S suffixes (LMS) are sorted by their
substrings, named, and the string of names is sorted in its turn by the same function; all others
are induced from them in two linear scans. Over bytes the scans take a whole bucket at a time in
numpy; over the names of a deeper level, whose buckets are short, they go symbol by symbol.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are scanned by buckets.
SMALL = 400


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffix array of a string of integers from 0 whose last symbol is the only 0."""
    n, k = len(t), int(t.max()) + 1
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    s = _types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    induce = _induce if k <= SMALL else _induce_by_symbol
    order = induce(t, k, s, lms)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    names, count = _names(t, lms, order)
    sub = np.argsort(names) if count == len(lms) else suffix_array(names)
    return induce(t, k, s, lms[sub])


def _induce_by_symbol(t: np.ndarray, k: int, s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """As _induce: each scan looks at the symbol before a place, if its suffix is of the scan's type."""
    n = len(t)
    size = np.bincount(t, minlength=k)
    tails = np.cumsum(size)
    heads = tails - size
    # the given suffixes go to the ends of their buckets, in order
    by = lms[np.argsort(t[lms], kind="stable")]
    given = np.bincount(t[by], minlength=k)
    sa = np.full(n, n, dtype=np.int64)
    sa[np.arange(len(by)) + (tails - np.cumsum(given))[t[by]]] = by
    sa = sa.tolist()
    # place -> symbol of the suffix before it, or -1; place n stands for none
    before = np.full(n + 1, -1, dtype=np.int64)
    before[1:n] = t[:-1]
    low = before.copy()
    low[1:n][s[:-1]] = -1
    low, at = low.tolist(), heads.tolist()
    for i in sa:
        if (x := low[i]) >= 0:
            sa[at[x]] = i - 1
            at[x] += 1
    before[1:n][~s[:-1]] = -1
    high, at = before.tolist(), tails.tolist()
    for i in reversed(sa):
        if (x := high[i]) >= 0:
            at[x] -= 1
            sa[at[x]] = i - 1
    return np.array(sa, dtype=np.int64)


def _types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes; a run of equal symbols has the type of its end. The last suffix is S."""
    n = len(t)
    differs = np.append(t[1:] != t[:-1], True)
    at = np.where(differs, np.arange(n), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1]  # the next place whose symbol differs from the one after
    up = np.append(t[1:] > t[:-1], True)
    return up[nxt]


def _deal(t: np.ndarray, pos: np.ndarray, to: list[list[np.ndarray]]) -> None:
    """Append pos, in order, to the buckets of their symbols."""
    if not len(pos):
        return
    c = t[pos]
    by = np.argsort(c, kind="stable")
    c, pos = c[by], pos[by]
    cut = np.flatnonzero(c[1:] != c[:-1]) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(c)], strict=True):
        to[c[a]].append(pos[a:b])


def _induce(t: np.ndarray, k: int, s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes, induced from the LMS suffixes in the given order (sorted within a bucket)."""
    n, none = len(t), np.zeros(0, dtype=np.int64)
    heads: list[list[np.ndarray]] = [[] for _ in range(k)]
    _deal(t, lms, heads)
    low: list[list[np.ndarray]] = [[] for _ in range(k)]
    for c in range(k):  # L suffixes, from the left
        done = 0
        while done < len(low[c]):  # what the bucket adds to itself comes last
            wave = low[c][done] if done == len(low[c]) - 1 else np.concatenate(low[c][done:])
            low[c][done:] = [wave]
            done += 1
            before = wave[wave > 0] - 1
            _deal(t, before[~s[before]], low)
        for wave in heads[c]:
            before = wave[wave > 0] - 1
            _deal(t, before[~s[before]], low)
    high: list[list[np.ndarray]] = [[] for _ in range(k)]
    high[int(t[n - 1])].append(np.array([n - 1]))
    for c in range(k - 1, -1, -1):  # S suffixes, from the right; lists run downwards
        done = 0
        while done < len(high[c]):
            wave = high[c][done] if done == len(high[c]) - 1 else np.concatenate(high[c][done:])
            high[c][done:] = [wave]
            done += 1
            before = wave[wave > 0] - 1
            _deal(t, before[s[before]], high)
        if low[c]:
            wave = np.concatenate(low[c])[::-1]
            before = wave[wave > 0] - 1
            _deal(t, before[s[before]], high)
    out = []
    for c in range(k):
        out += low[c]
        out.append(np.concatenate(high[c])[::-1] if high[c] else none)
    return np.concatenate(out)


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in text order, and how many names there are."""
    size = np.diff(np.append(lms, len(t) - 1)) + 1
    rank = np.zeros(len(t), dtype=np.int64)
    rank[lms] = size
    size = rank[order]
    a, b = order[:-1], order[1:]
    same = size[:-1] == size[1:]
    at, k = np.flatnonzero(same), 0
    while len(at):
        at = at[k < size[at]]
        differs = t[a[at] + k] != t[b[at] + k]
        same[at[differs]] = False
        at, k = at[~differs], k + 1
    named = np.zeros(len(t), dtype=np.int64)
    named[order] = np.cumsum(np.append(0, ~same))
    return named[lms], int(len(order) - same.sum())


def common_prefixes(t: np.ndarray, sa: np.ndarray, room: np.ndarray) -> np.ndarray:
    """For each place of the text, the common prefix with its neighbour before it in the suffix array, at most room.

    Only irreducible values are compared (the symbols before differ); after another place the value
    is one less. room is the distance to the separator after a place, a symbol that no segment holds.
    """
    n = len(t)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    have = phi >= 0
    before = np.where(phi > 0, t[np.maximum(phi - 1, 0)], -1)
    irreducible = ~have | (phi == 0) | (i == 0) | (t[i - 1] != before) | (room > np.append(0, room[:-1]))
    out = np.zeros(n, dtype=np.int64)
    at = np.flatnonzero(irreducible & have)
    k = 0
    while len(at):
        p = phi[at]
        go = (room[at] > k) & (t[np.minimum(at + k, n - 1)] == t[np.minimum(p + k, n - 1)])
        out[at[~go]] = k
        at, k = at[go], k + 1
    last = np.maximum.accumulate(np.where(irreducible, i, -1))
    return np.maximum(np.minimum(out[last] - (i - last), room), 0)
