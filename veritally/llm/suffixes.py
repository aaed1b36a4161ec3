"""Suffix arrays of byte shards by induced sorting, with NumPy.

Suffixes are classified as S (smaller than the next) or L; the leftmost S
suffixes of each run are sorted first, and the order of all others is induced
from them, one first byte after the other, each as array operations over a
whole bucket. The sorted leftmost substrings get names; the string of names is
the smaller problem that is solved next. Its alphabet is too wide to go bucket
by bucket, so its suffixes are sorted by doubling the compared length.
"""

from __future__ import annotations

import numpy as np

from veritally.llm.words import mix, powers, seeds


def small_types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts next. The last symbol is the unique smallest."""
    n = len(t)
    small = np.ones(n, bool)
    differs = np.flatnonzero(t[:-1] != t[1:])
    if n > 1:
        where = np.searchsorted(differs, np.arange(n - 1))
        at = differs[where]
        small[:-1] = t[at] < t[at + 1]
    return small


def place(sa: np.ndarray, heads: np.ndarray, symbols: np.ndarray, suffixes: np.ndarray, step: int) -> None:
    """Appends suffixes, in order, to their symbols' buckets; step -1 fills from the right."""
    order = np.argsort(symbols, kind="stable")
    symbols = symbols[order]
    first = np.searchsorted(symbols, symbols)
    sa[heads[symbols] + step * (np.arange(len(symbols)) - first)] = suffixes[order]
    heads += step * np.bincount(symbols, minlength=len(heads))


def induce(t: np.ndarray, small: np.ndarray, leftmost: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffix array that follows from an order of the leftmost S suffixes."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sa = np.full(len(t), -1, np.int64)
    in_bucket = np.bincount(t[leftmost], minlength=len(sizes))
    order = np.argsort(t[leftmost], kind="stable")
    by_symbol = leftmost[order]
    s_cut = np.cumsum(in_bucket) - in_bucket
    heads = starts.copy()
    for c in np.flatnonzero(sizes).tolist():
        at = starts[c]
        while at < heads[c]:
            new = sa[at : heads[c]] - 1
            at = heads[c]
            new = new[new >= 0]
            new = new[~small[new]]
            place(sa, heads, t[new], new, 1)
        if in_bucket[c]:
            new = by_symbol[s_cut[c] : s_cut[c] + in_bucket[c]] - 1
            new = new[new >= 0]  # what precedes a leftmost S suffix is of type L
            place(sa, heads, t[new], new, 1)
    l_ends = heads.copy()
    tails = ends - 1
    for c in np.flatnonzero(sizes)[::-1].tolist():
        at = ends[c] - 1
        while at > tails[c]:
            new = sa[tails[c] + 1 : at + 1][::-1] - 1
            at = tails[c]
            new = new[new >= 0]
            new = new[small[new]]
            place(sa, tails, t[new], new, -1)
        new = sa[starts[c] : l_ends[c]][::-1] - 1
        new = new[new >= 0]
        new = new[small[new]]
        place(sa, tails, t[new], new, -1)
    sa[0] = len(t) - 1
    return sa


def doubled(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string of names."""
    n, k = len(names), 1
    rank = names.astype(np.int64) + 1
    while True:
        key = rank * (n + 2)
        key[: n - k] += rank[k:]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[1], 1 + np.cumsum(key[1:] != key[:-1])])
        rank[order] = new
        k *= 2
        if new[-1] == n or k >= n:
            return order


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``t``, whose symbols are below 512 and whose last is its only 0."""
    t = t.astype(np.int64)
    sizes = np.bincount(t)
    small = small_types(t)
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(left) == 0:
        return induce(t, small, left, sizes)
    rough = induce(t, small, left, sizes)
    is_left = np.zeros(len(t), bool)
    is_left[left] = True
    ordered = rough[is_left[rough]]
    # a leftmost substring reaches to the next leftmost position; the last one ends with the text
    following = np.append(left, len(t) - 1)
    end = np.zeros(len(t), np.int64)
    end[left] = following[1:]
    values = seeds(512, 8)[t]
    up, down = powers(len(t) + 2)
    sums = np.zeros(len(t) + 1, np.uint64)
    np.cumsum(values * up[: len(t)], out=sums[1:])
    digest = mix((sums[end[ordered] + 1] - sums[ordered]) * down[ordered] + (end[ordered] - ordered).astype(np.uint64))
    name = np.zeros(len(t), np.int64)
    name[ordered] = np.concatenate([[0], np.cumsum(digest[1:] != digest[:-1])])
    names = name[left]
    if names.max() + 1 < len(left):
        ordered = left[doubled(names)]
    return induce(t, small, ordered, sizes)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position its predecessor in suffix order (-1: none) and how many bytes the two share.

    ``room`` is how many bytes of its own text a position has left; nothing is shared beyond.
    Only positions that aren't preceded by the same byte as their predecessor are compared; the
    others share one byte less than the position before them.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.flatnonzero((before >= 0) & (room > 0))
    at = at[room[before[at]] > 0]
    other = before[at]
    fresh = (at == 0) | (other == 0) | (t[at - 1] != t[other - 1]) | (room[at - 1] == 0) | (room[other - 1] == 0)
    shared = np.zeros(n, np.int64)
    i, j = at[fresh], other[fresh]
    most = np.minimum(room[i], room[j])
    length = np.zeros(len(i), np.int64)
    padded = np.concatenate([t.astype(np.uint16), np.zeros(16, np.uint16)])
    wide = np.lib.stride_tricks.sliding_window_view(padded, 16)
    active = np.arange(len(i))
    while len(active):
        a, b = i[active] + length[active], j[active] + length[active]
        same = wide[a] == wide[b]
        run = np.where(same.all(axis=1), 16, same.argmin(axis=1))
        length[active] = np.minimum(length[active] + run, most[active])
        active = active[(run == 16) & (length[active] < most[active])]
    # position + shared never falls along a run of positions that carry on from one another
    reach = np.zeros(n, np.int64)
    reach[i] = i + length
    reach = np.maximum.accumulate(reach)
    shared[at] = np.minimum(reach[at] - at, np.minimum(room[at], room[other]))
    return before, np.maximum(shared, 0)
