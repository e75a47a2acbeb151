"""Burrows-Wheeler transform and common prefixes of a collection, built column by column.

Each round inserts one symbol of every string that still has one, from the last to the first.  The
state is the transform so far and the common prefix of each entry with the one before it; a round
reads both in order and writes both in order with the new entries merged in.
"""

from __future__ import annotations

import numpy as np


def collection_bwt(flat: np.ndarray, size: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(bwt, lcp) of all suffixes of the strings laid end to end in ``flat`` with lengths ``size`` (each >= 1).

    Symbols are bytes plus one, the end of a string is 0, and ends are ordered by string and differ
    from each other.  ``lcp[p]`` is the common prefix of entries p - 1 and p, at most ``cap``.
    """
    n_strings = len(size)
    stop = np.cumsum(size)
    symbols = flat.astype(np.uint16) + 1
    if symbols.max(initial=0) < 256:
        symbols = symbols.astype(np.uint8)  # UTF-8 has no byte 255
    bwt = symbols[stop - 1]
    lcp = np.zeros(n_strings, np.uint8)
    who = np.arange(n_strings)
    at = np.arange(n_strings)
    length = 0
    while len(who):
        length += 1
        n = len(bwt)
        order = np.argsort(bwt, kind="stable")
        slot = np.empty(n, np.int64)
        slot[order] = np.arange(n)
        ends = int(np.searchsorted(bwt, 1, sorter=order))
        q = slot[at]
        by = np.argsort(q, kind="stable")
        q, who = q[by], who[by]
        new = n_strings + q - ends

        # Common prefix with the entry before and of the entry behind: one more than the least between the two sources.
        ask = np.unique(np.concatenate([q, q + 1]))
        ask = ask[(ask > ends) & (ask < n)]
        lo, hi = order[ask - 1], order[ask]
        same = bwt[lo] == bwt[hi]
        value = np.zeros(n + 1, np.uint8)
        if same.any():
            asked, begin, end = ask[same], lo[same] + 1, hi[same] + 1
            down = np.argsort(-begin, kind="stable")  # descending, so that what lies between two intervals costs nothing
            pairs = np.stack([begin[down], end[down]], 1).ravel()
            least = np.minimum.reduceat(np.append(lcp, np.uint8(0)), pairs)[::2]
            value[asked[down]] = np.minimum(least.astype(np.uint16) + 1, cap)

        grown = n + len(who)
        old = np.ones(grown, bool)
        old[new] = False
        next_bwt, next_lcp = np.empty(grown, bwt.dtype), np.empty(grown, np.uint8)
        next_bwt[old], next_lcp[old] = bwt, lcp
        left = size[who] > length
        inserted = np.zeros(len(who), bwt.dtype)
        inserted[left] = symbols[stop[who[left]] - 1 - length]
        next_bwt[new] = inserted
        behind = new + 1 < grown
        next_lcp[new[behind] + 1] = value[q[behind] + 1]
        next_lcp[new] = value[q]
        bwt, lcp, who, at = next_bwt, next_lcp, who[left], new[left]
    return bwt, lcp


def window_minima(flat: np.ndarray, size: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` symbols of each string, in order, the least owner of a string that holds it."""
    bwt, lcp = collection_bwt(flat, size, length)
    n, n_strings = len(bwt), len(size)
    order = np.argsort(bwt, kind="stable")
    forward = np.empty(n, np.int64)
    forward[order] = np.arange(n)  # all ends precede: the entry of the suffix that is one symbol longer
    group = np.cumsum(lcp < length)
    per = np.maximum(0, size - length + 1)
    head = np.cumsum(per) - per
    out = np.empty(per.sum(), np.int64)
    who, at = np.arange(n_strings), np.arange(n_strings)
    for have in range(1, int(size.max(initial=0)) + 1):
        on = size[who] >= have
        who, at = who[on], forward[at[on]]
        if have >= length:
            out[head[who] + size[who] - have] = group[at]
    least = np.full(int(group[-1]) + 1 if n else 1, np.iinfo(np.int64).max)
    np.minimum.at(least, out, np.repeat(owner, per))
    return least[out]
