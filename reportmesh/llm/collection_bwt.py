"""Burrows-Wheeler transform and common prefixes of a collection of strings, built column by column.

Each round inserts one more symbol of every string, from its end to its start: the transform so far
says where the longer suffixes belong, and one sequential pass writes the enlarged transform and the
lengths of common prefixes of neighbours. Nothing but the streams of the previous round is read. Callers
hand over groups of bounded size, so that the streams are arrays of one task; no local file is used.
"""

from __future__ import annotations

import numpy as np

from .flat import ranges

_CAP = 250


def build(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transform and common prefixes over all suffixes of the strings, the empty ones first.

    ``symbols`` are codes above 0. Position p of the first array has the symbol before the p-th suffix,
    0 where that suffix is a whole string; of the second, the common prefix with suffix p - 1 (capped).
    Equal suffixes stand in the order of their strings.
    """
    m = len(starts)
    bwt = np.zeros(m, np.uint8)
    prefix = np.zeros(m + 1, np.uint8)  # one more, so that a range may end at the last
    at = np.arange(m)  # where each string's longest suffix so far stands, in that order
    who = np.arange(m)
    done = 0
    while True:
        going = lengths[who] > done
        at, who = at[going], who[going]
        if not len(who):
            return bwt, prefix[:-1]
        symbol = symbols[starts[who] + lengths[who] - 1 - done]
        bwt[at] = symbol
        # suffixes of the next round, in order: those of this round by the symbol before them
        order = np.argsort(bwt, kind="stable")[len(bwt) - np.count_nonzero(bwt) :]
        fresh = np.zeros(len(bwt), bool)
        fresh[at] = True
        risen = np.flatnonzero(fresh[order])  # ranks of the new suffixes, rising
        by_rank = np.argsort(symbol, kind="stable")  # their strings in that order
        rank = np.empty_like(risen)
        rank[by_rank] = risen
        before = order[np.maximum(rank - 1, 0)]
        same = (rank > 0) & (bwt[before] == symbol)
        shared = _minima(prefix, np.where(same, before + 1, at), at + 1)
        shared = np.where(same, np.minimum(shared, _CAP - 1) + 1, 0).astype(np.uint8)
        after = order[np.minimum(rank + 1, len(order) - 1)]
        # a follower that is new itself gets its value above
        follows = np.flatnonzero((rank + 1 < len(order)) & (bwt[after] == symbol) & ~fresh[after])
        next_shared = np.minimum(_minima(prefix, at[follows] + 1, after[follows] + 1), _CAP - 1) + 1
        # sequential pass: old entries move apart, new ones go between them
        size = m + len(order)
        new = m + rank
        old = np.ones(size, bool)
        old[m + risen] = False
        next_bwt = np.zeros(size, np.uint8)
        next_bwt[old] = bwt
        next_prefix = np.zeros(size + 1, np.uint8)
        next_prefix[:-1][old] = prefix[:-1]
        next_prefix[new[follows] + 1] = next_shared
        next_prefix[new] = shared
        bwt, prefix = next_bwt, next_prefix
        at, who = m + risen, who[by_rank]
        done += 1


def _minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of each range, the ranges' ends rising."""
    if not len(low):
        return np.zeros(0, np.uint8)
    edges = np.empty(2 * len(low), np.int64)
    edges[0::2], edges[1::2] = low, high
    return np.minimum.reduceat(values, edges)[0::2]


def suffix_places(bwt: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Place of every non-empty suffix, string after string, from the first symbol of each to its last."""
    m = len(lengths)
    order = np.argsort(bwt, kind="stable")
    closed = len(bwt) - np.count_nonzero(bwt)
    step = np.empty(len(bwt), np.int64)
    step[order[closed:]] = m + np.arange(len(bwt) - closed)
    firsts = np.cumsum(lengths) - lengths
    places = np.empty(int(lengths.sum()), np.int64)
    at, who, k = np.arange(m), np.arange(m), 1
    while len(who):
        going = lengths[who] >= k
        at, who = at[going], who[going]
        at = step[at]
        places[firsts[who] + lengths[who] - k] = at
        k += 1
    return places


def smallest_owner(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, owners: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of every string, the smallest owner of a string with the same window.

    Returns (windows per string, owners of all windows, string after string). ``data`` holds UTF-8.
    """
    counts = np.maximum(lengths - window + 1, 0)
    text = data[ranges(starts, lengths)]
    seen = np.flatnonzero(np.bincount(text, minlength=256))
    code = np.zeros(256, np.uint8)
    code[seen] = np.arange(1, len(seen) + 1)
    bwt, prefix = build(code[text], np.cumsum(lengths) - lengths, lengths)
    places = suffix_places(bwt, lengths)
    firsts = np.cumsum(lengths) - lengths
    of_window = places[ranges(firsts, counts)]
    by_place = np.full(len(bwt), np.iinfo(np.int64).max)
    by_place[of_window] = np.repeat(owners, counts)
    group_start = np.flatnonzero(prefix < window)  # the first suffix shares nothing
    least = np.minimum.reduceat(by_place, group_start)
    group = np.cumsum(prefix < window) - 1
    return counts, least[group[of_window]]
