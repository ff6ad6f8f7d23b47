"""Deep-shallow sorting of chosen suffixes, in arrays.

Multikey quicksort on 8-byte words orders suffixes down to a shallow depth. The
groups that are still equal there, which share long prefixes, are ordered by
blind tries: each group's members hang on one pivot by the depth and byte at
which they leave it, and only members that leave at the same edge are compared
again, below it.
"""

from __future__ import annotations

import numpy as np

WORD = 8


def padded(data):
    """data with room for one word behind its end."""
    return np.concatenate([data, np.zeros(WORD, np.uint8)])


def words_at(buf, pos, left):
    """The 8 bytes at each position as a number that sorts like them; bytes from
    left on count as 0. buf is padded."""
    view = np.lib.stride_tricks.as_strided(buf, (len(buf) - WORD + 1, WORD), (1, 1))
    w = view[np.minimum(pos, len(buf) - WORD)].view(">u8").ravel().astype(np.uint64)
    short = left < WORD
    if short.any():
        drop = (8 * (WORD - np.clip(left[short], 0, WORD))).astype(np.uint64)
        w[short] = np.where(drop >= 64, 0, (w[short] >> np.minimum(drop, 63)) << np.minimum(drop, 63))
    return w


def _by_group(group, key):
    """Order by group, then key; group ascends already."""
    o = np.argsort(key, kind="stable")
    return o[np.argsort(group[o], kind="stable")]


def sort_suffixes(buf, starts, limits, shallow: int = 24):
    """(order, same): starts in the order of the strings buf[start : start +
    limit], a prefix before what it starts, and whether each string equals the
    one before it. buf is padded; no string reaches into the padding."""
    n = len(starts)
    starts, limits = np.asarray(starts, np.int64), np.asarray(limits, np.int64)
    order = np.arange(n)
    same = np.zeros(n, bool)
    if n < 2:
        return order, same
    live = np.arange(n)  # places in order whose group has several members
    group = np.zeros(n, np.int64)
    for depth in range(0, shallow, WORD):
        own = order[live]
        w = words_at(buf, starts[own] + depth, limits[own] - depth)
        o = np.argsort(w) if depth == 0 else _by_group(group, w)
        order[live], w, g = own[o], w[o], group[o]
        edge = np.append(True, (w[1:] != w[:-1]) | (g[1:] != g[:-1]))
        first = np.flatnonzero(edge)
        many = np.repeat(np.diff(np.append(first, len(live))) > 1, np.diff(np.append(first, len(live))))
        group = (np.cumsum(edge) - 1)[many]
        live = live[many]
        if not len(live):
            return order, same
    depth = np.full(len(live), shallow, np.int64)
    while len(live):
        own = order[live]
        edge = np.append(True, group[1:] != group[:-1])
        head = np.flatnonzero(edge)
        pivot = own[head][np.cumsum(edge) - 1]
        lcp, side, byte = _leave(buf, starts, limits, own, pivot, depth)
        key = np.where(side < 0, lcp * 512 + byte + 1, np.where(side > 0, (1 << 62) - lcp * 512 + byte + 1, 1 << 61))
        o = _by_group(group, key)
        order[live], g, key, side, lcp = own[o], group[o], key[o], side[o], lcp[o]
        edge = np.append(True, (key[1:] != key[:-1]) | (g[1:] != g[:-1]))
        same[live] = ~edge & (side == 0)
        first = np.flatnonzero(edge)
        sizes = np.diff(np.append(first, len(live)))
        many = np.repeat(sizes > 1, sizes) & (side != 0)
        group, depth, live = (np.cumsum(edge) - 1)[many], lcp[many], live[many]
    return order, same


def _leave(buf, starts, limits, own, pivot, depth):
    """Where each string leaves its pivot, equal up to depth (or to the shorter
    one's end): common length, -1, 0 or 1 as it sorts to it, and its byte there
    (-1 if it has ended)."""
    a, b, la, lb = starts[own], starts[pivot], limits[own], limits[pivot]
    most = np.minimum(la, lb)
    lcp = np.minimum(depth, most)
    todo = np.flatnonzero((own != pivot) & (lcp < most))
    while len(todo):
        at, left = lcp[todo], most[todo] - lcp[todo]
        x = words_at(buf, a[todo] + at, left) ^ words_at(buf, b[todo] + at, left)
        hit = x != 0
        if hit.any():
            top = x[hit]
            lead = np.zeros(len(top), np.int64)
            for shift in (32, 16, 8):
                none = (top >> np.uint64(64 - shift)) == 0
                lead += np.where(none, shift // 8, 0)
                top = np.where(none, top << np.uint64(shift), top)
            lcp[todo[hit]] += lead
        go = todo[~hit]
        lcp[go] = np.minimum(lcp[go] + WORD, most[go])
        todo = go[lcp[go] < most[go]]
    lcp[own == pivot] = most[own == pivot]
    mine = np.where(lcp < la, buf[a + lcp].astype(np.int64), -1)
    its = np.where(lcp < lb, buf[b + lcp].astype(np.int64), -1)
    return lcp, np.sign(mine - its), mine
