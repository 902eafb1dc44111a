"""Suffix arrays by induced sorting, vectorised bucket by bucket, and permuted longest common prefixes.

An induced pass is sequential only in that a suffix is placed after its successor; all suffixes that one scanned
block of a bucket places are found at once, in the block's order, so the pass is a few array operations a bucket and
round.  Symbols are small non-negative integers; the last one must be 0 and be the only 0.
"""

from __future__ import annotations

import numpy as np

RECURSE_ALPHABET = 2_048  # beyond, a pass has too many buckets, and the reduced string is ranked by doubling


def classify(t: np.ndarray) -> np.ndarray:
    """True for S-type: the suffix is smaller than the one after it; the sentinel is S-type."""
    n = len(t)
    step = np.sign(t[1:].astype(np.int64) - t[:-1])
    # within a run of equal symbols the type is that of the run's end
    nearest = np.where(step != 0, np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    out = np.ones(n, bool)
    inside = nearest < n - 1
    out[:-1][inside] = step[nearest[inside]] > 0
    return out


def _deal(block: np.ndarray, t: np.ndarray, wanted: np.ndarray, parts: list[list[np.ndarray]]) -> None:
    """Append the predecessors of block that are of the wanted type to their buckets, in block order."""
    j = block[block > 0] - 1
    j = j[wanted[j]]
    if not len(j):
        return
    symbol = t[j]
    order = np.argsort(symbol, kind="stable")
    j, symbol = j[order], symbol[order]
    cuts = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(j)]):
        parts[symbol[a]].append(j[a:b])


def induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """Order of all suffixes (as far as the order of ``lms`` determines it), from LMS suffixes sorted within buckets."""
    is_l = ~is_s
    first = t[lms]
    order = np.argsort(first, kind="stable")
    lms, first = lms[order], first[order]
    at = np.searchsorted(first, np.arange(sigma + 1))
    low: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    for c in range(sigma):
        k = 0
        while k < len(low[c]):  # the bucket grows while it is scanned
            _deal(low[c][k], t, is_l, low)
            k += 1
        if at[c] < at[c + 1]:
            _deal(lms[at[c] : at[c + 1]], t, is_l, low)
    high: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    lows: list[np.ndarray | None] = [None] * sigma
    for c in range(sigma - 1, -1, -1):
        k = 0
        while k < len(high[c]):
            _deal(high[c][k], t, is_s, high)
            k += 1
        lows[c] = np.concatenate(low[c]) if low[c] else np.zeros(0, lms.dtype)
        _deal(lows[c][::-1], t, is_s, high)
    out = [np.array([len(t) - 1], lms.dtype)]  # the sentinel precedes all
    for c in range(sigma):
        out.append(lows[c])
        if high[c]:
            out.append(np.concatenate(high[c])[::-1])
    return np.concatenate(out)


def rank_by_doubling(r: np.ndarray) -> np.ndarray:
    """Order of the suffixes of r; its last symbol is its only least one.  Only suffixes still tied are sorted again."""
    n = len(r)
    order = np.argsort(r, kind="stable")
    head = np.where(np.concatenate([[True], r[order][1:] != r[order][:-1]]), np.arange(n), 0)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(head)
    live, k = order, 1
    while len(live) and k < n:
        size = np.bincount(rank[live], minlength=n)
        live = live[size[rank[live]] > 1]
        after = live + k
        key = rank[live] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        live, key = live[by], key[by]
        old, place = rank[live], np.arange(len(live))
        if len(live):
            first = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), place, 0))
            head = np.where(np.concatenate([[True], key[1:] != key[:-1]]), old + place - first, 0)
            rank[live] = np.maximum.accumulate(head)
        k *= 2
    return np.argsort(rank, kind="stable")


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Order of the suffixes of t (symbols under sigma, one final 0)."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    is_s = classify(t)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = is_s[1:] & ~is_s[:-1]
    lms = np.flatnonzero(is_lms)
    # leftmost-smaller substrings in order, then their names
    order = induce(t, is_s, lms, sigma)
    order = order[is_lms[order]]
    end = np.append(lms[1:], n - 1)
    length = np.zeros(n, np.int64)
    length[lms] = end - lms + 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    live, k = np.flatnonzero(same), 0
    while len(live):
        equal = t[a[live] + k] == t[b[live] + k]
        same[live[~equal]] = False
        k += 1
        live = live[equal]
        live = live[length[a[live]] > k]
    name = np.zeros(n, np.int64)
    name[order] = np.concatenate([[0], np.cumsum(~same)])
    reduced = name[lms]
    if reduced.max() + 1 < len(lms):
        names = int(reduced.max()) + 1
        inner = suffix_array(reduced.astype(np.int32), names) if names <= RECURSE_ALPHABET else rank_by_doubling(reduced)
        order = lms[inner]
    return induce(t, is_s, order, sigma)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phi, plcp): by text position, the suffix before it in the order (-1 for the first) and their common length.

    A position whose left symbol equals that of its predecessor's has one less than its left neighbour; only the
    others are compared, four symbols at a time.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    word = np.zeros(n + 4, np.uint64)
    for k in range(min(4, n)):
        word[: n - k] |= t[k:].astype(np.uint64) << np.uint64(16 * k)
    left = np.zeros(n, bool)
    left[1:] = (phi[1:] > 0) & (t[:-1] == t[np.maximum(phi[1:] - 1, 0)])
    whole = np.flatnonzero(~left & (phi >= 0))
    other, length, live, k = phi[whole], np.zeros(len(whole), np.int64), np.arange(len(whole)), 0
    while len(live):
        a = np.minimum(whole[live] + k, n)
        b = np.minimum(other[live] + k, n)
        differ = word[a] ^ word[b]
        done = differ != 0
        d = differ[done]
        short = np.where(d & np.uint64(0xFFFF), 0, np.where(d & np.uint64(0xFFFF0000), 1, np.where(d & np.uint64(0xFFFF00000000), 2, 3)))
        length[live[done]] = k + short
        live = live[~done & (a < n) & (b < n)]
        k += 4
    plcp = np.zeros(n, np.int64)
    plcp[whole] = length
    base = np.where(left, 0, plcp + np.arange(n))
    source = np.maximum.accumulate(np.where(left, 0, np.arange(n)))
    return phi, np.where(left, base[source] - np.arange(n), plcp)


def repeated_starts(contents: list[bytes], length: int, times: list[int] | None = None) -> list[np.ndarray]:
    """For each content, which starts' strings of ``length`` bytes start at another place, too.

    times: how often each content occurs; its suffixes stand for as many in the array, which holds each content once.
    """
    size = np.array([len(c) for c in contents], np.int64)
    joined = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8).astype(np.uint16) + np.uint16(2)
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    joined[begin[1:] - 1] = 1  # what separates contents is no byte
    t = np.append(joined, np.uint16(0))
    sa = suffix_array(t, 258)
    phi, plcp = common_prefixes(t, sa)
    weight = np.append(np.repeat(np.ones(len(contents), np.int64) if times is None else np.array(times), size + 1), 1)
    # neighbours in the order with a common prefix of the length are one string; it repeats if its places sum to two
    fresh = plcp[sa] < length
    string = np.cumsum(fresh) - 1
    mark = np.empty(len(t), bool)
    mark[sa] = np.bincount(string, weight[sa])[string] > 1
    # a string that runs over a separator is of two contents and does not count
    return [mark[a : a + max(0, s - length + 1)] for a, s in zip(begin[:-1].tolist(), size.tolist())]
