"""Suffix arrays by Larsson-Sadakane refinement and common prefixes by Kasai's lemma, in numpy."""

from __future__ import annotations

import numpy as np


def byte_words(data: np.ndarray) -> np.ndarray:
    """A view that holds, for each place, the eight bytes from it as one big-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), ">u8", buffer=padded, strides=(1,))


def _ordered(*parts: np.ndarray, bits: int) -> np.ndarray:
    """Order of the rows by parts, the first part first; each part is below 2**bits and not negative.

    Where parts and row numbers fit one 63-bit number, the numbers themselves are sorted, which numpy does much faster
    than an indirect sort.
    """
    n = len(parts[0])
    if bits * (len(parts) + 1) <= 63:
        key = parts[0].astype(np.int64)
        for x in (*parts[1:], np.arange(n)):
            key <<= bits
            key |= x
        key.sort()
        key &= (1 << bits) - 1
        return key
    return np.lexsort(parts[::-1])


def suffix_array(data: np.ndarray, depth: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sa, rank, tied) of a byte array: the suffixes in order, each suffix's place among them, and at which places of
    sa a suffix may share `depth` bytes or more with its predecessor (they were one group in a round at or above it).

    A suffix's rank is the first place of its group. Suffixes are first sorted by a few bytes; each round then sorts
    the groups that are left by the ranks h bytes further on and doubles h. Suffixes alone in their group are done. With
    a depth the rounds end once h reaches it: suffixes that agree in h bytes then stay in text order.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    place = np.int32 if n < 2**31 - 1 else np.int64  # half the bytes to fetch from places all over the text
    bits = int(n + 1).bit_length()
    present = np.bincount(data, minlength=256) > 0
    symbol = np.cumsum(present)  # 0 is left for what lies beyond the end
    width = max(int(symbol[-1]).bit_length(), 1)
    h = min((63 - bits) // width, depth or 64)
    code = np.concatenate([symbol[data], np.zeros(h, np.int64)])
    sorted_key = code[:n].copy()
    for k in range(1, h):
        sorted_key <<= width
        sorted_key |= code[k : n + k]
    sorted_key <<= bits
    sorted_key |= np.arange(n)
    sorted_key.sort()
    sa = (sorted_key & ((1 << bits) - 1)).astype(place)
    sorted_key >>= bits
    head = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    del code, sorted_key
    places = np.arange(n, dtype=place)
    group = np.maximum.accumulate(np.where(head, places, place(0)))
    rank = np.full(n + 1, -1, place)  # beyond the end: below all others
    rank[sa] = group
    started = False
    while True:
        same = group[1:] == group[:-1]
        left = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        if h <= depth or not started:
            tied = np.zeros(n, bool)
            tied[places[1:][same]] = True
            started = True
        if not len(left) or (depth and h >= depth):
            return sa, rank[:n], tied
        places, group = places[left], group[left]
        at = sa[places]
        after = rank[np.minimum(at.astype(np.int64) + h, n)] + place(1)
        order = _ordered(group, after, bits=bits)
        at, after = at[order], after[order]  # groups lie one after the other: their column stays as it is
        sa[places] = at
        first = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        group = places[np.maximum.accumulate(np.where(first, np.arange(len(at), dtype=place), place(0)))]
        rank[at] = group
        h *= 2


def common_prefixes(data: np.ndarray, sa: np.ndarray, tied: np.ndarray | None = None) -> np.ndarray:
    """lcp[k]: bytes that suffixes sa[k - 1] and sa[k] share from their start (lcp[0] is 0); 0 where tied is False.

    By Kasai's lemma a suffix's common prefix with its predecessor is that of the suffix one byte to its left less one,
    if that one's predecessor is the predecessor's left neighbour and both have the same first byte. Only the other
    suffixes are compared, by words of eight bytes. The suffixes may be sorted to some depth only.
    """
    n = len(data)
    lcp = np.zeros(n, np.int64)
    places = np.arange(1, n) if tied is None else np.flatnonzero(tied)
    if not len(places):
        return lcp
    before = np.full(n + 1, -2, np.int64)  # a suffix's predecessor; the last entry stands for the suffix left of the first
    before[sa[places]] = sa[places - 1]
    x = np.flatnonzero(before[:n] >= 0)  # in text order
    y = before[x]
    inner = (before[x - 1] == y - 1) & (y > 0) & (data[x - 1] == data[y - 1])
    open_ = np.flatnonzero(~inner)
    a, b = x[open_], y[open_]
    got = np.zeros(len(a), np.int64)
    words = byte_words(np.concatenate([data, np.zeros(8, np.uint8)]))
    live, reach = np.arange(len(a)), 1
    while len(live):
        ahead = got[live][:, None] + 8 * np.arange(reach)  # a few words at first, more for the long prefixes
        diff = words[np.minimum(a[live][:, None] + ahead, n)].astype(np.uint64) ^ words[np.minimum(b[live][:, None] + ahead, n)].astype(np.uint64)
        first = (diff != 0).argmax(axis=1)
        at = diff[np.arange(len(live)), first]
        some = sum((at < np.uint64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8))
        got[live] += np.where(at != 0, 8 * first + some, 8 * reach)
        live = live[(at == 0) & (np.maximum(a[live], b[live]) + got[live] < n)]
        reach = min(2 * reach, 256)
    own = np.zeros(len(x), np.int64)
    own[open_] = np.minimum(got, n - np.maximum(a, b))
    # An inner suffix has the value of the nearest compared one to its left, less the distance.
    source = np.maximum.accumulate(np.where(inner, 0, np.arange(len(x))))
    out = np.zeros(n, np.int64)
    out[x] = own[source] - (x - x[source])
    lcp[places] = out[sa[places]]
    return lcp
