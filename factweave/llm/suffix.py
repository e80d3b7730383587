"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as S (smaller than their successor) or L; the leftmost S of
each run (LMS) cut the text into substrings, which are sorted by inducing, named, and
sorted as suffixes by recursion on the names; the order of all suffixes is then
induced from theirs. A scan that induces may go on as long as the slots in front of it are
filled, so it works on runs of filled slots at once instead of on one suffix at a time.
"""

from __future__ import annotations

import numpy as np

RUN = 1 << 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The places of ``text`` (numbers from 0) in the order of the suffixes that begin there."""
    t = np.empty(len(text) + 1, np.int64)
    t[:-1] = text
    t[:-1] += 1
    t[-1] = 0  # ends every suffix before any number
    return _sorted(t)[1:]


def _sorted(t: np.ndarray) -> np.ndarray:
    """``t`` ends with its only and smallest 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _is_small(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induce = _Inducer(t, small)
    order = induce(lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    name_of = np.empty(n, np.int64)
    names = _names(t, lms, order)
    name_of[order] = names
    if names[-1] + 1 < len(order):
        order = lms[_sorted(name_of[lms])]
    return induce(order)


def _is_small(t: np.ndarray) -> np.ndarray:
    """For each place whether its suffix is smaller than the next one; equal numbers do as the place behind them."""
    step = np.sign(np.diff(t))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    at = np.minimum.accumulate(at[::-1])[::-1]
    return np.r_[step[np.minimum(at, len(step) - 1)] > 0, True]


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Numbers of the LMS substrings in ``order``: equal ones get the same."""
    size_of = np.zeros(len(t), np.int64)
    size_of[lms] = np.r_[np.diff(lms), 0] + 1
    size = size_of[order]
    new = np.r_[True, size[1:] != size[:-1]]
    same = np.flatnonzero(~new)
    for at in range(0, len(same), RUN):
        own = same[at : at + RUN]
        width = size[own]
        off = np.cumsum(width) - width
        inside = np.arange(int(width.sum())) - np.repeat(off, width)
        differs = t[np.repeat(order[own], width) + inside] != t[np.repeat(order[own - 1], width) + inside]
        new[own] = np.logical_or.reduceat(differs, off)
    return np.cumsum(new) - 1


class _Inducer:
    """Sorts all suffixes of a text, given its LMS suffixes in order (or, to sort LMS substrings, in any order)."""

    def __init__(self, t: np.ndarray, small: np.ndarray):
        self.t, self.small = t, small
        top = int(t.max()) + 1
        large = np.bincount(t[~small], minlength=top)
        count = np.bincount(t, minlength=top)
        self.end = np.cumsum(count)
        self.begin = self.end - count
        self.middle = self.begin + large
        slots = np.empty(2 * top, np.int64)
        slots[0::2], slots[1::2] = large, count - large
        self.large_slot = np.repeat(np.arange(2 * top) % 2 == 0, slots)

    def __call__(self, lms: np.ndarray) -> np.ndarray:
        t, small, n = self.t, self.small, len(self.t)
        sa = np.full(n, -1, np.int64)
        kind = t[lms]
        by = np.argsort(kind, kind="stable")
        kind = kind[by]
        last = np.searchsorted(kind, kind, "right")
        sa[self.end[kind] - (last - np.arange(len(kind)))] = lms[by]
        head = self.begin.copy()
        at, run = 0, RUN
        while at < n:
            got = sa[at : at + run]
            barrier = (got < 0) & self.large_slot[at : at + run]
            stop = int(barrier.argmax()) or len(got)
            got = got[:stop]
            at, run = at + stop, min(RUN, 2 * stop + 64)
            before = got[got > 0] - 1
            before = before[~small[before]]
            self._put(sa, before, head, 1)
        sa[~self.large_slot] = -1
        tail = self.end - 1
        at, run = n, RUN
        while at > 0:
            low = max(0, at - run)
            got = sa[low:at][::-1]
            barrier = (got < 0) & ~self.large_slot[low:at][::-1]
            barrier[0] = False  # only the end mark's slot, the very first, is not filled by a suffix behind it
            stop = int(barrier.argmax()) or len(got)
            got = got[:stop]
            at, run = at - stop, min(RUN, 2 * stop + 64)
            before = got[got > 0] - 1
            before = before[small[before]]
            self._put(sa, before, tail, -1)
        sa[0] = n - 1
        return sa

    def _put(self, sa: np.ndarray, before: np.ndarray, free: np.ndarray, step: int) -> None:
        """Each of ``before`` into the next free slot of its number."""
        if not len(before):
            return
        kind = self.t[before]
        by = kind.argsort(kind="stable")
        kind = kind[by]
        new = np.empty(len(kind), bool)
        new[0] = True
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        place = np.arange(len(kind))
        slot = free[kind] + step * (place - np.maximum.accumulate(np.where(new, place, 0)))
        sa[slot] = before[by]
        free[kind] = slot + step  # of equal numbers the last one stays


def common_prefixes(data: np.ndarray, order: np.ndarray, begins: np.ndarray, most: int) -> np.ndarray:
    """By place: how many bytes its suffix shares with the one in front of it in ``order``.

    Lengths of over ``most`` within a segment may be given as less, but not below what is left
    of the segment if that is ``most`` at most; ``begins`` are the places where segments begin. Where the bytes
    in front of two neighbours are equal, the length is one less than at the place before, so only
    the other places (and those where segments begin) are compared.
    """
    n = len(data)
    front = np.empty(n, np.int64)
    front[order[1:]], front[order[0]] = order[:-1], -1
    fresh = np.ones(n, bool)
    both = np.flatnonzero((front > 0) & (np.arange(n) > 0))
    fresh[both] = data[both - 1] != data[front[both] - 1]
    fresh[begins] = True
    own = np.flatnonzero(fresh & (front >= 0))
    padded = np.r_[data, np.zeros(16, np.uint8)]
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    length = np.zeros(n, np.int64)
    a, b, live = own, front[own], own
    for done in range(0, 2 * most, 8):
        a_word, b_word = np.ascontiguousarray(eight[np.minimum(a + done, n)]).view("<u8").ravel(), np.ascontiguousarray(eight[np.minimum(b + done, n)]).view("<u8").ravel()
        differs = a_word ^ b_word
        same = differs == 0
        low = differs & (~differs + np.uint64(1))
        end = ~same
        length[live[end]] = done + (np.bitwise_count(low[end] - np.uint64(1)).astype(np.int64) >> 3)
        length[live[same]] = done + 8
        a, b, live = a[same], b[same], live[same]
        if not len(live):
            break
    reach = np.where(fresh, np.arange(n), 0)
    last = np.maximum.accumulate(reach)
    return np.maximum(length[last] - (np.arange(n) - last), 0)


def repeated(data: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """For each place of ``data``: whether the ``size`` bytes from there lie in its segment and also begin elsewhere in one.

    Segments begin at ``begins``, each with its end mark, a byte that occurs nowhere else in them.
    """
    if not len(data):
        return np.empty(0, bool)
    order = suffix_array(data)
    ends = np.r_[begins[1:], len(data)] - 1
    width = ends + 1 - begins
    shared = common_prefixes(data, order, begins, int(max(width.max(), size)))
    near = shared[order] >= size
    out = np.empty(len(data), bool)
    out[order] = near | np.r_[near[1:], False]
    return out & (np.repeat(ends, width) - np.arange(len(data)) >= size)
