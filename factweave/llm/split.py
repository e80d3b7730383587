"""The byte-level pre-tokenizer as a finite-state transducer over many texts at once.

Characters are mapped to classes; a deterministic machine of 12 states reads
them and marks where words begin (at the current or at the previous character,
which is all the lookahead that the split pattern needs). The flat array of all
characters of a batch is cut into chunks; for each chunk the map from any start
state to its end state is computed, the maps are composed by a parallel prefix
scan, and a second pass from the then known start states writes the marks.
"""

from __future__ import annotations

import functools

import numpy as np
import regex

CHUNK = 128
END = 0x110000
# Character classes.
OTHER, LETTER, LAST, R, V, E, K, NUMBER, SPACE, BLANK, QUOTE, STOP, PAD = range(13)
# Machine states.
START, IN_LETTER, IN_NUMBER, IN_OTHER, IN_SPACE, IN_BLANK, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, CONTRACTED = range(11)
HERE, BEFORE = 1, 2


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(END + 1, OTHER, np.uint8)
    for at in range(0, END, 1 << 12):
        if 0xD800 <= at < 0xE000:
            continue
        text = "".join(map(chr, range(at, at + (1 << 12))))
        for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
            out[[ord(c) for c in regex.findall(pattern, text)]] = kind
    for c, kind in (("s", LAST), ("t", LAST), ("m", LAST), ("d", LAST), ("r", R), ("v", V), ("e", E), ("l", K), (" ", SPACE), ("'", QUOTE)):
        out[ord(c)] = kind
    out[END] = STOP
    return out


@functools.cache
def machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state times 16, and marks, by state times 16 plus class."""
    begin = {OTHER: IN_OTHER, QUOTE: QUOTED, NUMBER: IN_NUMBER, SPACE: IN_SPACE, BLANK: IN_BLANK} | dict.fromkeys((LETTER, LAST, R, V, E, K), IN_LETTER)
    letters = {LETTER, LAST, R, V, E, K}
    step, marks = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    for state in range(11):
        for kind in range(13):
            to, mark = begin.get(kind, START), HERE
            if kind == PAD:
                to, mark = state, 0
            elif kind == STOP:
                to, mark = START, BEFORE if state in (QUOTED_R, QUOTED_V, QUOTED_L) else 0
            elif state == IN_LETTER and kind in letters or state == IN_NUMBER and kind == NUMBER:
                mark = 0
            elif state == IN_OTHER and kind in (OTHER, QUOTE):
                to, mark = IN_OTHER, 0
            elif state in (IN_SPACE, IN_BLANK) and kind in (SPACE, BLANK):
                mark = 0
            elif state == IN_SPACE:  # the last space of a run begins the word that follows
                to, mark = IN_OTHER if kind == QUOTE else to, BEFORE
            elif state == IN_BLANK:
                mark = HERE | BEFORE
            elif state == QUOTED and kind in (LAST, R, V, K):
                to, mark = {LAST: CONTRACTED, R: QUOTED_R, V: QUOTED_V, K: QUOTED_L}[kind], 0
            elif state == QUOTED and kind in (OTHER, QUOTE):
                to, mark = IN_OTHER, 0
            elif state in (QUOTED_R, QUOTED_V, QUOTED_L):
                if kind == (K if state == QUOTED_L else E):
                    to, mark = CONTRACTED, 0
                elif kind in letters:  # the quote was a word, the letter after it began one
                    to, mark = IN_LETTER, BEFORE
                else:
                    mark = HERE | BEFORE
            step[state * 16 + kind], marks[state * 16 + kind] = to * 16, mark
    return step, marks


def word_starts(kinds: np.ndarray) -> np.ndarray:
    """For each character (as a class): whether a word begins there."""
    step, marks = machine()
    n = len(kinds)
    rows = max(1, -(-n // CHUNK))
    grid = np.full(rows * CHUNK, PAD, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    # A chunk's map, from each start state to its end state.
    maps = np.repeat((np.arange(11, dtype=np.uint8) * 16)[:, None], rows, axis=1)
    for k in range(CHUNK):
        maps = step.take(maps + grid[k])
    # Parallel prefix scan: after the round with distance d, maps cover 2d chunks.
    d = 1
    while d < rows:
        maps[:, d:] = np.take_along_axis(maps[:, d:], maps[:, :-d] >> 4, axis=0)
        d *= 2
    state = np.r_[np.uint8(START * 16), maps[START, :-1]].astype(np.uint8)
    out = np.empty((CHUNK, rows), np.uint8)
    for k in range(CHUNK):
        at = state + grid[k]
        out[k] = marks.take(at)
        state = step.take(at)
    out = out.T.ravel()[:n]
    begins = (out & HERE).astype(bool)
    begins[:-1] |= (out[1:] & BEFORE).astype(bool)
    return begins


class Words:
    """The words of ``units`` (texts without special strings): ``data[start:end]`` in UTF-8, ``unit`` of each, in order."""

    def __init__(self, units: list[str]):
        size = np.fromiter(map(len, units), np.int64, len(units))
        flat = "".join(units)
        codes = np.insert(np.frombuffer(flat.encode("utf-32-le"), np.uint32), np.cumsum(size), END)
        kinds = classes()[codes]
        begins = word_starts(kinds)
        stop = kinds == STOP
        width = (1 + (codes >= 0x80).astype(np.uint8) + (codes >= 0x800) + (codes >= 0x10000)) * ~stop
        at = np.flatnonzero(begins | stop)
        place = (np.cumsum(width, dtype=np.int64) - width)[at]
        ends = np.r_[place[1:], place[-1:]]
        word = ~stop[at]
        self.data = np.frombuffer(flat.encode("utf-8"), np.uint8)
        self.start, self.end = place[word], ends[word]
        self.unit = (np.cumsum(stop[at]) - stop[at])[word]

    def unique(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of one word of each kind, and for each word the number of its kind."""
        n = len(self.data)
        if not len(self.start):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        odd, back = _powers(n)
        total = np.r_[np.uint64(0), np.cumsum(_salts()[self.data] * odd[:n], dtype=np.uint64)]
        h = (total[self.end] - total[self.start]) * back[self.start]
        h ^= (self.end - self.start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        _, first, kind = np.unique(h, return_index=True, return_inverse=True)
        # Equal sums with unequal bytes would show here; such words become kinds of their own.
        size = self.end - self.start
        off = np.cumsum(size) - size
        inside = np.arange(int(size.sum())) - np.repeat(off, size)
        same_size = size == size[first[kind]]
        rep = np.where(same_size, self.start[first[kind]], self.start)
        differs = self.data[np.repeat(self.start, size) + inside] != self.data[np.repeat(rep, size) + inside]
        wrong = np.unique(np.repeat(np.arange(len(size)), size)[differs]) if differs.any() else np.empty(0, np.int64)
        wrong = np.union1d(wrong, np.flatnonzero(~same_size))
        if len(wrong):
            kind[wrong] = len(first) + np.arange(len(wrong))
            first = np.r_[first, wrong]
        return first, kind


@functools.cache
def _salts() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


_power: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if not _power or len(_power[0]) < n + 1:
        base = 0xD1342543DE82EF95
        with np.errstate(over="ignore"):
            _power[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n, np.uint64(b))], dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64))]
    return _power[0], _power[1]


def units_of(texts: list[str], special: dict[str, int], finder) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts cut at special strings: the units, the text each belongs to, and the special id that follows it (-1: none)."""
    units, owner, after = [], [], []
    for k, t in enumerate(texts):
        at = 0
        if finder is not None and any(s in t for s in special):
            for m in finder.finditer(t):
                units.append(t[at : m.start()])
                owner.append(k)
                after.append(special[m[0]])
                at = m.end()
        units.append(t[at:])
        owner.append(k)
        after.append(-1)
    return units, np.array(owner, np.int64), np.array(after, np.int64)
