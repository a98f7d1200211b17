"""Suffix arrays of one shard by induced sorting, and their permuted common prefixes (NumPy arrays throughout).

The scans of induced sorting go bucket by bucket: what a bucket induces is
found, and put behind the fronts of its target buckets, for all its suffixes at
once; a bucket that induces into itself takes another round. The names of the
leftmost-smaller (LMS) substrings are written as two digits of a small
alphabet, so that the reduced text has few buckets too and is sorted in the
same way.
"""

from __future__ import annotations

import numpy as np

DIRECT_SYMBOLS = 1 << 10


def pack(text: np.ndarray) -> tuple[np.ndarray, int]:
    """For every place the next symbols as one 64-bit number (0 beyond the end), and how many they are."""
    bits = 8 * text.itemsize
    per = 64 // bits
    padded = np.concatenate([text, np.zeros(per, text.dtype)])
    words = np.zeros(len(text), np.uint64)
    for k in range(per):
        words |= padded[k : k + len(text)].astype(np.uint64) << np.uint64(bits * k)
    return words, per


class _Induce:
    """One text's types and buckets; sorts its suffixes from its sorted LMS suffixes."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        self.text, self.symbols = text, symbols
        turn = np.flatnonzero(text[1:] != text[:-1])
        smaller = np.zeros(n, bool)  # S-type: smaller than the suffix behind it
        smaller[: turn[-1] + 1 if len(turn) else 0] = np.repeat(text[turn] < text[turn + 1], np.diff(turn, prepend=-1))
        self.smaller = smaller
        self.lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
        self.count = np.bincount(text, minlength=symbols)
        self.end = np.cumsum(self.count)
        self.start = self.end - self.count
        self.larger = np.bincount(text[~smaller], minlength=symbols)

    def _deal(self, sa: np.ndarray, front: np.ndarray, at: np.ndarray, kind: bool, step: int) -> None:
        """Puts the predecessors of type ``kind`` of the suffixes ``at`` at their buckets' fronts, in order."""
        before = at[at > 0] - 1
        before = before[self.smaller[before] == kind]
        if not len(before):
            return
        key = self.text[before]
        order = np.argsort(key, kind="stable")
        key = key[order]
        n = np.bincount(key, minlength=self.symbols)
        within = np.arange(len(key)) - (np.cumsum(n) - n)[key]
        sa[front[key] + step * within - (step < 0)] = before[order]
        front += step * n

    def suffixes(self, lms: np.ndarray) -> np.ndarray:
        """The suffix array, if ``lms`` has the LMS suffixes in order (else all that their buckets' order can tell)."""
        sa = np.empty(len(self.text), np.int32)
        front = self.start.copy()
        last = len(self.text) - 1
        sa[front[self.text[last]]] = last
        front[self.text[last]] += 1
        bound = np.searchsorted(self.text[lms], np.arange(self.symbols + 1))
        used = np.flatnonzero(self.count)
        for c in used:
            done = self.start[c]
            while done < front[c]:
                here = sa[done : front[c]]
                done = front[c]
                self._deal(sa, front, here, False, 1)
            if bound[c] < bound[c + 1]:
                self._deal(sa, front, lms[bound[c] : bound[c + 1]], False, 1)
        front = self.end.copy()
        for c in used[::-1]:
            done = self.end[c]
            while done > front[c]:
                here = sa[front[c] : done][::-1]
                done = front[c]
                self._deal(sa, front, here, True, -1)
            if self.larger[c]:
                self._deal(sa, front, sa[self.start[c] : self.start[c] + self.larger[c]][::-1], True, -1)
        return sa


def _names(text: np.ndarray, lms: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings in text order; equal substrings (neighbours in ``ranked``) share one."""
    words, per = pack(text)
    bits = 64 // per
    length = np.append(np.diff(lms) + 1, 0)  # the last one ends with the text: equal to none
    size = np.zeros(len(text), np.int64)
    size[lms] = length
    a, b = ranked[:-1], ranked[1:]
    same = (size[a] == size[b]) & (size[a] > 0)
    live, done = np.flatnonzero(same), 0
    while len(live):
        left = np.minimum(size[a[live]] - done, per)
        keep = np.where(left == per, ~np.uint64(0), (np.uint64(1) << (left % per * bits).astype(np.uint64)) - np.uint64(1))
        equal = ((words[a[live] + done] ^ words[b[live] + done]) & keep) == 0
        same[live[~equal]] = False
        live = live[equal & (size[a[live]] - done > per)]
        done += per
    name = np.empty(len(text), np.int64)
    name[ranked] = np.concatenate([[0], np.cumsum(~same)])
    return name[lms]


def _doubling(name: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling, for a reduced text that two digits would not shorten."""
    rank, step = name, 1
    while True:
        behind = np.append(rank[step:] + 1, np.zeros(min(step, len(rank)), np.int64))
        pair = rank * (int(rank.max()) + 2) + behind
        order = np.argsort(pair, kind="stable")
        new = np.empty_like(rank)
        new[order] = np.concatenate([[0], np.cumsum(pair[order][1:] != pair[order][:-1])])
        if new[order[-1]] == len(name) - 1:
            return order
        rank, step = new, 2 * step


def suffix_array(text: np.ndarray, symbols: int = 256) -> np.ndarray:
    """Starts of the suffixes of ``text`` (symbols 0 to symbols - 1, 8 or 16 bits) in order; a prefix sorts first."""
    if len(text) < 2:
        return np.zeros(len(text), np.int32)
    t = _Induce(text, symbols)
    if len(t.lms) < 2:
        return t.suffixes(t.lms)
    by_symbol = t.lms[np.argsort(text[t.lms], kind="stable")]
    sa = t.suffixes(by_symbol)
    is_lms = np.zeros(len(text), bool)
    is_lms[t.lms] = True
    ranked = sa[is_lms[sa]]
    name = _names(text, t.lms, ranked)
    kinds = int(name.max()) + 1
    if kinds == len(name):
        return t.suffixes(ranked)
    if kinds <= DIRECT_SYMBOLS:
        order = suffix_array(name.astype(np.uint16), kinds)
    elif 10 * len(name) <= 4 * len(text):
        base = int(np.ceil(np.sqrt(kinds)))
        digits = np.stack([name // base, name % base], 1).ravel().astype(np.uint16)
        sub = suffix_array(digits, base)
        order = sub[sub % 2 == 0] // 2
    else:
        order = _doubling(name)
    return t.suffixes(t.lms[order])


def permuted_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For every place the length of its suffix's common prefix with the suffix before it in ``sa`` (8-bit text).

    Only irreducible values, where the symbols before the two suffixes differ,
    are compared; each of the others is one less than its left neighbour's.
    """
    n = len(text)
    prior = np.full(n, -1, np.int64)
    prior[sa[1:]] = sa[:-1]
    place = np.arange(n)
    open_ = (prior <= 0) | (place == 0)
    open_[1:] |= text[:-1] != text[np.maximum(prior[1:], 1) - 1]
    a = np.flatnonzero(open_)
    b = prior[a]
    first = b < 0
    words, per = pack(text)
    length = np.zeros(len(a), np.int64)
    live = np.flatnonzero(~first)
    while len(live):
        x, y = a[live] + length[live], b[live] + length[live]
        inside = np.maximum(x, y) < n
        live, x, y = live[inside], x[inside], y[inside]
        differ = words[x] ^ words[y]
        low = differ & (~differ + np.uint64(1))
        length[live] += np.where(differ == 0, per, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64)
        live = live[differ == 0]
    length = np.where(first, 0, np.minimum(length, n - np.maximum(a, b)))
    last = np.zeros(n, np.int64)
    last[a] = a
    last = np.maximum.accumulate(last)
    value = np.zeros(n, np.int64)
    value[a] = length
    return value[last] + last - place
