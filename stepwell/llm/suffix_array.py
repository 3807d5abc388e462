"""Suffix arrays of byte strings by induced sorting, and permuted common prefixes, in numpy.

The text is that of one shard.  Suffixes are of type S (smaller than their successor) or L.
Leftmost S suffixes cut the text into substrings; one induction over the byte buckets sorts
these, they are named in order, the string of names is sorted in turn, and a second
induction over the buckets places all suffixes.  An induction visits each suffix once and
handles a whole bucket at a time.
"""

from __future__ import annotations

import numpy as np

from stepwell.llm.textkit import take_spans


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes, with one more entry for the empty suffix."""
    n = len(text)
    s = np.zeros(n + 1, bool)
    s[n] = True
    if n > 1:
        step = np.zeros(n, np.int8)
        step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
        step[-1] = -1
        # runs of one byte take the type of the run's end
        at = np.where(step != 0, np.arange(n), n)
        following = np.minimum.accumulate(at[::-1])[::-1]
        s[:n] = step[following] > 0
    return s


def _induce(text: np.ndarray, s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Suffix order induced from leftmost S suffixes given in order within each byte."""
    n = len(text)
    chars = np.flatnonzero(np.bincount(text, minlength=256))
    lefts: list[list[np.ndarray]] = [[] for _ in range(256)]
    rights: list[list[np.ndarray]] = [[] for _ in range(256)]
    none = np.zeros(0, np.int64)

    def deal(into, suffixes):
        if len(suffixes) == 0:
            return
        first = text[suffixes]
        order = np.argsort(first, kind="stable")
        sizes = np.bincount(first, minlength=256)
        at = 0
        ordered = suffixes[order]
        for c in np.flatnonzero(sizes):
            into[c].append(ordered[at : at + sizes[c]])
            at += sizes[c]

    def before(suffixes, small):
        """Preceding suffixes of the wanted type, in order."""
        left = suffixes[suffixes > 0] - 1
        return left[s[left] == small]

    seeded: list[list[np.ndarray]] = [[] for _ in range(256)]
    deal(seeded, seeds[seeds < n])
    if n:
        # the empty suffix comes first; the last one precedes it
        deal(lefts, np.array([n - 1]) if not s[n - 1] else none)
    for c in chars:
        wave = np.concatenate(lefts[c]) if lefts[c] else none
        whole = []
        while len(wave):
            whole.append(wave)
            left = before(wave, False)
            same = text[left] == c
            deal(lefts, left[~same])
            wave = left[same]
        lefts[c] = [np.concatenate(whole)] if whole else []
        if seeded[c]:
            deal(lefts, before(np.concatenate(seeded[c]), False))
    for c in chars[::-1]:
        wave = np.concatenate(rights[c]) if rights[c] else none
        whole = []
        while len(wave):
            whole.append(wave)
            left = before(wave, True)
            same = text[left] == c
            deal(rights, left[~same])
            wave = left[same]
        rights[c] = whole
        if lefts[c]:
            deal(rights, before(lefts[c][0][::-1], True))
    parts = []
    for c in chars:
        parts += lefts[c]
        if rights[c]:
            parts.append(np.concatenate(rights[c])[::-1])
    return np.concatenate(parts) if parts else none


def _order_names(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string of numbers: name ever longer pieces until names differ."""
    n = len(names)
    rank = names.astype(np.int64)
    length = 1
    while True:
        tail = np.zeros(n, np.int64)
        tail[: n - length] = rank[length:] + 1
        key = rank * (n + 2) + tail
        order = np.argsort(key, kind="stable")
        fresh = np.ones(n, bool)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if fresh.all():
            return order
        length *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all non-empty suffixes in order."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    s = suffix_types(text)
    leftmost = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    inner = leftmost[leftmost < n]
    if len(inner) < 2:
        return _induce(text, s, inner)
    once = _induce(text, s, inner)
    is_leftmost = np.zeros(n + 1, bool)
    is_leftmost[inner] = True
    ordered = once[is_leftmost[once]]
    # name the substrings between leftmost suffixes; neighbours are compared byte by byte
    end = np.empty(n + 1, np.int64)
    end[inner] = np.append(inner[1:], n - 1) + 1
    lengths = end[ordered] - ordered
    last = ordered == inner[-1]
    fresh = np.ones(len(ordered), bool)
    like = np.flatnonzero((lengths[1:] == lengths[:-1]) & ~last[1:] & ~last[:-1])
    if len(like):
        size = lengths[like]
        a, b = take_spans(text, ordered[like], size), take_spans(text, ordered[like + 1], size)
        first = np.cumsum(size) - size
        fresh[like + 1] = np.add.reduceat((a != b).astype(np.int64), first) > 0
    name = np.empty(n + 1, np.int64)
    name[ordered] = np.cumsum(fresh) - 1
    if not fresh.all():
        ordered = inner[_order_names(name[inner])]
    return _induce(text, s, ordered)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length that each suffix shares with the one before it in ``order``, by rank.

    Worked out in text order: where a suffix and its predecessor are preceded by the same
    byte, the value is one less than that of the suffix to the left.  The others are
    compared directly, eight bytes at a time.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    known = before >= 0
    plain = known & (place > 0) & (before > 0)
    follows = np.zeros(n, bool)
    at = np.flatnonzero(plain)
    follows[at] = (text[at - 1] == text[before[at] - 1]) & (before[at - 1] == before[at] - 1)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    words = np.zeros(n, np.uint64)
    for j in range(8):
        words |= padded[j : n + j] << np.uint64(8 * (7 - j))
    length = np.zeros(n, np.int64)
    active = np.flatnonzero(known & ~follows)
    while len(active):
        x, y = active + length[active], before[active] + length[active]
        inside = (x < n) & (y < n)
        active, x, y = active[inside], x[inside], y[inside]
        room = n - np.maximum(x, y)
        differ = words[x] ^ words[y]
        equal = np.where(differ == 0, 8, 7 - _high_byte(differ))
        step = np.minimum(equal, room)
        length[active] += step
        active = active[(differ == 0) & (room > 8)]
    # the chain to the right of each compared suffix
    source = np.maximum.accumulate(np.where(follows, 0, place))
    permuted = np.maximum(length[source] - (place - source), 0)
    permuted[~known] = 0
    return permuted[order]


def _high_byte(x: np.ndarray) -> np.ndarray:
    """Place of the highest byte that is not zero."""
    out = np.zeros(len(x), np.int64)
    for shift in (32, 16, 8):
        big = x >= np.uint64(1) << np.uint64(shift)
        out[big] += shift // 8
        x = np.where(big, x >> np.uint64(shift), x)
    return out
