"""Suffix arrays by induced sorting, a bucket at a time."""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced bucket by bucket; larger ones (of names) are sorted by doubling.
ALPHABET = 4096


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix of s is smaller than the next one; s ends in a sentinel."""
    n = len(s)
    step = np.sign(np.diff(s.astype(np.int32))).astype(np.int8)
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return np.concatenate([np.concatenate([step, [1]])[at] > 0, [True]])


def _deal(j: np.ndarray, char: np.ndarray, to: list[list[np.ndarray]]) -> None:
    """Appends positions to the chunks of their characters, in their order."""
    if not len(j):
        return
    order = np.argsort(char, kind="stable")
    j, char = j[order], char[order]
    first = np.flatnonzero(np.concatenate([[True], char[1:] != char[:-1]]))
    for c, a, b in zip(char[first].tolist(), first.tolist(), [*first[1:].tolist(), len(j)], strict=True):
        to[c].append(j[a:b])


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The order of all suffixes from an order of the leftmost-smaller ones."""
    seeds: list[list[np.ndarray]] = [[] for _ in range(k)]
    _deal(lms, s[lms], seeds)
    none = np.zeros(0, lms.dtype)
    large: list[list[np.ndarray]] = [[] for _ in range(k)]
    for c in range(k):
        at = 0
        while at < len(large[c]):
            new = np.concatenate(large[c][at:])
            at = len(large[c])
            j = new[new > 0] - 1
            j = j[~small[j]]
            char = s[j]
            same = char == c
            if same.any():
                large[c].append(j[same])
                j, char = j[~same], char[~same]
            _deal(j, char, large)
        if seeds[c]:
            j = np.concatenate(seeds[c])
            j = j[j > 0] - 1
            _deal(j, s[j], large)
    lower: list[list[np.ndarray]] = [[] for _ in range(k)]  # from the end of each bucket
    done: list[np.ndarray] = []
    for c in range(k - 1, -1, -1):
        at = 0
        while at < len(lower[c]):
            new = np.concatenate(lower[c][at:])
            at = len(lower[c])
            j = new[new > 0] - 1
            j = j[small[j]]
            char = s[j]
            same = char == c
            if same.any():
                lower[c].append(j[same])
                j, char = j[~same], char[~same]
            _deal(j, char, lower)
        left = np.concatenate(large[c]) if large[c] else none
        j = left[::-1]
        j = j[j > 0] - 1
        j = j[small[j]]
        _deal(j, s[j], lower)
        if lower[c]:
            done.append(np.concatenate(lower[c])[::-1])
        elif c == 0:
            done.append(np.array([len(s) - 1], lms.dtype))  # the sentinel is in no one's bucket but its own
        done.append(left)
        large[c] = []
    return np.concatenate(done[::-1])


def _doubled(s: np.ndarray) -> np.ndarray:
    """The order of suffixes by doubling; only what is undecided is sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    v = s[order]
    new = np.concatenate([[True], v[1:] != v[:-1]])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = head
    h = 1
    while True:
        last = np.concatenate([new[1:], [True]])
        open_ = np.flatnonzero(~(new & last))
        if not len(open_):
            return order
        items = order[open_]
        group, then = rank[items], rank[np.minimum(items + h, n)]
        by = np.lexsort((then, group))
        items, group, then = items[by], group[by], then[by]
        order[open_] = items
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (then[1:] != then[:-1])])
        new[open_] = fresh
        rank[items] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(items)), 0))]
        h *= 2


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffixes of s in order. s is a row of numbers above 0 and ends in its only 0."""
    n, k = len(s), int(s.max(initial=0)) + 1
    if k > ALPHABET or n < 64:
        return _doubled(s.astype(np.int64))
    s = s.astype(np.uint16)
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    lms = lms.astype(np.int32)
    if not len(lms):
        return _doubled(s.astype(np.int64))
    mark = np.zeros(n, bool)
    mark[lms] = True
    rough = _induce(s, small, lms, k)
    rough = rough[mark[rough]]
    # name leftmost-smaller substrings, equal ones alike; each runs to the start of the next one
    size = np.zeros(n, np.int32)
    size[lms] = np.diff([*lms, n - 1]) + 1
    a, b = rough[:-1], rough[1:]
    same = size[a] == size[b]
    live, o = np.flatnonzero(same), 0
    while len(live):
        live = live[size[a[live]] > o]
        if not len(live):
            break
        differ = s[a[live] + o] != s[b[live] + o]
        same[live[differ]] = False
        live = live[~differ]
        o += 1
    names = np.concatenate([[0], np.cumsum(~same)])
    name = np.empty(n, np.int64)
    name[rough] = names
    if names[-1] + 1 == len(lms):
        order = rough
    else:
        order = lms[suffix_array(name[lms])] if names[0] == 0 and name[lms[-1]] == 0 else rough
    return _induce(s, small, order, k)


def shares_prefix(text: np.ndarray, order: np.ndarray, length: int, together: int = 1 << 20) -> np.ndarray:
    """For each place of the order: whether its suffix and the one before in the order share so many symbols.

    Common prefixes are permuted: worked out in the order of the text, where reads are near each other, eight symbols at
    a time and so many suffixes together. The order may leave suffixes out; text are bytes, padded by length + 8 zeros.
    """
    before = np.full(len(text), -1, np.int32)
    before[order[1:]] = order[:-1]
    word, have = text, 1
    if length >= 8:
        word = text.astype(np.uint64)
        while have < 8:
            word = word[:-have] | (word[have:] << np.uint64(8 * have))
            have *= 2
    steps = [*range(0, length - 8, 8), length - 8] if length >= 8 else range(length)
    equal = np.zeros(len(text), bool)
    for begin in range(0, len(text), together):
        here = np.flatnonzero(before[begin : begin + together] >= 0) + begin
        there = before[here]
        for o in steps:
            m = word[here + o] == word[there + o]
            here, there = here[m], there[m]
        equal[here] = True
    return equal[order]
