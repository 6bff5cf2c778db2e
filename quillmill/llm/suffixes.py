"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

`suffix_array` classifies suffixes as larger (L) or smaller (S) than their right neighbour, sorts the
leftmost-smaller substrings by one round of inducing, names them, orders the string of names by recursion
and induces the whole array from that order. Inducing goes bucket by bucket; within a bucket it handles all
entries at once, so each symbol costs a constant number of vector steps. Where the alphabet of names is wide, each name
is written as two digits of a small alphabet, and the recursion goes on with the string of digits, down to strings
so short that they are sorted directly.
"""

from __future__ import annotations

import numpy as np

#: Wider alphabets are written in two digits.
WIDE = 1024
#: The recursion ends with strings of up to so many symbols, which are sorted directly.
SMALL = 1 << 16


def classify(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last symbol must be the smallest and unique."""
    ends = np.flatnonzero(t[:-1] != t[1:])
    smaller = np.append(t[ends] < t[ends + 1], True)
    return np.repeat(smaller, np.diff(np.concatenate([[-1], ends, [len(t) - 1]])))


def induce(t: np.ndarray, leftmost: np.ndarray, n_symbols: int) -> np.ndarray:
    """The suffix array that follows from an order of the leftmost-smaller suffixes (grouped by first symbol, ascending).

    Larger suffixes fill their symbol's bucket from its start, smaller ones from its end.
    """
    counts = np.bincount(t, minlength=n_symbols)
    ends = np.cumsum(counts)
    starts = ends - counts
    edges = np.searchsorted(t[leftmost], np.arange(n_symbols + 1))
    out = np.empty(len(t), dtype=np.int32)
    head, tail, numbers = starts.copy(), ends.copy(), np.arange(len(t))

    def place(at: np.ndarray, symbols: np.ndarray, down: bool) -> None:
        """Each position behind those that its bucket holds already, in the order given."""
        n = len(at)
        if n == 1:
            c = symbols[0]
            if down:
                tail[c] -= 1
                out[tail[c]] = at[0]
            else:
                out[head[c]] = at[0]
                head[c] += 1
        elif n:
            order = symbols.argsort(kind="stable")
            symbols = symbols[order]
            edge = np.empty(n + 1, dtype=bool)
            edge[0] = edge[n] = True
            np.not_equal(symbols[1:], symbols[:-1], out=edge[1:n])
            first = edge.nonzero()[0]
            size = first[1:] - first[:-1]
            names = symbols[first[:-1]]
            if down:
                out[(tail[names] - 1 + first[:-1]).repeat(size) - numbers[:n]] = at[order]
                tail[names] -= size
            else:
                out[(head[names] - first[:-1]).repeat(size) + numbers[:n]] = at[order]
                head[names] += size

    for c in range(n_symbols):
        done = starts[c]
        while done < head[c]:
            now, done = out[done : head[c]], head[c]
            before = now - 1  # of the first suffix, the last symbol, which is smaller than any other
            symbols = t.take(before)
            kept = (symbols >= c).nonzero()[0]
            place(before.take(kept), symbols.take(kept), False)
        before = leftmost[edges[c] : edges[c + 1]]
        before = before[before > 0] - 1
        place(before, t.take(before), False)
    place(np.array([len(t) - 1], dtype=np.int32), t[-1:], True)
    for c in range(n_symbols - 1, -1, -1):
        done = ends[c]
        while done > tail[c]:
            now, done = out[tail[c] : done][::-1], tail[c]
            before = now[now > 0] - 1
            symbols = t.take(before)
            kept = (symbols <= c).nonzero()[0]
            place(before.take(kept), symbols.take(kept), True)
        before = out[starts[c] : head[c]][::-1]
        before = before[before > 0] - 1
        symbols = t.take(before)
        kept = (symbols < c).nonzero()[0]
        place(before.take(kept), symbols.take(kept), True)
    return out


def name_substrings(t: np.ndarray, at: np.ndarray, sorted_at: np.ndarray) -> np.ndarray:
    """Names of the leftmost-smaller substrings that start at sorted_at; equal ones, which are neighbours, share a name."""
    length = np.zeros(len(t), dtype=np.int64)
    length[at] = np.append(np.diff(at) + 1, 1)
    a, b = sorted_at[:-1], sorted_at[1:]
    same = length[a] == length[b]
    left, k = np.flatnonzero(same), 0
    words = t.astype(np.uint64)
    for i in range(1, min(4, len(t))):
        words[:-i] |= t[i:].astype(np.uint64) << np.uint64(16 * i)
    a, b, length = a[left], b[left], length[a[left]]
    while len(left):
        # Four symbols at a time; those beyond the end are shifted out.
        beyond = np.maximum(4 - (length - k), 0).astype(np.uint64) * np.uint64(16)
        equal = (words[a + k] ^ words[b + k]) << beyond == 0
        same[left[~equal]] = False
        k += 4
        on = (equal & (length > k)).nonzero()[0]
        left, a, b, length = left[on], a[on], b[on], length[on]
    return np.concatenate([[0], np.cumsum(~same)])


def in_digits(names: np.ndarray, n_names: int) -> tuple[np.ndarray, int]:
    """Each name but the last (the only 0) as two digits, then 0; and the number of symbols.

    Digits are a pair for each name, so suffixes that start with a first digit are in the order of the names' suffixes.
    """
    base = int(np.ceil(np.sqrt(n_names)))
    out = np.zeros(2 * len(names) - 1, dtype=np.int64)
    out[:-1:2], out[1::2] = names[:-1] // base + 1, names[:-1] % base + 1
    return out, base + 1


def directly(t: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of a short string in the order of their first `depth` symbols, each of which stands for a byte or more."""
    size = t.dtype.newbyteorder(">").itemsize
    raw = np.concatenate([t, np.zeros(depth, t.dtype)]).astype(t.dtype.newbyteorder(">")).tobytes()
    return np.array(sorted(range(len(t)), key=[raw[i * size : (i + depth) * size] for i in range(len(t))].__getitem__))


def suffix_array(t: np.ndarray, n_symbols: int, depth: int | None = None, offset: np.ndarray | None = None) -> np.ndarray:
    """The suffixes of t in order (of their first `depth` bytes at least); t ends with its only 0, its symbols are below n_symbols.

    offset: where in the text of the first call each symbol starts. Names are open if they occur twice or more and stand for
    less than `depth` bytes; recursion goes on with the open names and the one behind each run of them.
    """
    if len(t) < 3:
        return np.arange(len(t))[::-1]
    if offset is not None and depth is not None and len(t) <= SMALL:
        return directly(t, depth)
    offset = np.arange(len(t)) if offset is None else offset
    if n_symbols > WIDE:
        digits, n_digits = in_digits(t, n_symbols)
        array = suffix_array(digits, n_digits, depth, np.repeat(offset, 2)[:-1])
        return array[array % 2 == 0] // 2
    t = t.astype(np.uint16)
    is_smaller = classify(t)
    is_leftmost = np.concatenate([[False], is_smaller[1:] & ~is_smaller[:-1]])
    at = np.flatnonzero(is_leftmost).astype(np.int32)
    first = induce(t, at[np.argsort(t[at], kind="stable")], n_symbols)
    found = first[is_leftmost[first]]
    names = name_substrings(t, at, found)
    of = np.zeros(len(t), dtype=np.int64)
    of[found] = names
    of = of[at]
    is_open = np.bincount(names)[of] > 1
    if depth is not None:
        is_open &= np.diff(offset[at], append=offset[-1] + 1) < depth
    if is_open.any():
        # A comparison ends at the first name that is not open; names behind it are left out of the recursion.
        inside = is_open.copy()
        inside[1:] |= is_open[:-1]
        inside[-1] = True
        kept = np.flatnonzero(inside)
        number = np.zeros(int(names[-1]) + 1, dtype=np.int64)
        number[of[kept]] = 1
        number = np.cumsum(number) - 1
        ordered = kept[suffix_array(number[of[kept]], int(number[-1]) + 1, depth, offset[at[kept]])]
        left_out = np.zeros(len(t), dtype=bool)
        left_out[at[~inside]] = True
        is_left_out = left_out[found]
        found, place = np.concatenate([at[ordered], found[is_left_out]]), np.concatenate([of[ordered], names[is_left_out]])
        found = found[np.argsort(place, kind="stable")]
    return induce(t, found, n_symbols)


def common_prefixes(t: np.ndarray, array: np.ndarray, ends: np.ndarray, least: int = 1) -> np.ndarray:
    """For each position of t, how far its suffix agrees with the one before it in the array, up to the end of either's string.

    A position whose neighbour follows its left position's neighbour has one symbol less than that; only where
    such a chain begins are symbols compared, four at a time. Where fewer than `least` symbols are left the result may be 0.
    """
    n = len(t)
    before = np.full(n, -1, dtype=np.int64)
    before[array[1:]] = array[:-1]
    room = np.where(before >= 0, np.minimum(ends - np.arange(n), ends[before] - before), 0)
    wide = np.concatenate([t.astype(np.uint64), np.zeros(4, dtype=np.uint64)])
    words = wide[:n] | wide[1 : n + 1] << np.uint64(16) | wide[2 : n + 2] << np.uint64(32) | wide[3 : n + 3] << np.uint64(48)
    out = np.zeros(n, dtype=np.int64)

    def compare(at: np.ndarray) -> None:
        k = 0
        left = at[room[at] >= least]
        while len(left):
            x = words[left + k] ^ words[before[left] + k]
            equal = x == 0
            stop = left[~equal]
            y = x[~equal]
            more = (y & np.uint64(0xFFFF) == 0).astype(np.int64) + (y & np.uint64(0xFFFFFFFF) == 0) + (y & np.uint64(0xFFFFFFFFFFFF) == 0)
            out[stop] = k + more
            left, k = left[equal], k + 4
            over = (room[left] <= k) | (np.maximum(left, before[left]) + k >= n)
            out[left[over]] = k
            left = left[~over]
        out[at] = np.minimum(out[at], room[at])

    begins = np.ones(n, dtype=bool)
    begins[1:] = before[1:] != before[:-1] + 1
    compare(np.flatnonzero(begins))
    last = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    chained = out[last] - (np.arange(n) - last)
    out[~begins] = np.minimum(chained, room)[~begins]
    compare(np.flatnonzero(~begins & (chained < 0)))
    return np.maximum(out, 0)
