"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

Suffixes are L (larger than the next) or S (smaller); an S suffix after an L one is leftmost-smaller (LMS). LMS substrings are
sorted by one induction and named; while names repeat, the string of names is sorted by the same function in turn, and the order of
the LMS suffixes induces all the others in two linear scans. A scan goes over the symbols block by block: one symbol a block, or, of
a string of names, as many neighbouring symbols as have some thousand suffixes together. What a block holds induces in one step all
that it puts into later blocks, and wave by wave what it puts into itself, so each step is a few array operations.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Suffixes of the symbols of one block, about; strings of fewer symbols than FEW have a block for each.
BLOCK, FEW = 4096, 300


def classify(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are S, and the positions of the LMS ones. The end of the string is smaller than any symbol."""
    n = len(t)
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1].astype(np.int32))
    rise[-1] = -1
    at = np.flatnonzero(rise)  # a run of equal symbols takes the type at its end
    s = np.repeat(rise[at] > 0, np.diff(np.r_[-1, at]))
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    return s, lms.astype(np.int32)


def blocks_of(t: np.ndarray, symbols: int) -> np.ndarray:
    """The block of each symbol; a symbol of many suffixes has a block of its own."""
    if symbols <= FEW:
        return np.arange(symbols, dtype=np.int32)
    size = np.bincount(t, minlength=symbols)
    large = size > BLOCK
    part = np.cumsum(np.where(large, 0, size)) // BLOCK
    new = np.r_[True, (part[1:] != part[:-1]) | large[1:] | large[:-1]]
    return (np.cumsum(new) - 1).astype(np.int32)


class Pending:
    """Positions put into blocks, in the order in which they come: one array with room for what each block will hold."""

    def __init__(self, block: np.ndarray, count: int):
        """block: that of each position to come."""
        size = np.bincount(block, minlength=count)
        self.start = np.cumsum(size) - size
        self.next = self.start.copy()
        self.held = np.empty(len(block), np.int32)

    def put(self, found: np.ndarray, block: np.ndarray) -> None:
        if len(found):
            order = np.argsort(block, kind="stable")
            size = np.bincount(block, minlength=len(self.next))
            place = np.arange(len(found)) + np.repeat(self.next - (np.cumsum(size) - size), size)
            self.held[place] = found[order]
            self.next += size

    def of(self, k: int) -> np.ndarray:
        return self.held[self.start[k] : self.next[k]]


def settled(t: np.ndarray, block: np.ndarray, here: int, came: np.ndarray, seeds: np.ndarray, induced: Callable[[np.ndarray], np.ndarray], down: bool) -> tuple[np.ndarray, np.ndarray]:
    """A scan's step in block `here`. came: the positions that earlier blocks put here, seeds: those of the other type, both in scan
    order; induced(positions): which of the positions before them the scan places. Returns the positions of the first type in scan
    order, those placed by this block itself included, and in scan order all that the block places in later ones.

    Scan order is by symbol, the scanned type first, then by the order of what placed each; what earlier blocks placed comes first."""
    pos = np.concatenate([came, seeds])
    seed = np.arange(len(pos)) >= len(came)
    parent, own = np.arange(len(pos)), np.zeros(len(pos), bool)
    outer_from, outer_pos, frontier, waves = [], [], np.arange(len(pos)), 0
    while len(frontier):
        at = frontier[pos[frontier] > 0]
        before = pos[at] - 1
        good = induced(before)
        at, before = at[good], before[good]
        inside = block[t[before]] == here
        outer_from.append(at[~inside])
        outer_pos.append(before[~inside])
        n = int(inside.sum())
        frontier = np.arange(len(pos), len(pos) + n)
        if n:
            pos, parent = np.concatenate([pos, before[inside]]), np.concatenate([parent, at[inside]])
            seed, own, waves = np.concatenate([seed, np.zeros(n, bool)]), np.concatenate([own, np.ones(n, bool)]), waves + 1
    symbol = t[pos].astype(np.int64)
    if down:
        symbol = -symbol
    key = ((symbol * 2 + seed) * 2 + own) << 32
    order = np.argsort(key + parent)  # what earlier blocks placed: as it came
    for _ in range(waves):
        rank = np.empty(len(pos), np.int64)
        rank[order] = np.arange(len(pos))
        was, order = order, np.argsort(key + np.where(own, rank[parent], parent))
        if np.array_equal(was, order):
            break
    rank = np.empty(len(pos), np.int64)
    rank[order] = np.arange(len(pos))
    made = pos[order[~seed[order]]]
    source, target = np.concatenate(outer_from) if outer_from else order[:0], np.concatenate(outer_pos) if outer_pos else pos[:0]
    return made, target[np.argsort(rank[source], kind="stable")]


def in_waves(t: np.ndarray, c: int, came: np.ndarray, induced: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """As settled, for a block of one symbol: what it places in itself follows wave by wave, in order."""
    done, outer, now = [], [], came
    while len(now):
        done.append(now)
        before = now[now > 0] - 1
        before = before[induced(before)]
        same = t[before] == c
        outer.append(before[~same])
        now = before[same]
    return (np.concatenate(done) if done else came), outer


def induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in order, given the LMS ones in order."""
    n, empty = len(t), np.zeros(0, np.int32)
    block = blocks_of(t, symbols)
    count = int(block[-1]) + 1
    alone = np.bincount(block, minlength=count) == 1
    symbol_of = np.zeros(count, np.int64)
    symbol_of[block] = np.arange(symbols)

    def scan(down: bool, pending: Pending, seeds: Callable[[int], np.ndarray], induced: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
        out: list[np.ndarray] = [empty] * count
        for k in range(count - 1, -1, -1) if down else range(count):
            came, seed = pending.of(k), seeds(k)
            if not len(came) and not len(seed):
                continue
            if alone[k]:
                out[k], outer = in_waves(t, int(symbol_of[k]), came, induced)
                before = seed[seed > 0] - 1  # a seed places nothing in its own symbol
                later = np.concatenate([*outer, before[induced(before)]])
            else:
                out[k], later = settled(t, block, k, came, seed, induced, down)
            pending.put(later, block[t[later]])
        return out

    of = block[t]
    first, larger, smaller = Pending(of[lms], count), Pending(of[~s], count), Pending(of[s], count)
    first.put(lms, of[lms])
    larger.put(np.array([n - 1], np.int32), of[n - 1 :])  # before the end of the string
    l_part = scan(False, larger, first.of, lambda x: ~s[x])
    s_part = scan(True, smaller, lambda k: l_part[k][::-1], lambda x: s[x])
    out = []
    for k in range(count):
        both = np.concatenate([l_part[k], s_part[k][::-1]])
        out.append(both if alone[k] else both[np.argsort(t[both], kind="stable")])
    return np.concatenate(out)


def name_substrings(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names (from 1, in order) of the LMS substrings that start at lms; ordered: the same positions, sorted by substring."""
    n = len(t)
    slot = np.zeros(n, np.int32)
    slot[lms] = np.arange(len(lms), dtype=np.int32)
    size = np.diff(np.r_[lms, n]) + 1  # both ends belong to it; the last one reaches the end of the string
    at = slot[ordered]
    a, b = at[:-1], at[1:]
    new = (size[a] != size[b]) | (a == len(lms) - 1) | (b == len(lms) - 1)
    left, k = np.flatnonzero(~new), 0
    while len(left):
        left = left[size[a[left]] > k]
        differ = t[lms[a[left]] + k] != t[lms[b[left]] + k]
        new[left[differ]] = True
        left, k = left[~differ], k + 1
    name = np.empty(len(lms), np.int64)
    name[at] = np.r_[0, np.cumsum(new)] + 1
    return name


def suffix_array(t: np.ndarray, symbols: int) -> np.ndarray:
    """The suffixes of t (symbols 0 .. symbols - 1) in order, as positions."""
    if not len(t):
        return np.zeros(0, np.int32)
    t = np.ascontiguousarray(t, np.uint16 if symbols <= 1 << 16 else np.int32)
    s, lms = classify(t)
    if len(lms) > 1:
        rough = induce(t, s, lms, symbols)
        is_lms = np.zeros(len(t), bool)
        is_lms[lms] = True
        name = name_substrings(t, lms, rough[is_lms[rough]])
        names = int(name.max())
        lms = lms[np.argsort(name) if names == len(name) else suffix_array(name, names + 1)]
    return induce(t, s, lms, symbols)


def permuted_common_prefixes(text: np.ndarray, symbols: np.ndarray, order: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position, in text order, the length that its suffix shares with the one before it in order, as far as the segments of
    both reach. ends: for each position the end of its segment, where the symbol is 0.

    Where a suffix and its predecessor follow equal symbols, the value is the last position's less one; only the others are compared,
    eight bytes at once."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    fresh = (i == 0) | (before <= 0) | (ends == i)
    some = np.flatnonzero(~fresh)
    fresh[some] = (symbols[some - 1] != symbols[before[some] - 1]) | (symbols[some - 1] == 0)
    at = np.flatnonzero(fresh & (before >= 0) & (ends > i))
    prior = before[at]
    room = np.minimum(ends[at] - at, ends[prior] - prior)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.ndarray((n,), np.uint64, padded, strides=(1,))
    length, left, k = room.copy(), np.flatnonzero(room > 0), 0
    while len(left):
        x = eight[at[left] + k] ^ eight[prior[left] + k]
        differ = x != 0
        low = x[differ] & (~x[differ] + np.uint64(1))  # the lowest bit in which they differ
        which = left[differ]
        length[which] = np.minimum(length[which], k + np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
        left, k = left[~differ], k + 8
        left = left[room[left] > k]
    out = np.zeros(n, np.int64)
    out[at] = length
    base = np.maximum.accumulate(np.where(fresh, i, 0))
    return out[base] - (i - base)


def repeated_windows(segments: list[bytes], window: int) -> list[np.ndarray]:
    """For each segment, which of its windows (one starts at each byte but the last window - 1) also start elsewhere in the segments."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    first = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    symbols = text.astype(np.uint16) + np.uint16(1)
    symbols[first + sizes] = 0  # a separator, smaller than any byte
    order = suffix_array(symbols, 257)
    found = permuted_common_prefixes(text, symbols, order, np.repeat(first + sizes, sizes + 1)) >= window
    place = np.empty(len(text), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    at = np.flatnonzero(found)
    found[order[place[at] - 1]] = True  # the one before it in order starts the same window
    return [found[a : a + max(0, n - window + 1)] for a, n in zip(first.tolist(), sizes.tolist(), strict=True)]
