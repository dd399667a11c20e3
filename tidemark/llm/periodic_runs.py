"""Runs of words: stretches that repeat with a short period, found by uniting suffix classes from the longest common prefix down.

All of a document's suffixes are sorted; going through the neighbours in that order by descending common prefix, union-find unites
their classes, each of which keeps its positions in order. When two classes meet at a common prefix of l words, positions that become
neighbours at distance d share exactly l words, so the l + d words from the first on have period d. If l is at least three times d and
the words before both differ (or there is none), they are a whole run with exponent four or more; d is its smallest period, since a
smaller one would have put a position between the two already. So each run is seeded once, by its first position. Runs hold at least
six words, so common prefixes under LEAST_PREFIX words seed none and their classes stay apart; parts in which no LEAST_PREFIX words
occur twice have no suffixes to sort.

Work is by document, without a shuffle; one document is one task's.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, map_batches, texts
from .suffix_array import suffix_array
from .windows import run_hashes

#: A run has length >= max(LEAST_LENGTH, EXPONENT * period): the common prefix of its first position and the one a period on is then
#: at least LEAST_LENGTH - 1 words (period 1), 4 * 2 - 2 = 6 (period 2), or more.
LEAST_LENGTH, EXPONENT, LEAST_PREFIX = 6, 4, 5
#: Words whose suffixes are sorted together, about.
SORTED_TOGETHER = 200_000

SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs binary, collapsed binary"


def common_prefixes(t: np.ndarray, order: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position the number of symbols that its suffix shares with the one before it in order, up to the segments' ends.

    Only positions whose left neighbours differ are compared; at the others the value is the last position's less one."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    fresh = (before <= 0) | (i == 0) | (ends == i)
    some = np.flatnonzero(~fresh)
    fresh[some] = (t[some - 1] != t[before[some] - 1]) | (t[some - 1] == 0)
    at = np.flatnonzero(fresh & (before >= 0) & (ends > i))
    prior = before[at]
    room = np.minimum(ends[at] - at, ends[prior] - prior)
    length, left, k = room.copy(), np.flatnonzero(room > 0), 0
    while len(left) > 8 or (len(left) and k < 8):  # symbol by symbol while many are left, then each by itself in growing steps
        differ = t[at[left] + k] != t[prior[left] + k]
        length[left[differ]] = k
        left, k = left[~differ], k + 1
        left = left[room[left] > k]
    for x in left.tolist():
        a, b, end, step, p = int(at[x]), int(prior[x]), int(room[x]), 256, k
        while p < end:
            q = min(end, p + step)
            differ = np.flatnonzero(t[a + p : a + q] != t[b + p : b + q])
            if len(differ):
                length[x] = p + int(differ[0])
                break
            p, step = q, 2 * step
    out = np.zeros(n, np.int64)
    out[at] = length
    base = np.maximum.accumulate(np.where(fresh, i, 0))
    return np.maximum(out[base] - (i - base), 0)


def seeds(order: np.ndarray, prefix: np.ndarray) -> list[tuple[int, int, int]]:
    """(position, distance, common prefix) of positions that become neighbours in a class at a distance of which the common prefix is
    EXPONENT - 1 times as much. order: suffixes; prefix: what each in order shares with the one before."""
    links = np.flatnonzero(prefix >= LEAST_PREFIX)
    links = links[np.argsort(-prefix[links], kind="stable")]
    found: list[tuple[int, int, int]] = []
    root: dict[int, int] = {}
    members: dict[int, list[int]] = {}

    def find(x: int) -> int:
        at = x
        while (up := root.setdefault(at, at)) != at:
            at = up
        while x != at:
            root[x], x = at, root[x]
        return at

    for a, b, shared in zip(order[links - 1].tolist(), order[links].tolist(), prefix[links].tolist(), strict=True):
        ra, rb = find(a), find(b)
        large, small = members.pop(ra, None) or [ra], members.pop(rb, None) or [rb]
        if len(large) < len(small):
            ra, rb, large, small = rb, ra, small, large
        root[rb] = ra
        reach, last = shared // (EXPONENT - 1), len(small) - 1
        for k, x in enumerate(small):
            at = bisect_left(large, x)
            if at and (k == 0 or large[at - 1] != small[k - 1]) and x - large[at - 1] <= reach:
                found.append((large[at - 1], x - large[at - 1], shared))
            if at < len(large) and (k == last or small[k + 1] > large[at]) and large[at] - x <= reach:
                found.append((x, large[at] - x, shared))
            large.insert(at, x)
        members[ra] = large
    return found


def runs_of(documents_words: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each sequence of word numbers (from 0) its runs (start, length, period), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents_words]
    sizes = np.fromiter(map(len, documents_words), np.int64, len(documents_words))
    if not sizes.sum():
        return out
    whole = np.concatenate(documents_words).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    values, own = np.unique((owner << 32) | whole, return_inverse=True)  # words of different documents are different symbols
    first = np.cumsum(sizes + 1) - (sizes + 1)
    t = np.zeros(len(whole) + len(sizes), np.int32)
    at = np.arange(len(whole)) + owner
    t[at] = own + 1
    order = suffix_array(t, len(values) + 1).astype(np.int64)
    prefix = common_prefixes(t, order, np.repeat(first + sizes, sizes + 1))[order]
    for i, distance, shared in seeds(order, prefix):
        if shared + distance >= LEAST_LENGTH and (i == 0 or t[i - 1] == 0 or t[i - 1] != t[i + distance - 1]):
            k = int(np.searchsorted(first, i, "right")) - 1
            out[k].append((i - int(first[k]), shared + distance, distance))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def repeated(sequences: list[np.ndarray]) -> list[np.ndarray]:
    """Of each sequence which of its LEAST_PREFIX consecutive words (one at each place) occur in it again, or by chance of 64 bits seem to."""
    grams = [run_hashes((w.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), LEAST_PREFIX) for w in sequences]
    sizes = np.fromiter(map(len, grams), np.int64, len(grams))
    owner = np.repeat(np.arange(len(grams)), sizes)
    found = np.zeros(len(owner), bool)
    if len(owner):
        key = np.concatenate(grams)
        rank = np.lexsort((owner, key))
        same = np.flatnonzero((key[rank][1:] == key[rank][:-1]) & (owner[rank][1:] == owner[rank][:-1]))
        found[rank[same]] = found[rank[same + 1]] = True
    return np.split(found, np.cumsum(sizes)[:-1])


def stretches(words: list[np.ndarray]) -> list[tuple[int, int, np.ndarray]]:
    """(sequence, start, words) of the parts that can hold runs. Each LEAST_PREFIX words of a run occur a period further on or back, in
    the run itself: a run lies whole in a stretch of places that repeat, and what repeats in it repeats in that stretch."""
    parts = []
    for k, (w, flags) in enumerate(zip(words, repeated(words), strict=True)):
        if flags.any():
            edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
            parts += [(k, a, w[a : b + LEAST_PREFIX - 1]) for a, b in edge.reshape(-1, 2).tolist()]
    again = repeated([w for _, _, w in parts]) if parts else []
    return [part for part, flags in zip(parts, again, strict=True) if flags.any()]


def damaged(doc_id: int | None, n: int) -> np.ndarray | None:
    """The word that each place takes in a document chosen by its id (crc32 a multiple of ten): from word a on, the next p words over
    and over. None where the document stays as it is; a null id is never chosen."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay if each run is cut to its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def collapse(docs: DataFrame, damage: bool = False) -> DataFrame:
    """Returns a row a document: doc_id, n_words, n_runs; start, length, period and exponent_milli of its longest run (ties: the
    smallest start, then period; null without one); runs (binary: `start,length,period` and a line feed for each, by start, then
    period) and collapsed (binary: the words outside all but the first period of each run, joined by one space).

    A run is a stretch of words with smallest period q, of max(6, 4 * q) words or more, that no neighbouring word extends. Null or
    empty texts have no words, no runs and nothing left; repeated rows give repeated rows; null ids stay; other columns are left
    behind. damage: first makes documents chosen by their id periodic (see `damaged`), to have something to find."""

    def each(batch: pa.RecordBatch) -> dict:
        number: dict[bytes, int] = {}
        ids, split, places, words = batch.column(0).to_pylist(), [], [], []
        for doc_id, text in zip(ids, texts(batch), strict=True):
            w = text.split()
            place = damaged(doc_id, len(w)) if damage else None
            x = np.fromiter((number.setdefault(v, len(number)) for v in w), np.int64, len(w))
            split.append(w)
            places.append(place)
            words.append(x if place is None else x[place])
        found: list[list[tuple[int, int, int]]] = [[] for _ in words]
        group: list[tuple[int, int, np.ndarray]] = []
        size = 0
        for part in [*stretches(words), None]:
            if group and (part is None or size >= SORTED_TOGETHER):
                for (k, start, _), runs in zip(group, runs_of([w for _, _, w in group]), strict=True):
                    found[k] += [(start + s, length, period) for s, length, period in runs]
                group, size = [], 0
            if part:
                group.append(part)
                size += len(part[2])
        out: dict[str, list] = {name: [] for name in ("start", "length", "period", "exponent_milli", "runs", "collapsed")}
        for w, place, runs in zip(split, places, found, strict=True):
            start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
            out["start"].append(start)
            out["length"].append(length)
            out["period"].append(period)
            out["exponent_milli"].append(1000 * length // period if runs else None)
            out["runs"].append("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode())
            if place is not None:
                w = [w[i] for i in place.tolist()]
            if runs:
                w = [w[i] for i in np.flatnonzero(kept(len(w), runs)).tolist()]
            out["collapsed"].append(b" ".join(w))
        return out | {"doc_id": ids, "n_words": [len(w) for w in split], "n_runs": [len(r) for r in found]}

    return map_batches(documents(docs), each, SCHEMA)
