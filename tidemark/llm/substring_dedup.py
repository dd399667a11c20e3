"""Substring dedup of word windows, with a count-min prefilter.

A window is 13 consecutive words. First pass: each partition counts its windows in a sketch whose size follows the number of windows;
sketches are merged by saturating addition. The sketch never underestimates, so every window that two documents hold is estimated
repeated. Second pass: only windows so estimated are grouped exactly, for the smallest document that holds them.

Equal windows share an anchor: of the five-word runs inside, the one of least hash. Consecutive windows with one anchor travel as one
run, and equal runs of a batch as one row, so copies by the thousand don't meet as thousands of rows. Windows are equal if the 64-bit
hashes of their anchors, their places in respect to it and their own 64-bit hashes are; runs, if the hashes of their anchors and of
their windows are. An anchor that very many different runs share, as a common phrase does, is not grouped in one task: the windows of
its runs are grouped one by one, by aggregations that combine map-side.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, discard, ragged, record, small_batches, stored, texts, to_arrow
from .countmin import BROADCAST_BYTES, Sketch, sketch
from .windows import WordHashes, anchors, mix, run_hashes

WINDOW, GRAM = 13, 5
#: What a null id is judged as: the largest long.
NO_ID = (1 << 63) - 1
#: Runs of one anchor beyond which its windows are grouped one by one, and cells in which such anchors are marked. Other anchors of
#: a marked cell go the same way, which is as exact.
ANCHOR_RUNS, HOT_CELLS = 1000, 1 << 18
#: Turns in which windows are dealt to a sketch that is too large to broadcast: what is on its way at once is a share of them.
TURNS = 3
#: Words whose windows are hashed at once, about.
CHUNK = 1 << 17


class Windows:
    """The windows of some texts: hashes, anchors (hash, and place among the words), which text and which word each starts at."""

    def __init__(self, words: list[list[bytes]], hashes: WordHashes):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.cumsum(sizes) - sizes
        own = np.repeat(np.arange(len(words)), sizes)
        h = hashes.of([w for x in words for w in x])
        grams, value = run_hashes(h, GRAM), run_hashes(h, WINDOW)
        at = anchors(grams, WINDOW - GRAM + 1)
        self.start = np.flatnonzero(own[WINDOW - 1 :] == own[: len(value)]) if len(value) else np.zeros(0, np.int64)
        self.own, self.value, self.at = own[self.start], value[self.start], at[self.start]
        self.anchor = grams[self.at]


def windows(whole: list[bytes], hashes: WordHashes) -> Iterator[tuple[int, Windows]]:
    """The windows of the texts of a batch, some texts at a time: the number of the first, and the windows."""
    words, n, i = [], 0, 0
    for k, text in enumerate(whole):
        w = text.split()
        if words and n + len(w) > CHUNK:
            yield i, Windows(words, hashes)
            words, n, i = [], 0, k
        words.append(w)
        n += len(w)
    if words:
        yield i, Windows(words, hashes)


def counted():  # noqa: ANN201
    """For the sketch: each window's anchor and hash, and where runs of windows with one anchor begin."""
    hashes = WordHashes()

    def each(whole: list[bytes]) -> tuple[np.ndarray, ...]:
        parts, n = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
        for _, w in windows(whole, hashes):
            parts.append((w.anchor, w.value, runs(w.start, w.at) + n))
            n += len(w.value)
        return tuple(map(np.concatenate, zip(*parts, strict=True)))

    return each


LONE = "doc_id long, key long, anchor long, start int, off int, windows binary"
RUNS = "kind int, doc_id long, key long, anchor long, sig long, start int, n int, off int, lo long, hi long, windows binary"


class Gathered:
    """Runs of windows with one anchor, column by column: document, key, anchor, first word, distance of the anchor, windows."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, doc: np.ndarray, key: np.ndarray, anchor: np.ndarray, start: np.ndarray, off: np.ndarray, n: np.ndarray, value: np.ndarray) -> None:
        if len(n):
            self.parts.append((doc, key, anchor, start, off, n, value))

    def columns(self) -> tuple[np.ndarray, ...]:
        return tuple(map(np.concatenate, zip(*self.parts, strict=True)))

    def lone(self) -> Iterator[pa.RecordBatch]:
        """Each run as a row, LONE."""
        if self.parts:
            doc, key, anchor, start, off, n, value = self.columns()
            ends = np.cumsum(n)
            tail = [value[e - m : e].tobytes() for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
            yield record({"doc_id": doc, "key": key, "anchor": anchor.view(np.int64), "start": start.astype(np.int32), "off": off.astype(np.int32), "windows": tail}, to_arrow(LONE))

    def rows(self) -> Iterator[pa.RecordBatch]:
        """RUNS. Of kind 0: where each run stands. Of kind 1: each distinct run, its windows, and the smallest and largest document that holds it."""
        if not self.parts:
            return
        arrow = to_arrow(RUNS)
        doc, key, anchor, start, off, n, value = self.columns()
        first = np.cumsum(n) - n
        place = np.arange(len(value)) - np.repeat(first, n)
        sig = np.bitwise_xor.reduceat(mix(value + (np.repeat(off, n) - place + 64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first) + n.astype(np.uint64)
        none = pa.nulls(len(anchor))
        a, s = anchor.view(np.int64), sig.view(np.int64)
        yield record({"kind": np.zeros(len(a), np.int32), "doc_id": doc, "key": key, "anchor": a, "sig": s, "start": start.astype(np.int32), "n": n.astype(np.int32), "off": none.cast(pa.int32()), "lo": none.cast(pa.int64()), "hi": none.cast(pa.int64()), "windows": none.cast(pa.binary())}, arrow)
        order = np.lexsort((doc, s, a))
        edge = np.flatnonzero(np.r_[True, (a[order][1:] != a[order][:-1]) | (s[order][1:] != s[order][:-1])])
        one, last = order[edge], order[np.r_[edge[1:], len(order)] - 1]
        none = pa.nulls(len(one))
        yield record({"kind": np.ones(len(one), np.int32), "doc_id": none.cast(pa.int64()), "key": none.cast(pa.int64()), "anchor": a[one], "sig": s[one], "start": none.cast(pa.int32()), "n": n[one].astype(np.int32), "off": off[one].astype(np.int32), "lo": doc[one], "hi": doc[last], "windows": [value[f : f + m].tobytes() for f, m in zip(first[one].tolist(), n[one].tolist(), strict=True)]}, arrow)


def runs(start: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where a run begins, of windows in order: the one before isn't next to it, or has another anchor."""
    return np.flatnonzero(np.r_[True, (start[1:] != start[:-1] + 1) | (at[1:] != at[:-1])]) if len(start) else np.zeros(0, np.int64)


def gathered(batch: pa.RecordBatch, hashes: WordHashes, lookup=None) -> Gathered:  # noqa: ANN001
    """The runs of a batch (doc_id, text, key): of windows estimated repeated, or of all."""
    out = Gathered()
    ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
    for i, w in windows(texts(batch), hashes):
        kept = np.arange(len(w.start)) if lookup is None else np.flatnonzero(lookup(w.anchor, w.value))
        start, at = w.start[kept], w.at[kept]
        edge = runs(start, at)
        own = w.own[kept][edge]
        out.add(ids[i + own], keys[i + own], w.anchor[kept][edge], start[edge] - w.first[own], at[edge] - start[edge], np.diff(np.r_[edge, len(start)]), w.value[kept])
    return out


def repeated_runs(docs: DataFrame, found: Sketch) -> Iterator[DataFrame]:
    """docs (doc_id, text, key) -> the runs of windows estimated repeated, RUNS, in one frame or a frame a turn."""
    if found.small:
        lookup = found.broadcast()

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, known = WordHashes(), lookup()
            for batch in batches:
                yield from gathered(batch, hashes, known).rows()

        yield docs.mapInArrow(each, RUNS)
        return

    shape = found.shape  # tasks can't hold the sketch's table

    def every(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            yield from gathered(batch, hashes, lambda anchor, _: shape.in_turn(anchor, turn, TURNS)).lone()

    def filtered(batch: pa.RecordBatch, known) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        doc, key, anchor, first, off = (batch.column(c).to_numpy() for c in range(5))
        tail = batch.column(5).to_pylist()
        n = np.fromiter(map(len, tail), np.int64, len(tail)) // 8
        value, row = np.frombuffer(b"".join(tail), np.uint64), np.repeat(np.arange(len(n)), n)
        place = np.arange(len(value)) - np.repeat(np.cumsum(n) - n, n)
        kept = np.flatnonzero(known(anchor.view(np.uint64)[row], value))
        row, place = row[kept], place[kept]
        edge = runs(place + row * (1 << 20), row)
        of, start = row[edge], place[edge]
        out = Gathered()
        out.add(doc[of], key[of], anchor.view(np.uint64)[of], first[of] + start, off[of].astype(np.int64) - start, np.diff(np.r_[edge, len(row)]), value[kept])
        yield from out.rows()

    for turn in range(TURNS):
        yield found.dealt(docs, partial(every, turn=turn), LONE, filtered, RUNS, turn, TURNS)


LEAST = "anchor long, sig long, least long, mins binary"


def least_holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 1, sorted by anchor -> for each distinct run the smallest document that holds each of its windows: one id if all
    agree, else an array. Runs that can remove nothing are left out."""
    arrow, kept = to_arrow(LEAST), None

    def each(t: pa.Table) -> pa.RecordBatch | None:
        t = t.combine_chunks()
        anchor, sig, off, lo, hi, n = (t.column(c).to_numpy() for c in ("anchor", "sig", "off", "lo", "hi", "n"))
        win = np.frombuffer(b"".join(t.column("windows").to_pylist()), np.uint64)
        row = np.repeat(np.arange(len(n)), n)
        first = np.cumsum(n) - n
        # a window's place: the distance to the anchor
        place = off[row] - (np.arange(len(win)) - first[row])
        order = np.lexsort((win, place, anchor[row]))
        r, p, w = row[order], place[order], win[order]
        edge = np.flatnonzero(np.r_[True, (anchor[r][1:] != anchor[r][:-1]) | (p[1:] != p[:-1]) | (w[1:] != w[:-1])])
        least = np.minimum.reduceat(lo[r], edge)
        most = np.maximum.reduceat(hi[r], edge)
        size = np.diff(np.r_[edge, len(r)])
        mins, maxs = np.empty(len(win), np.int64), np.empty(len(win), np.int64)
        mins[order], maxs[order] = np.repeat(least, size), np.repeat(most, size)
        low, high, top = np.minimum.reduceat(mins, first), np.maximum.reduceat(mins, first), np.maximum.reduceat(maxs, first)
        useful = np.flatnonzero(low < top)
        if not len(useful):
            return None
        _, pick = np.unique(np.stack([anchor[useful], sig[useful]], 1), axis=0, return_index=True)
        useful = useful[pick]
        arrays = [None if low[i] == high[i] else mins[first[i] : first[i] + n[i]].tobytes() for i in useful.tolist()]
        return record({"anchor": anchor[useful], "sig": sig[useful], "least": low[useful], "mins": arrays}, arrow)

    for batch in batches:
        t = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
        anchor = t.column("anchor").to_numpy()
        cut = int(np.searchsorted(anchor, anchor[-1]))
        kept = t.slice(cut)
        if cut and (out := each(t.slice(0, cut))) is not None:
            yield out
    if kept is not None and (out := each(kept)) is not None:
        yield out


SINGLE = "anchor long, sig long, at int, win long, lo long, hi long"


def single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 1 -> one row for each window, with its place in the run."""
    arrow = to_arrow(SINGLE)
    for batch in batches:
        t = pa.Table.from_batches([batch])
        anchor, sig, lo, hi, n = (t.column(c).to_numpy() for c in ("anchor", "sig", "lo", "hi", "n"))
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        win = np.frombuffer(b"".join(t.column("windows").to_pylist()), np.int64)
        yield record({"anchor": anchor[row], "sig": sig[row], "at": at.astype(np.int32), "win": win, "lo": lo[row], "hi": hi[row]}, arrow)


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, sig, low, high, mins as array) -> LEAST."""
    arrow = to_arrow(LEAST)
    for batch in batches:
        low, high = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        arrays = [None if a == b else np.array(m, np.int64).tobytes() for a, b, m in zip(low, high, batch.column(4).to_pylist(), strict=True)]
        yield record({"anchor": batch.column(0), "sig": batch.column(1), "least": low, "mins": arrays}, arrow)


def least_holders_by_window(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What least_holders finds, without a group of all runs of an anchor: runs (rows of kind 1) -> LEAST, and what is stored for it."""
    single = runs.mapInArrow(single_windows, SINGLE).groupBy("anchor", "sig", "at", "win").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    single = stored(single, "single")
    held = single.groupBy("anchor", "win").agg(F.min("lo").alias("least"), F.max("hi").alias("top"))
    of = single.select("anchor", "sig", "at", "win").join(held, ["anchor", "win"]).groupBy("anchor", "sig")
    mins = F.sort_array(F.collect_list(F.struct("at", "least")))  # a run has at most WINDOW - GRAM + 1 windows
    found = of.agg(F.min("least").alias("low"), F.max("least").alias("high"), F.max("top").alias("top"), mins.alias("mins")).where("low < top")
    return found.select("anchor", "sig", "low", "high", F.col("mins.least").alias("mins")).mapInArrow(packed, LEAST), single


def repeats(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> Sketch:
    """The sketch of the windows of docs (text)."""
    words = F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"))
    n = docs.agg(F.sum(F.greatest(words - (WINDOW - 1), F.lit(0)).cast("long"))).first()[0]
    return sketch(docs, counted, n or 0, broadcast_bytes, groups=True)


def removals(docs: DataFrame, anchor_runs: int = ANCHOR_RUNS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs (doc_id, text, key) -> doc_id, key, runs: where a window also stands in a document of smaller id."""
    spark = docs.sparkSession
    small_batches(spark)
    found = repeats(docs, broadcast_bytes)
    parts = [stored(part, "runs") for part in repeated_runs(docs, found)]
    discard(found.table)
    held = reduce(DataFrame.unionByName, parts)
    distinct = held.where("kind = 1").select("anchor", "sig", "off", "lo", "hi", "n", "windows")
    cell = F.pmod(F.xxhash64("anchor"), F.lit(HOT_CELLS)).alias("cell")
    hot_cells = stored(distinct.groupBy("anchor").count().where(F.col("count") > anchor_runs).select(cell).distinct(), "hot-cells")
    hot = F.broadcast(hot_cells)  # HOT_CELLS rows at most
    dealt = distinct.select("*", cell)
    few = dealt.join(hot, "cell", "left_anti").drop("cell").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(least_holders, LEAST)
    many, single = least_holders_by_window(dealt.join(hot, "cell", "left_semi").drop("cell"))
    with batches_of(spark, 20_000):
        least = stored(few.unionByName(many), "least")
    discard(hot_cells, single)
    stand = held.where("kind = 0").select("doc_id", "key", "anchor", "sig", "start", "n")
    # both sides come from storage, so where many copies share a run Spark can split its side of the join; a set, as repeated rows say the same
    hit = stand.join(least, ["anchor", "sig"]).where("least < doc_id")
    cut = stored(hit.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "n", "least", "mins")).alias("runs")), "cut")  # the runs of one document
    discard(*parts, least)  # before the texts are dealt
    return cut


def dedup(docs: DataFrame, *more: str, anchor_runs: int = ANCHOR_RUNS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of every row, with the further columns asked for.

    Words are runs of bytes other than space and 0x09-0x0D; null text has none, and texts of under 13 words keep all. A row is
    judged against rows of smaller doc_id only: repeated rows leave each other alone, and a null id counts as the largest long. A text
    of more than 2^28 words is refused."""
    own_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")
    rows = docs.select(own_id, F.col("text").cast("string").alias("text"), F.col("doc_id").isNull().alias("without"), *[F.col(c).alias(f"_{c}") for c in more])
    rows = rows.withColumn("key", F.xxhash64("text"))
    cut = removals(rows.select("doc_id", "text", "key"), anchor_runs, broadcast_bytes)
    # by sorting, whatever the size of the stored runs seems to be: they may be far larger unpacked
    joined = rows.join(cut.hint("merge"), ["doc_id", "key"], "left").select("doc_id", "text", "without", "runs", *[f"_{c}" for c in more])
    own = "doc_id long, n_words long, n_removed long, kept string"
    schema = T.StructType([*T.StructType.fromDDL(own).fields, *[T.StructField(c, docs.schema[c].dataType) for c in more]])
    arrow = to_arrow(own)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [t.split() for t in texts(batch)]
            ids = batch.column(0)
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            stay = left_words(batch.column(3), sizes, ids.to_numpy())
            ends = np.cumsum(sizes)
            removed = sizes - np.diff(np.r_[0, np.cumsum(stay)[ends - 1] * (ends > 0)]) if len(stay) else sizes * 0
            kept = [b" ".join(w if not gone else compress(w, stay[e - len(w) : e].tolist())).decode("utf-8", "replace") for w, gone, e in zip(words, removed.tolist(), ends.tolist(), strict=True)]
            id_ = pa.array(ids.to_numpy(), mask=batch.column(2).to_numpy(zero_copy_only=False))
            out = record({"doc_id": id_, "n_words": sizes, "n_removed": removed, "kept": kept}, arrow)
            rest = [batch.column(4 + i) for i in range(len(more))]
            yield pa.RecordBatch.from_arrays([*out.columns, *rest], names=[*out.schema.names, *more])

    small_batches(docs.sparkSession)
    return joined.mapInArrow(each, schema)


def left_words(found: pa.ListArray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For the words of a batch's texts, one after the other, whether each stays. found: the runs of each text."""
    first = np.cumsum(sizes) - sizes
    change = np.zeros(int(sizes.sum()) + 1, np.int32)
    run, row = found.flatten(), np.repeat(np.arange(len(found)), found.value_lengths().fill_null(0).to_numpy())
    start, n, mins = run.field("start").to_numpy(), run.field("n").to_numpy(), run.field("mins")
    at = first[row] + start
    whole = mins.is_null().to_numpy(zero_copy_only=False)
    np.add.at(change, at[whole], 1)
    np.add.at(change, at[whole] + n[whole] - 1 + WINDOW, -1)
    part = np.flatnonzero(~whole)
    if len(part):
        smaller = np.frombuffer(b"".join(mins.take(pa.array(part)).to_pylist()), np.int64) < np.repeat(ids[row[part]], n[part])
        each = ragged(at[part], n[part])[smaller]
        np.add.at(change, each, 1)
        np.add.at(change, each + WINDOW, -1)
    return np.cumsum(change[:-1]) == 0
