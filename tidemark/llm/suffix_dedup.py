"""Suffix-array dedup: removes every byte of a 200-byte string that also starts anywhere else.

A shard's suffix array must see all the strings that could be equal, so strings are dealt by content: equal windows share an anchor
(the 24-byte run of least hash inside), and the windows of one place that share an anchor travel as one segment, keyed by it. A
count-min sketch of anchors keeps those that occur once at home; equal segments travel once, with their number. Each task takes its
segments in anchor order, a few MB at a time, builds their suffix array by induced sorting and reads repeats off the permuted common
prefixes. An anchor under which very many different segments stand, as a common line does, is split: equal windows also share the run
of next to least hash, and the next, so its segments are cut into pieces by those and dealt again, until each part fits a suffix array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, discard, ragged, record, small_batches, stored, texts, to_arrow
from .countmin import BROADCAST_BYTES, Sketch, sketch
from .suffix_array import repeated_windows
from .windows import anchors, mix

WINDOW, GRAM = 200, 24
#: Bytes of segments in one suffix array, about; bytes of segments beyond which an anchor is split; and cells in which such anchors are
#: marked. Other anchors of a marked cell are split too, which is as exact.
SHARD_BYTES, ANCHOR_BYTES, HOT_CELLS = 1_500_000, 8_000_000, 1 << 18
#: Bytes of texts that are hashed at once, and that are cut at once.
CHUNK, CUT_BYTES = 1 << 18, 1 << 23
#: Bytes of text for each anchor, about: a window's least of 177 hashes changes twice in 178 places.
ANCHOR_EVERY = 60
#: Stands for a null id in joins; what is returned for it is null.
NO_ID = (1 << 63) - 1
NEVER = np.uint64((1 << 64) - 1)


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the 24 bytes from each place."""
    n = len(b) - GRAM + 1
    eight = np.ndarray((len(b) - 7,), np.uint64, np.ascontiguousarray(b), strides=(1,))
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k in (8, 16):
        h ^= h >> np.uint64(29)
        h = (h ^ eight[k : k + n]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mix(h)


def runs(batch: list[bytes]):  # noqa: ANN201
    """For the texts of a batch: the text, place, anchor hash and number of windows of each run of windows with one anchor."""
    i = 0
    while i < len(batch):
        j, size = i, 0
        while j < len(batch) and (j == i or size + len(batch[j]) <= CHUNK):
            size += len(batch[j])
            j += 1
        if size >= WINDOW:
            sizes = np.fromiter(map(len, batch[i:j]), np.int64, j - i)
            grams = gram_hashes(np.frombuffer(b"".join(batch[i:j]), np.uint8))
            at = anchors(grams, WINDOW - GRAM + 1)
            first = np.cumsum(sizes) - sizes
            own = np.repeat(np.arange(j - i), sizes)[: len(at)]
            place = np.arange(len(at)) - first[own]
            fits = place + WINDOW <= sizes[own]
            edge = np.r_[True, (at[1:] != at[:-1]) | (own[1:] != own[:-1]) | (fits[1:] != fits[:-1])]
            where = np.flatnonzero(edge)
            length = np.diff(np.r_[where, len(at)])
            keep = fits[where]
            where, length = where[keep], length[keep]
            yield i + own[where], place[where], grams[at[where]], length
        i = j


def counted():  # noqa: ANN201
    """For the sketch: the anchors of a text's runs, each as often as it stands somewhere."""

    def each(whole: list[bytes]) -> tuple[np.ndarray, ...]:
        found = np.concatenate([np.zeros(0, np.uint64), *[a for _, _, a, _ in runs(whole)]])
        return found, found, np.arange(len(found))

    return each


SEGMENTS = "kind int, doc_id long, key long, anchor long, sig long, start int, n int, copies int, segment binary"
STANDS = "doc_id long, key long, anchor long, start int, n int"


def signature(x: bytes) -> int:
    return xxhash.xxh3_64_intdigest(x) - (1 << 63)


def segments(whole: list[bytes], ids: list, keys: list, found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """found: text, place, anchor hash and number of windows of runs, as lists. Of kind 0: where each run stands. Of kind 1: each distinct
    segment and how often it stands."""
    arrow = to_arrow(SEGMENTS)
    rows: list[tuple] = []
    copies: dict[tuple[int, int], list] = {}
    for text, place, anchor, length in found:
        for i, a, h, n in zip(text, place, anchor, length, strict=True):
            segment = whole[i][a : a + n + WINDOW - 1]
            sig = signature(segment)
            rows.append((ids[i], keys[i], h, sig, a, n))
            known = copies.get((h, sig))
            if known is None:
                copies[h, sig] = [1, segment, n]
            else:
                known[0] += 1
    if not rows:
        return
    doc, key, anchor, sig, start, n = zip(*rows, strict=True)
    m = len(rows)
    yield record({"kind": [0] * m, "doc_id": doc, "key": key, "anchor": anchor, "sig": sig, "start": start, "n": n, "copies": [None] * m, "segment": [None] * m}, arrow)
    m, none = len(copies), [None] * len(copies)
    yield record({"kind": [1] * m, "doc_id": none, "key": none, "anchor": [h for h, _ in copies], "sig": [s for _, s in copies], "start": none, "n": [x[2] for x in copies.values()], "copies": [x[0] for x in copies.values()], "segment": [x[1] for x in copies.values()]}, arrow)


def repeated_segments(docs: DataFrame, found: Sketch) -> DataFrame:
    """docs (doc_id, text, key) -> the segments of anchors estimated repeated, SEGMENTS."""
    if found.small:
        lookup = found.broadcast()

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = lookup()

            def kept(whole: list[bytes]) -> Iterator[tuple]:
                for text, place, anchor, length in runs(whole):
                    ok = known(anchor, anchor)
                    yield text[ok].tolist(), place[ok].tolist(), anchor[ok].view(np.int64).tolist(), length[ok].tolist()

            for batch in batches:
                whole = texts(batch)
                yield from segments(whole, batch.column(0).to_pylist(), batch.column(2).to_pylist(), kept(whole))

        return docs.mapInArrow(each, SEGMENTS)

    # a large sketch: where the runs stand meets it, and comes back to the texts to have its segments cut
    arrow = to_arrow(STANDS)

    def stands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for text, place, anchor, length in runs(texts(batch)):
                yield record({"doc_id": ids[text], "key": keys[text], "anchor": anchor.view(np.int64), "start": place.astype(np.int32), "n": length.astype(np.int32)}, arrow)

    def filtered(batch: pa.RecordBatch, known) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        anchor = batch.column(2).to_numpy().view(np.uint64)
        yield batch.filter(pa.array(known(anchor, anchor)))

    kept = found.dealt(docs, stands, STANDS, filtered, STANDS)
    of = kept.groupBy("doc_id", "key").agg(F.collect_set(F.struct("anchor", "start", "n")).alias("runs"))  # those of one text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(3)
            run, row = listed.flatten(), np.repeat(np.arange(len(listed)), listed.value_lengths().to_numpy())
            yield from segments(texts(batch), batch.column(0).to_pylist(), batch.column(2).to_pylist(), iter([(row.tolist(), *(run.field(c).to_pylist() for c in ("start", "anchor", "n")))]))

    return docs.join(of, ["doc_id", "key"]).select("doc_id", "text", "key", "runs").mapInArrow(cut, SEGMENTS)


FOUND = "anchor long, sig long, bits binary"


def shard_repeats(batches: Iterator[pa.RecordBatch], shard_bytes: int = SHARD_BYTES) -> Iterator[pa.RecordBatch]:
    """Segments (anchor, sig, copies, segment) in the order of anchor and sig -> for each distinct one the windows that repeat, as bits;
    none if it has none. A segment that is alone under its anchor needs no suffix array: its windows repeat if it has copies."""
    arrow = to_arrow(FOUND)
    held: list[list] = []  # anchor, sig, copies, segment: groups of several segments, whole
    group: list[list] = []  # those of the last anchor
    alone: list[list] = []
    size = 0

    def handed(rows: list[list], found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        out = []
        for (anchor, sig, copies, segment), repeats in zip(rows, found, strict=True):
            if copies > 1:
                repeats = np.ones(len(segment) - WINDOW + 1, bool)
            if repeats.any():
                out.append((anchor, sig, np.packbits(repeats).tobytes()))
        if out:
            yield record(dict(zip(arrow.names, zip(*out, strict=True), strict=True)), arrow)

    def closed() -> None:
        nonlocal group, size
        if len(group) > 1:
            held.extend(group)
            size += sum(len(r[3]) for r in group)
        elif group[0][2] > 1:
            alone.append(group[0])
        group = []

    def ready(least: int, most_alone: int) -> Iterator[pa.RecordBatch]:
        nonlocal held, alone, size
        if len(alone) > most_alone:
            yield from handed(alone, [np.zeros(0, bool)] * len(alone))
            alone = []
        if held and size >= least:
            yield from handed(held, repeated_windows([r[3] for r in held], WINDOW))
            held, size = [], 0

    for batch in batches:
        for anchor, sig, copies, segment in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if group and group[-1][0] == anchor and group[-1][1] == sig:
                group[-1][2] += copies
                continue
            if group and group[-1][0] != anchor:
                closed()
                yield from ready(shard_bytes, 4000)
            group.append([anchor, sig, copies, segment])
    if group:
        closed()
    yield from ready(0, 0)


def repeats_of(dealt: DataFrame) -> DataFrame:
    """Rows (anchor, sig, copies, segment) -> FOUND, written out."""
    ordered = dealt.select("anchor", "sig", "copies", "segment").repartition("anchor").sortWithinPartitions("anchor", "sig")
    with batches_of(dealt.sparkSession, 4000):
        return stored(ordered.mapInArrow(shard_repeats, FOUND), "repeats")


PIECES = "anchor long, sig long, off int, n int, copies long, group long, own long, pinned binary, piece binary"


def split(batches: Iterator[pa.RecordBatch], steps: int) -> Iterator[pa.RecordBatch]:
    """PIECES -> PIECES. Each step cuts a piece where the least hash changes, from window to window, among the runs not used before
    (pinned), and adds that hash to the group: windows that are equal stay in one group."""
    arrow = to_arrow(PIECES)
    for batch in batches:
        out = []
        for anchor, sig, off, copies, group, pinned, piece in zip(*(batch.column(c).to_pylist() for c in ("anchor", "sig", "off", "copies", "group", "pinned", "piece")), strict=True):
            grams = gram_hashes(np.frombuffer(piece, np.uint8))
            level = [(0, len(piece) - WINDOW + 1, np.array([group], np.int64).view(np.uint64)[0], np.frombuffer(pinned, np.int32))]
            for _ in range(steps):
                finer = []
                for first, n, g, used in level:
                    own = grams[first : first + n + WINDOW - GRAM]
                    free = own.copy()
                    free[used] = NEVER
                    at = anchors(free, WINDOW - GRAM + 1)
                    edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                    for a, m in zip(edge.tolist(), np.diff(np.r_[edge, n]).tolist(), strict=True):
                        here = np.r_[used, at[a]] - a
                        finer.append((first + a, m, mix(g ^ mix(own[at[a]])), here[(here >= 0) & (here < m + WINDOW - GRAM)].astype(np.int32)))
                level = finer
            for first, m, g, used in level:
                cut = piece[first : first + m + WINDOW - 1]
                out.append((anchor, sig, off + first, m, copies, int(g.view(np.int64)), signature(cut), used.tobytes(), cut))
        if out:
            yield record(dict(zip(arrow.names, zip(*out, strict=True), strict=True)), arrow)


def hot_cells(df: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """The cells (HOT_CELLS at most) of the keys under which more than `most` bytes stand."""
    return stored(df.groupBy(key).agg(F.sum(F.octet_length(text)).alias("bytes")).where(F.col("bytes") > most).select(cell_of(key)).distinct(), "hot-cells")


def cell_of(key: str):  # noqa: ANN201
    return F.pmod(F.xxhash64(key), F.lit(HOT_CELLS)).alias("cell")


def repeats_of_hot(rows: DataFrame, most: int) -> DataFrame:
    """Rows (anchor, sig, copies, segment) of anchors with very many segments -> anchor, sig, off, n, bits: the windows that repeat, of the
    n from place off of a segment."""
    one = rows.groupBy("anchor", "sig").agg(F.sum("copies").cast("long").alias("copies"), F.first("segment").alias("piece"))
    level = one.select("*", F.lit(0).alias("off"), F.lit(0).cast("long").alias("group"), F.lit("").cast("binary").alias("pinned"))
    steps, taken, found = 2, 2, None  # the first of the two finds the anchor itself again
    while True:
        pieces = stored(level.mapInArrow(lambda it, steps=steps: split(it, steps), PIECES), "pieces")
        last = taken > WINDOW - GRAM  # every run is used: the windows of a group are equal
        hot = hot_cells(pieces, "group", "piece", most)
        some = pieces if last else pieces.select("*", cell_of("group")).join(F.broadcast(hot), "cell", "left_anti")
        repeats = repeats_of(some.select(F.col("group").alias("anchor"), F.col("own").alias("sig"), "copies", F.col("piece").alias("segment")))
        got = some.select("anchor", "sig", "off", "n", "group", "own").join(repeats.withColumnsRenamed({"anchor": "group", "sig": "own"}), ["group", "own"])
        got = stored(got.select("anchor", "sig", "off", "n", "bits").distinct(), "found")
        found = got if found is None else found.unionByName(got)
        if last or not hot.limit(1).count():
            return found
        level = pieces.select("*", cell_of("group")).join(F.broadcast(hot), "cell", "left_semi").drop("cell")
        steps, taken = taken, 2 * taken


def removals(docs: DataFrame, anchor_bytes: int = ANCHOR_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs (doc_id, text, key) -> doc_id, key, runs: the windows that repeat, run by run."""
    spark = docs.sparkSession
    small_batches(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    anchored = sketch(docs, counted, total // ANCHOR_EVERY, broadcast_bytes)
    held = stored(repeated_segments(docs, anchored), "segments")
    discard(anchored.table)
    rows = held.where("kind = 1").select("anchor", "sig", "copies", "segment", cell_of("anchor"))
    hot = hot_cells(rows, "anchor", "segment", anchor_bytes)
    which = repeats_of(rows.join(F.broadcast(hot), "cell", "left_anti")).select("anchor", "sig", F.lit(0).alias("off"), F.lit(None).cast("int").alias("some"), "bits")
    if hot.limit(1).count():
        many = repeats_of_hot(rows.join(F.broadcast(hot), "cell", "left_semi").drop("cell"), anchor_bytes)
        which = which.unionByName(many.withColumnRenamed("n", "some"))
    stand = held.where("kind = 0").select("doc_id", "key", "anchor", "sig", "start", "n")
    # both sides come from storage, so where many copies share a segment Spark can split its side of the join; a set, as repeated rows say the same
    hits = stand.join(which, ["anchor", "sig"]).select("doc_id", "key", F.struct((F.col("start") + F.col("off")).alias("start"), F.coalesce("some", "n").alias("n"), "bits").alias("run"))
    return hits.groupBy("doc_id", "key").agg(F.collect_set("run").alias("runs"))  # those of one document


def dedup(docs: DataFrame, anchor_bytes: int = ANCHOR_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary: the bytes left) of every row.

    Null text is empty; texts under 200 bytes keep all; strings never cross documents and are judged on the input. Rows are documents
    of their own, repeated rows and null ids included; other columns are left behind; an empty table gives no rows. A text of more than
    2^28 bytes is refused."""
    own_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")
    rows = docs.select(own_id, F.col("text").cast("string").alias("text"), F.col("doc_id").isNull().alias("without"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    cut = removals(rows.select("doc_id", "text", "key"), anchor_bytes, broadcast_bytes)
    joined = rows.join(cut, ["doc_id", "key"], "left").select("doc_id", "text", "without", "runs")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    arrow = to_arrow(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = texts(batch)
            i = 0
            while i < len(whole):
                j, size = i, 0
                while j < len(whole) and (j == i or size + len(whole[j]) <= CUT_BYTES):
                    size += len(whole[j])
                    j += 1
                part = batch.slice(i, j - i)
                n, gone, spans, kept = cut_texts(whole[i:j], part.column(3))
                ids = pa.array(part.column(0).to_numpy(), mask=part.column(2).to_numpy(zero_copy_only=False))
                yield record({"doc_id": ids, "n_bytes": n, "n_removed": gone, "n_spans": spans, "kept": kept}, arrow)
                i = j

    small_batches(docs.sparkSession)
    return joined.mapInArrow(each, schema)


def cut_texts(whole: list[bytes], found: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Texts, and of each the runs of windows with bits for those that repeat -> bytes, removed bytes, removed runs, and what is left."""
    sizes = np.fromiter(map(len, whole), np.int64, len(whole))
    ends = np.cumsum(sizes)
    first, total = ends - sizes, int(sizes.sum())
    run, row = found.flatten(), np.repeat(np.arange(len(found)), found.value_lengths().fill_null(0).to_numpy())
    starts = np.zeros(total, bool)  # where a window starts that repeats
    if len(run):
        start, n, bits = run.field("start").to_numpy(), run.field("n").to_numpy().astype(np.int64), run.field("bits").to_pylist()
        size = np.fromiter(map(len, bits), np.int64, len(bits))
        flags = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8))[ragged(8 * (np.cumsum(size) - size), n)].astype(bool)
        starts[ragged(first[row] + start, n)[flags]] = True
    upto = np.cumsum(starts, dtype=np.int32)
    gone = upto > np.r_[np.zeros(min(WINDOW, total), np.int32), upto[:-WINDOW]][:total]  # one of the last 200 places; no window leaves its text
    edge = gone & ~np.r_[False, gone[:-1]]
    edge[first[sizes > 0]] = gone[first[sizes > 0]]
    sums = lambda x: np.diff(np.r_[0, np.cumsum(x)[ends - 1] * (ends > 0)]) if total else sizes * 0
    removed, spans = sums(gone), sums(edge)
    rest = np.frombuffer(b"".join(whole), np.uint8)[~gone].tobytes()
    upto_left = np.cumsum(sizes - removed)
    kept = [t if not r else rest[e - (len(t) - r) : e] for t, r, e in zip(whole, removed.tolist(), upto_left.tolist(), strict=True)]
    return sizes, removed, spans, kept
