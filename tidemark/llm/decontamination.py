"""Benchmark decontamination by spaced-seed hashing.

A test window is 13 consecutive tokens of a benchmark item (a shorter item of at least five tokens is one window). A training window
overlaps it if at least 0.8 of the tokens are equal, place by place: two of 13 may be substituted. Places are dealt into two groups
more than may differ; each mask keeps two groups and ignores the rest, so for any allowed set of substitutions some mask ignores all
of them. Masked hashes of test and training windows are joined, and each hit is verified on the tokens around it.

What training rows are compared with before the join are bitmaps of fixed size (of test tokens and of test hashes); they may pass
rows on needlessly, never hold one back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record, small_batches, stored, texts, to_arrow
from .windows import WordHashes, mix

WINDOW, LEAST_TOKENS, SHARE = 13, 5, 0.8
#: Bits of either bitmap, as a power of two; and test hashes up to which the join is a broadcast join.
BITMAP_BITS, BROADCAST_ROWS = 23, 200_000
_PUNCTUATION = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased; ASCII punctuation and white space part tokens."""
    return text.decode("utf-8", "replace").lower().encode().translate(_PUNCTUATION).split()


def needed(n: int) -> int:
    return math.ceil(SHARE * n - 1e-9)


def masks(n: int) -> list[np.ndarray]:
    """The kept places of each mask for windows of n tokens."""
    groups = n - needed(n) + 2
    return [np.flatnonzero(np.isin(np.arange(n) % groups, kept)) for kept in combinations(range(groups), 2)]


def masked_hash(h: np.ndarray, at: np.ndarray, kept: np.ndarray, salt: int) -> np.ndarray:
    out = np.full(len(at), salt, np.uint64)
    for p in kept:
        out = (out ^ h[at + p]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return mix(out)


def cell(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


SPACED = "id long, n int, mask int, hash long, pos int, window binary"


def spaced(batches: Iterator[pa.RecordBatch], lengths: list[int] | None, vocabulary: np.ndarray | None, hashed: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) -> the masked hashes of their windows: of test items (lengths None: each its own length) or of training rows."""
    arrow, table = to_arrow(SPACED), WordHashes()
    family = {n: masks(n) for n in (lengths or range(LEAST_TOKENS, WINDOW + 1))}
    for batch in batches:
        cols: list[list] = [[] for _ in range(6)]
        for i, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
            h = table.of(tokens(t))
            known = None if vocabulary is None else np.r_[0, np.cumsum(vocabulary[cell(h)])]
            for n in lengths or ([min(WINDOW, len(h))] if len(h) >= LEAST_TOKENS else []):
                at = np.arange(len(h) - n + 1) if known is None else np.flatnonzero(known[n:] - known[:-n] >= needed(n)) if len(h) >= n else np.zeros(0, np.int64)
                if not len(at):
                    continue
                for m, kept in enumerate(family[n]):
                    value = masked_hash(h, at, kept, n * 64 + m)
                    hit = np.arange(len(at)) if hashed is None else np.flatnonzero(hashed[cell(value)])
                    for c, v in zip(cols, ([i] * len(hit), [n] * len(hit), [m] * len(hit), value[hit].view(np.int64).tolist(), at[hit].tolist(), [h[a : a + n].tobytes() for a in at[hit].tolist()]), strict=True):
                        c.extend(v)
        if cols[0]:
            yield record(dict(zip(arrow.names, cols, strict=True)), arrow)


def bitmap(cells: DataFrame) -> np.ndarray:
    """From rows (cell int): a bitmap of fixed size."""
    out = np.zeros(1 << BITMAP_BITS, np.uint8)
    for r in cells.select("cell").distinct().toLocalIterator():  # 2^BITMAP_BITS values at most
        out[r.cell] = 1
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (row long, text) -> row, item_id, pos, n: each training window that overlaps a window of an item."""
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    test = stored(items.mapInArrow(lambda it: spaced(it, None, None, None), SPACED), "spaced-test")
    cells = to_arrow("cell int")

    def of(column: str):  # noqa: ANN202
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64) if column == "window" else b.column(0).to_numpy().view(np.uint64)
                yield record({"cell": np.unique(cell(h)).astype(np.int32)}, cells)

        return bitmap(test.select(column).mapInArrow(each, "cell int"))

    vocabulary, hashed = of("window"), of("hash")
    lengths = sorted(r.n for r in test.select("n").distinct().collect())  # WINDOW values at most
    held = docs.sparkSession.sparkContext.broadcast((np.packbits(vocabulary).tobytes(), np.packbits(hashed).tobytes()))  # of fixed size

    def training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, x = (np.unpackbits(np.frombuffer(b, np.uint8)) for b in held.value)
        if lengths:
            yield from spaced(batches, lengths, v.astype(np.int32), x)

    side = test.select("n", "mask", "hash", F.col("id").alias("item_id"), F.col("window").alias("test_window"))
    side = side.dropDuplicates(["n", "mask", "hash", "item_id", "test_window"])
    if side.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    hits = docs.select("row", "text").mapInArrow(training, SPACED).withColumnRenamed("id", "row").join(side, ["n", "mask", "hash"])
    # by expressions: a second Python step in the tasks of the first would be a second set of Python workers, which Spark keeps
    token = lambda c, i: F.substring(F.col(c), i * 8 + 1, F.lit(8))
    same = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.lit(0), lambda found, i: found + (token("window", i) == token("test_window", i)).cast("int"))
    least = F.element_at(F.array(*[F.lit(needed(n)) for n in range(1, WINDOW + 1)]), F.col("n"))
    return hits.where(same >= least).select("row", "item_id", "pos", "n").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, first_token, last_token: each document with each benchmark item that it overlaps.

    Null and empty texts, items of fewer than five tokens and null item ids overlap nothing; a null doc_id is reported as null;
    repeated rows are reported once; other columns are left behind; empty tables give no rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("row"), F.col("text").cast("string").alias("text"))
    found = overlaps(rows, benchmark).groupBy("row", "item_id")
    return found.agg(F.countDistinct("pos").alias("n_windows"), F.min("pos").alias("first_token"), F.max(F.col("pos") + F.col("n") - 1).alias("last_token")).withColumnRenamed("row", "doc_id")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that overlap no benchmark item; a null doc_id shields no row."""
    row = F.xxhash64(F.col("doc_id"), F.col("text"))
    found = overlaps(docs.select(row.alias("row"), F.col("text").cast("string").alias("text")), benchmark).select(F.col("row").alias("_row")).distinct()
    return docs.join(found, row == F.col("_row"), "left_anti")
