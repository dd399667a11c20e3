"""A count-min sketch that grows with the input: which windows a corpus may hold more than once.

A window is counted under two hashes: its group (an anchor that equal windows share) picks a block, its own value picks a cell of each
row inside the block. A further row counts the groups, once a run of windows, as a window repeats only if its group does. All that a
window needs to look up thus lies in one block. Each partition makes its own sketch; sketches are
merged block by block by saturating addition (never, once, more often). Counts are overestimated at worst, so nothing that repeats is
missed. Cells are as many as the number of windows asks for, so that the share of once-only windows which pass stays the same at any
size, and blocks, of bounded size, are as many as tasks can share.

The merged sketch is a table of blocks. Up to a checked size it is broadcast; beyond it the windows' rows are dealt by block and meet
their block there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record, small_batches, stored, texts, to_arrow
from .windows import mix

#: Rows of the sketch, and windows a cell of a row has at most on average: (1 - exp(-LOAD)) ** ROWS, 4 %, of once-only windows pass, and
#: of those whose group occurs once about 2 %; windows of a run at least, about, so that the row of groups needs fewer cells.
ROWS, LOAD, RUN = 3, 0.42, 4
#: Blocks of a sketch, at least about, and cells of a block's row, at most.
BLOCKS, BLOCK_CELLS = 1024, 1 << 24
#: Windows that a task gathers before it hands on its sketch.
GATHERED = 2_500_000
#: Bytes up to which a merged sketch is broadcast; beyond that, parts in which the rows of a block that counts HOT times the mean meet it.
BROADCAST_BYTES, SALTS, HOT = 160 << 20, 64, 4
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


@dataclass(frozen=True)
class Shape:
    blocks: int
    rows: tuple[int, ...]  # the cells of a block's rows, multiples of eight: ROWS of windows, and one of groups if they are counted

    @property
    def size(self) -> int:
        """Bytes of a block."""
        return sum(self.rows) // 8

    @property
    def bytes(self) -> int:
        return self.blocks * self.size

    def block(self, group: np.ndarray) -> np.ndarray:
        return ((mix(group ^ np.uint64(0x165667B19E3779F9)) >> np.uint64(32)) * np.uint64(self.blocks)) >> np.uint64(32)

    def in_turn(self, group: np.ndarray, turn: int, turns: int) -> np.ndarray:
        """Which windows meet the sketch in a turn, by their blocks."""
        return self.block(group) % np.uint64(turns) == np.uint64(turn)

    def cell(self, x: np.ndarray, row: int) -> np.ndarray:
        """x: the windows' values, in the last row their groups."""
        return ((mix(x * _MULTIPLIERS[row]) >> np.uint64(32)) * np.uint64(self.rows[row])) >> np.uint64(32)


def shaped(windows: int, groups: bool) -> Shape:
    """The sketch for so many windows."""
    cells = max(1, math.ceil(windows / LOAD))
    blocks = max(1, min(BLOCKS, cells >> 12), -(-cells // BLOCK_CELLS))
    eights = lambda n: max(8, 8 * -(-n // (8 * blocks)))
    return Shape(blocks, (eights(cells),) * ROWS + ((eights(cells // RUN),) if groups else ()))


def pack(seen: np.ndarray, more: np.ndarray) -> bytes:
    """Ascending cells and, of each, whether it was seen more than once. Of a gap, as many low bits as make the rest small stand apart,
    the rest is a byte, and what doesn't fit into one stands apart too."""
    gap = np.diff(seen, prepend=np.uint32(0))
    low = min(8, max(0, int(gap.mean() / 24).bit_length() - 1)) if len(gap) else 0
    rest = gap >> low
    wide = rest >= 255
    bits = np.unpackbits((gap & 255).astype(np.uint8)[:, None], axis=1, bitorder="little")[:, :low]
    parts = np.minimum(rest, 255).astype(np.uint8).tobytes(), rest[wide].astype(np.uint32).tobytes(), np.packbits(more).tobytes(), np.packbits(bits).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(seen), int(wide.sum()), low], np.uint32).tobytes() + b"".join(parts))


def unpack(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(x)
    n, wide, low = np.frombuffer(raw, np.uint32, 3).tolist()
    at = 12 + n + 4 * wide
    rest = np.frombuffer(raw, np.uint8, n, 12).astype(np.uint32)
    rest[rest == 255] = np.frombuffer(raw[12 + n : at], np.uint32)
    more = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), at), count=n).astype(bool)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, offset=at + -(-n // 8)), count=n * low).reshape(n, low)
    gap = (rest << np.uint32(low)) + (bits.astype(np.uint32) << np.arange(low, dtype=np.uint32)).sum(1, dtype=np.uint32)
    return np.cumsum(gap, dtype=np.uint32), more


def sketched(group: np.ndarray, value: np.ndarray, first: np.ndarray, shape: Shape) -> Iterator[tuple[int, int, bytes, int]]:
    """The sketch of what was counted: by block and row, the cells seen and which of them more than once, and with the first row how many.
    Some blocks are done at a time, so that little is held beside what was counted."""
    block = shape.block(group)
    begins = np.zeros(len(group), bool)
    begins[first] = True
    step = -(-shape.blocks // 8)
    for low in range(0, shape.blocks, step):
        some = np.flatnonzero((block >= np.uint64(low)) & (block < np.uint64(low + step)))
        own, g, v, run = block[some], group[some], value[some], begins[some]
        counts = np.bincount((own - np.uint64(low)).astype(np.int64), minlength=1)
        at = np.flatnonzero(counts)
        for row, size in enumerate(shape.rows):
            key = own * np.uint64(size) + shape.cell(v, row) if row < ROWS else own[run] * np.uint64(size) + shape.cell(g[run], row)
            key.sort()
            fresh = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            seen, more = key[fresh], np.diff(np.r_[fresh, len(key)]) > 1
            lo, hi = (np.searchsorted(seen, (low + at + k).astype(np.uint64) * np.uint64(size)) for k in (0, 1))
            for b, i, j in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
                yield low + b, row, pack((seen[i:j] - np.uint64((low + b) * size)).astype(np.uint32), more[i:j]), 0 if row else int(counts[b])


class Sketch:
    """The merged sketch: table (block int, n long: windows counted, bits binary: for each row a bit a cell, set if seen more than once)."""

    def __init__(self, shape: Shape, table: DataFrame, broadcast_bytes: int = BROADCAST_BYTES):
        self.shape, self.table = shape, table
        self.small = shape.bytes <= broadcast_bytes

    def broadcast(self):  # noqa: ANN201
        """For tasks of a small sketch: lookup() -> function of (groups, values), True where estimated repeated."""
        shape, size = self.shape, self.shape.size
        bits = np.zeros(shape.bytes, np.uint8)
        for r in self.table.toLocalIterator():  # broadcast_bytes in all, at most
            bits[r.block * size : (r.block + 1) * size] = np.frombuffer(r.bits, np.uint8)
        held = self.table.sparkSession.sparkContext.broadcast(bits.tobytes())

        def lookup() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
            found = np.frombuffer(held.value, np.uint8)
            return lambda group, value: estimated(found, shape, shape.block(group), group, value)

        return lookup

    def dealt(self, docs: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kinds: str, each: Callable[[pa.RecordBatch, Callable], Iterator[pa.RecordBatch]], schema: str, turn: int = 0, turns: int = 1) -> DataFrame:
        """For a large sketch: what rows() makes of docs' batches (kinds: its columns, the group as a long `anchor` among them) is dealt by
        block and meets the sketch there; each(batch, lookup) says what becomes of it. Rows of a block that holds a common group are dealt
        over several parts, each with the block's bits. In one of several turns only rows of its own blocks (in_turn) are to come."""
        shape, fields = self.shape, [field.split() for field in kinds.split(",")]
        names = [name for name, _ in fields]
        at = names.index("anchor")
        mean = max(1.0, self.table.agg(F.sum("n")).first()[0] or 0) / shape.blocks
        hot = self.table.where(F.col("n") > HOT * mean).select("block", "n").collect()  # a HOT-th of the blocks, at most
        parts = np.ones(shape.blocks, np.int32)
        for r in hot:
            parts[r.block] = min(SALTS, math.ceil(r.n / mean))
        held = docs.sparkSession.sparkContext.broadcast(parts.tobytes())

        def addressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            salts = np.frombuffer(held.value, np.int32)
            for b in rows(batches):  # in one Python step: a task with two would have two workers
                block = shape.block(b.column(at).to_numpy().view(np.uint64)).astype(np.int32)
                salt = (np.arange(len(block)) % salts[block]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block), pa.array(salt)], names=[*names, "_block", "_salt"])

        salted = docs.mapInArrow(addressed, f"{kinds}, _block int, _salt int").withColumn("_bits", F.lit(None).cast("binary"))
        none = [F.lit(None).cast(kind).alias(name) for name, kind in fields]
        most = F.when(F.col("n") > HOT * mean, F.least(F.lit(SALTS), F.ceil(F.col("n") / mean))).otherwise(1).cast("int")
        blocks = self.table.where(F.col("block") % turns == turn).select(*none, F.col("block").alias("_block"), F.explode(F.sequence(F.lit(0), most - 1)).alias("_salt"), F.col("bits").alias("_bits"))
        k = len(names)

        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, bits = None, None
            for b in batches:
                block, salt = b.column(k).to_numpy(), b.column(k + 1).to_numpy()
                edge = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (salt[1:] != salt[:-1])]).tolist()
                for lo, hi in zip(edge, [*edge[1:], len(block)], strict=True):
                    part = b.slice(lo, hi - lo)
                    if here != (here := (int(block[lo]), int(salt[lo]))):
                        bits = None
                    if part.column(k + 2)[0].is_valid:  # the block's bits stand first
                        bits, part = np.frombuffer(part.column(k + 2)[0].as_py(), np.uint8), part.slice(1)
                    if part.num_rows and bits is not None:
                        yield from each(part.select(names), lambda group, value: estimated(bits, shape, np.zeros(len(group), np.uint64), group, value))  # noqa: B023

        both = salted.unionByName(blocks)
        return both.repartition("_block", "_salt").sortWithinPartitions("_block", "_salt", F.col("_bits").isNull()).mapInArrow(met, schema)


def estimated(bits: np.ndarray, shape: Shape, block: np.ndarray, group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which windows the sketch counts more than once; block: the number of each one's block in bits."""
    kept = np.ones(len(value), bool)
    first = np.cumsum(shape.rows) - shape.rows
    for row in range(len(shape.rows) - 1, -1, -1):
        at = np.flatnonzero(kept)
        cell = block[at] * np.uint64(8 * shape.size) + np.uint64(first[row]) + shape.cell((value if row < ROWS else group)[at], row)
        kept[at] = (bits[cell >> np.uint64(3)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & 1 == 1
    return kept


def sketch(docs: DataFrame, counter: Callable[[], Callable[[list[bytes]], tuple[np.ndarray, ...]]], windows: int, broadcast_bytes: int = BROADCAST_BYTES, groups: bool = False) -> Sketch:
    """counter() gives a task's function from the whole texts of a batch to the groups and values to count, as often as they count, and
    where runs begin, which is what groups are counted by, if they are; windows: about how many there are in all."""
    shape = shaped(windows, groups)
    schema, merged = "block int, row int, seen binary, n long", "block int, n long, bits binary"
    arrow, out = to_arrow(schema), to_arrow(merged)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, parts, n = counter(), [], 0

        def handed() -> Iterator[pa.RecordBatch]:
            nonlocal parts, n
            group, value, first = map(np.concatenate, zip(*parts, strict=True))
            parts, n = [], 0
            for rows in batched(sketched(group, value, first, shape), 512):
                yield record(dict(zip(arrow.names, zip(*rows, strict=True), strict=True)), arrow)

        for batch in batches:
            group, value, first = count(texts(batch))
            if len(value):
                parts.append((group, value, first + n))
                n += len(value)
            if n > GATHERED:
                yield from handed()
        if parts:
            yield from handed()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, edges = None, 0, np.cumsum(shape.rows)[:-1]
        seen, more = np.zeros(sum(shape.rows), bool), np.zeros(sum(shape.rows), bool)
        seen_of, more_of = np.split(seen, edges), np.split(more, edges)

        def done() -> pa.RecordBatch:
            return record({"block": [now], "n": [total], "bits": [np.packbits(more).tobytes()]}, out)

        for batch in batches:
            for block, row, packed, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if now != block:
                    if now is not None:
                        yield done()
                    now, total = block, 0
                    seen[:], more[:] = False, False
                cells, again = unpack(packed)
                more_of[row][cells[again | seen_of[row][cells]]] = True
                seen_of[row][cells] = True
                total += n
        if now is not None:
            yield done()

    small_batches(docs.sparkSession)
    parts = docs.select("text").mapInArrow(partial, schema)
    return Sketch(shape, stored(parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, merged), "sketch"), broadcast_bytes)

