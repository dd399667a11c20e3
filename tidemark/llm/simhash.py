"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits from the XXH64 hashes of a text's word shingles. Every bit position gets a vector of radius + 1 bits;
each non-zero vector v of that length gives one table, whose mask keeps the positions whose vector has an odd product with v.
The positions in which two fingerprints within the radius differ span at most `radius` dimensions, so some v is orthogonal to
all of them: in that table both agree on every bit kept. 2^(radius+1) - 1 tables thus lose no pair within the radius.

Documents with one fingerprint are one node. Buckets are walked as spanning trees, never as all pairs, and a bucket with more
nodes than a bound is covered once more on the bits that its mask leaves free, until it is small; this again loses no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, documents, map_batches, small_batches, stored, texts, unused
from .components import connected_components

SHINGLE, RADIUS, SEED = 4, 4, 42
FULL = (1 << 64) - 1
#: Nodes of one bucket that one task walks at once; larger buckets are covered again.
BUCKET = 4096


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    """Lower-cases A-Z; words are runs of bytes other than space and 0x09-0x0D; a text of fewer words is one shingle, none gives 0."""
    w = text.lower().split()
    if not w:
        return 0
    line = b" ".join(w)
    lengths = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = max(1, len(w) - words + 1)
    last = ends[min(words, len(w)) - 1 :]
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(line[a:b], SEED) for a, b in zip(starts[:k].tolist(), last.tolist(), strict=True)), np.uint64, k)
    counts = np.zeros(64, np.int64)
    for i in range(0, k, 1 << 16):
        bits = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > k, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row; null text has no words."""

    def each(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "fp": np.array([fingerprint(t, words) for t in texts(batch)], np.uint64).view(np.int64)}

    return map_batches(documents(docs), each, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, within: int = FULL) -> list[int]:
    """The masks that cover every set of `radius` positions among the bits of `within`. Positions take vectors in turn, so that each
    mask keeps about half of the bits."""
    positions = [p for p in range(64) if within >> p & 1]
    vectors = [1 + (7 * i) % ((1 << (radius + 1)) - 1) for i in range(len(positions))]
    return [sum(1 << p for p, m in zip(positions, vectors, strict=True) if bin(m & v).count("1") % 2) for v in range(1, 1 << (radius + 1))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def walk(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the distinct fingerprints of one bucket, linked at `radius` or fewer differing bits: positions (from, to)."""
    left, src, dst = np.arange(len(fp)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= radius
            if near.any():
                found = left[near]
                src.append(np.full(len(found), at))
                dst.append(found)
                queue.extend(found.tolist())
                left = left[~near]
    none = np.zeros(0, np.int64)
    return (np.concatenate(src), np.concatenate(dst)) if src else (none, none)


def bucket_links(frames: Iterator[pd.DataFrame], radius: int, most: int) -> Iterator[pd.DataFrame]:
    """frames (mask, key, fp), sorted by mask and key: links inside buckets; members of buckets over `most` come back to be covered
    again (again: the mask; 0 for a link). A bucket that outgrows `most` is handed on as it comes, so none is held whole."""

    def again(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"src": x["fp"], "dst": x["fp"], "again": x["mask"]})

    def coverable(mask: int) -> bool:
        """Whether a bucket of this mask can be covered on finer masks; if not it has at most 2^12 nodes, which is one walk."""
        return bin(mask & FULL).count("1") < 52

    def each(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
        mask, key, fp = (x[c].to_numpy(np.int64) for c in ("mask", "key", "fp"))
        unsigned = fp.view(np.uint64)  # bitwise_count counts the bits of a signed number's absolute value
        edge = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]), True])
        size = np.diff(edge)
        out = []
        two = edge[:-1][size == 2]
        close = two[np.bitwise_count(unsigned[two] ^ unsigned[two + 1]) <= radius]
        out.append(pd.DataFrame({"src": fp[close], "dst": fp[close + 1], "again": 0}))
        for a, n in zip(edge[:-1][size > 2], size[size > 2], strict=True):
            some = fp[a : a + n]
            if n > most and coverable(int(mask[a])):
                out.append(again(x.iloc[a : a + n]))
            else:
                i, j = walk(unsigned[a : a + n], radius)
                out.append(pd.DataFrame({"src": some[i], "dst": some[j], "again": 0}))
        got = pd.concat(out, ignore_index=True)
        if len(got):
            yield got

    held: list[pd.DataFrame] = []  # the bucket that may go on
    bucket, large = None, False
    for x in frames:
        last = int(x["mask"].iloc[-1]), int(x["key"].iloc[-1])
        mask, key = x["mask"].to_numpy(), x["key"].to_numpy()
        if bucket is not None:
            own = int(((mask == bucket[0]) & (key == bucket[1])).sum())  # sorted, so at the start
            first, x = x.iloc[:own], x.iloc[own:]
            if own and large:
                yield again(first)
            elif own:
                held.append(first)
            if len(x) and held:
                yield from each(pd.concat(held, ignore_index=True))
            if len(x):
                held, large = [], False
        if len(x):
            cut = int(len(x) - ((x["mask"] == last[0]) & (x["key"] == last[1])).to_numpy().sum())
            if cut:
                yield from each(x.iloc[:cut])
            held, bucket = [x.iloc[cut:]], last
        if not large and sum(map(len, held)) > most and coverable(bucket[0]):
            yield again(pd.concat(held, ignore_index=True))
            held, large = [], True
    if held:
        yield from each(pd.concat(held, ignore_index=True))


def links(nodes: DataFrame, radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """nodes (fp long, distinct) -> links (src, dst) that connect every pair of fingerprints at `radius` or fewer differing bits."""
    masks = [signed(m) for m in covering_masks(radius)]
    level = nodes.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
    found = None
    while True:
        keyed = level.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        dealt = keyed.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        got = stored(dealt.mapInPandas(lambda it: bucket_links(it, radius, most), "src long, dst long, again long"), "bucket-links")
        new = got.where("again = 0").select("src", "dst")
        found = new if found is None else found.unionByName(new)
        large = [r.again for r in got.where("again <> 0").select("again").distinct().collect()]  # masks: 31 to the power of the level, at most
        if not large:
            return found.distinct()
        finer = [(m, [(m & FULL) | x for x in covering_masks(radius, FULL & ~m)]) for m in large]
        per_mask = F.create_map(*[x for m, ms in finer for x in (F.lit(m).cast("long"), F.array(*[F.lit(signed(s)).cast("long") for s in ms]))])
        level = got.where("again <> 0").select(F.col("src").alias("fp"), F.explode(per_mask[F.col("again")]).alias("mask"))


def components(nodes: DataFrame, radius: int) -> DataFrame:
    """nodes (fp, least: anything with an order) -> fp, least, part: nodes linked within the radius share a part. Written out, so that a
    join with it by `part` or `fp` has an exchange of its own, which Spark can split where one key is hot."""
    parts = connected_components(links(nodes.select("fp"), radius))
    return stored(nodes.join(parts.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("part")), "parts")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links) of every row.

    Texts without words have fingerprint zero and are linked like any other. Repeated rows stay; a null doc_id is never a
    component's name unless the component has no other id (then null). Other columns are left behind."""
    fps = stored(fingerprints(docs, words), "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    of = components(nodes, radius)
    names = stored(of.groupBy("part").agg(F.min("least").alias("component_id")), "names")
    named = stored(of.select("fp", "part").join(names, "part").select("fp", "component_id"), "named")
    discard(nodes, of, names)
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE) -> DataFrame:
    """docs without near copies, with all their columns: of each component the row of its smallest doc_id; of several such rows the one
    of least text hash, of repeated rows one. A row without an id stays only where its component has no row with one."""
    fp, row = unused(docs, "fp"), unused(docs, "row")
    schema = T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t, words) for t in texts(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints)], names=[*b.schema.names, fp])

    small_batches(docs.sparkSession)
    rows = stored(docs.mapInArrow(each, schema).withColumn(row, F.monotonically_increasing_id()), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"), F.col(row).alias("row"))
    nodes = stored(rows.select(F.col(fp).alias("fp"), order.alias("o")).groupBy("fp").agg(F.min("o").alias("least")), "nodes")
    kept = components(nodes, radius).groupBy("part").agg(F.min("least").alias("least")).select(F.col("least.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)
