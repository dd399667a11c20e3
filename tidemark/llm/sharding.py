"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots (4,096 by default), bytes are summed per slot, and a versioned
slot-to-shard map says which shard holds a slot. Rebalancing edits the map and writes it as a new version; records never
rehash. All work on rows is DataFrame expressions; only the slot table (one row a slot, so of fixed size) reaches the driver.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, insort

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_dir, stored

SLOTS = 4096


def with_slot(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Adds virtual_slot (hash of doc_id and text: rows that share an id, or have none, are spread too) and size (UTF-8 bytes of the text,
    null as none, plus 1)."""
    return docs.withColumns({
        "virtual_slot": F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(slots)).cast("int"),
        "size": (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"),
    })


def slot_bytes(slotted: DataFrame) -> DataFrame:
    """Bytes and rows per virtual slot: at most one row a slot, summed map-side first."""
    return slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def rebalance(current: list[int], loads: list[int], shards: int, slack: float = 0.001) -> list[int]:
    """Edits a slot-to-shard map so that shards hold near equal bytes, and moves few slots.

    Slots of shards that are gone go first, heaviest first, each to the lightest shard. Then, while a shard is heavier than the lightest by
    more than `slack` of the mean, the slot whose move, or the two slots whose exchange, comes nearest to making the two equal changes
    hands, from the heaviest shard that has such a slot; all other slots stay where they are."""
    new, at = list(current), [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]  # (load, slot), sorted
    homeless = []
    for slot, home in enumerate(current):
        if 0 <= home < shards:
            held[home].append((loads[slot], slot))
            at[home] += loads[slot]
        else:
            homeless.append((loads[slot], slot))
    for h in held:
        h.sort()

    def put(load: int, slot: int, shard: int) -> None:
        insort(held[shard], (load, slot))
        at[shard] += load
        new[slot] = shard

    def take(load: int, slot: int, shard: int) -> None:
        held[shard].remove((load, slot))
        at[shard] -= load

    for load, slot in sorted(homeless, key=lambda x: (-x[0], x[1])):
        put(load, slot, min(range(shards), key=lambda k: (at[k], k)))
    def change(high: int, low: int) -> tuple | None:
        """The slot to go from high to low, and the one to come back or None: what leaves the two nearest to equal; None if nothing helps."""
        gap = at[high] - at[low]
        best, there = (gap, None), [x for x, _ in held[low]]
        for a in held[high]:
            options = [(a[0], None)]  # a move; then the exchanges that come nearest to half of the gap
            i = bisect_left(there, a[0] - gap // 2)
            options += [(a[0] - held[low][k][0], held[low][k]) for k in (i - 1, i) if 0 <= k < len(there)]
            for moved, back in options:
                if (left := abs(gap - 2 * moved) + (0.02 * gap if back else 0)) < best[0]:  # a move is preferred to a like exchange
                    best = (left, (a, back))
        return best[1]

    for _ in range(4 * len(loads)):
        low = min(range(shards), key=lambda k: (at[k], k))
        heavy = sorted((k for k in range(shards) if at[k] - at[low] > slack * sum(at) / shards), key=lambda k: (-at[k], k))
        found = next(((high, x) for high in heavy if (x := change(high, low))), None)  # a shard may have one slot too large to go
        if found is None:
            break
        high, (a, back) = found
        take(*a, high)
        if back:
            take(*back, low)
            put(*back, high)
        put(*a, low)
    return new


def map_table(spark: SparkSession, shard_of: list[int]) -> DataFrame:
    """The map as rows (virtual_slot, shard), made from one literal inside the JVM."""
    packed = F.split(F.lit(",".join(map(str, shard_of))), ",")
    return spark.range(1).select(F.posexplode(packed).alias("virtual_slot", "s")).select(F.col("virtual_slot"), F.col("s").cast("int").alias("shard"))


class SlotMap:
    """A versioned slot-to-shard map, kept as Parquet, one folder a version, in the shared folder or under `path`. A map that is there
    already is taken up at its last version, so that an edit moves slots away from where they are."""

    def __init__(self, spark: SparkSession, shards: int, slots: int = SLOTS, path: str | None = None):
        self.spark, self.shards, self.slots, self.version = spark, shards, slots, 0
        self.path = path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
        stored = self._stored() if path else None
        if stored is not None:
            self.version, self.shard_of = stored
            self.slots, self.shards = len(self.shard_of), max(self.shard_of) + 1
        else:
            self.shard_of = [s % shards for s in range(slots)]
            self._write()

    def _stored(self) -> tuple[int, list[int]] | None:
        try:
            found = self.spark.read.schema("virtual_slot int, shard int, version int").parquet(self.path)
            last = found.agg(F.max("version")).first()[0]
        except AnalysisException:  # no folder yet
            return None
        if last is None:
            return None
        return last, [r.shard for r in found.where(F.col("version") == last).orderBy("virtual_slot").collect()]  # `slots` rows

    def _write(self) -> None:
        map_table(self.spark, self.shard_of).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={self.version}")

    def edit(self, loads: DataFrame, shards: int | None = None) -> SlotMap:
        """Writes the next version, rebalanced over the given slot bytes (and to another shard count, if given)."""
        of = [0] * self.slots
        for row in loads.select("virtual_slot", "bytes").collect():  # at most `slots` rows
            of[row.virtual_slot] = row.bytes
        self.shards = shards or self.shards
        self.shard_of = rebalance(self.shard_of, of, self.shards)
        self.version += 1
        self._write()
        return self

    def table(self, version: int | None = None) -> DataFrame:
        return self.spark.read.schema("virtual_slot int, shard int").parquet(f"{self.path}/version={self.version if version is None else version}")


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Puts every row into a shard so that the shards' sizes are near equal (law `bytes`), and numbers each shard's rows without gaps.

    Rows are numbered inside their virtual slot (thousands of small window partitions); the slots before it in the shard give the
    offset, from a table of one row a slot. Null and empty texts have size 1; repeated rows are rows of their own; other columns
    pass through unless they are named like a column of the result, which then holds the result; an empty table gives no rows. With a
    path the map kept there is edited, and a later call goes on from it; else a map is begun for this call."""
    taken = {"virtual_slot", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "_in_slot", "_before"}
    held = SlotMap(docs.sparkSession, shards, slots, path)
    rows = with_slot(docs.drop(*[c for c in docs.columns if c in taken]), held.slots)
    of_slot = stored(slot_bytes(rows).select("virtual_slot", "rows", "bytes"), "slot-bytes")  # read by the edit and by the join
    held.edit(of_slot, shards)
    in_shard = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)  # over one row a slot
    placed = held.table().join(of_slot, "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(in_shard), F.lit(0)).alias("_before"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    lean = rows.withColumn("text_crc32", crc).drop("text")
    numbered = lean.withColumn("_in_slot", F.row_number().over(W.partitionBy("virtual_slot").orderBy(F.col("doc_id"), F.col("text_crc32"), F.col("size"))))
    return (
        numbered.join(F.broadcast(placed), "virtual_slot")  # `slots` rows at most
        .withColumn("slot", F.col("_before") + F.col("_in_slot") - 1)
        .withColumn("law", F.lit("bytes"))
        .withColumn("grown_shard", F.lit(None).cast("int"))
        .drop("_before", "_in_slot")
    )
