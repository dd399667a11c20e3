"""A store of bars whose commits replace blocks as a whole: late and changed bars, streams that come again, and reads that reach back.

Bars lie in folders by commit, series and block of time. A commit writes its blocks to a folder of its own and then a manifest: which
blocks there are, in which commit, how many bars each holds, and which epoch of which stream came last. Renaming the manifest into place
is the commit, so one that is broken off leaves nothing behind that a reader sees, and of two at once one fails. A manifest has a row
a block, never one a bar.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.bars import KEYS
from .files import BAR_SCHEMA, block_of

NEW, EXTENDED, REPLACED, INCOMPATIBLE = "new", "extended", "replaced", "incompatible"


class BlockStore:
    """Series of bars of one interval under a path that driver and executors share. schema: the bars' columns and types, `ending` and the
    keys (texts) among them."""

    def __init__(self, spark: SparkSession, path: str, interval: str, schema: str = BAR_SCHEMA, keys: list[str] = KEYS):
        self.spark, self.path, self.interval, self.keys = spark, path.rstrip("/"), interval, list(keys)
        self.columns = spark.createDataFrame([], schema).schema
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = lambda name: hadoop.Path(f"{self.path}/{name}")
        self._files = self._at("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    # manifests

    def _number(self) -> int:
        """That of the latest manifest, 0 without one."""
        if not self._files.exists(self._at("manifests")):
            return 0
        names = [f.getPath().getName() for f in self._files.listStatus(self._at("manifests"))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _manifest(self, number: int, part: str, schema: str) -> DataFrame:
        if not number:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/manifests/{number}/{part}")

    def _blocks(self, number: int) -> DataFrame:
        keys = "".join(f"`{k}` string, " for k in self.keys)
        return self._manifest(number, "blocks", f"{keys}block string, commit string, bars long, first timestamp, last timestamp, live boolean")

    def _streams(self, number: int) -> DataFrame:
        return self._manifest(number, "streams", "stream string, epoch long")

    def blocks(self) -> DataFrame:
        """The blocks there are: keys, block, commit, bars (their number), first and last (endings)."""
        return self._blocks(self._number()).where("live").drop("live")

    # reads

    def block(self, ending: Column) -> Column:
        return F.concat(F.lit("b"), block_of(ending, self.interval))

    def _data(self, blocks: DataFrame, where: Column) -> DataFrame:
        """Bars with commit and block, of live blocks: folders of other commits are not listed as read, and of these commits blocks that
        a later one has replaced are left out."""
        chosen = blocks.where(where)
        commits = sorted(r.commit for r in chosen.where("live").select("commit").distinct().collect())  # no more than there are blocks to read
        schema = T.StructType([*self.columns.fields, T.StructField("commit", T.StringType()), T.StructField("block", T.StringType())])
        if not commits:
            return self.spark.createDataFrame([], schema)
        bars = self.spark.read.schema(schema).parquet(f"{self.path}/blocks").where(F.col("commit").isin(commits) & where)
        gone = chosen.where(~F.col("live") & F.col("commit").isin(commits)).select("commit", *self.keys, "block")
        return bars.join(gone, ["commit", *self.keys, "block"], "left_anti") if gone.limit(1).count() else bars

    def reach(self, begin: str, bars: int, where: Column | None = None) -> str | None:
        """The block from which on each series has so many bars before begin's block (or all that it has); None if there are none. where:
        a condition of the keys."""
        at = self.block(F.lit(begin).cast("timestamp"))
        later = F.sum("bars").over(W.partitionBy(*self.keys).orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, 0)) - F.col("bars")  # rows are blocks
        blocks = self.blocks() if where is None else self.blocks().where(where)
        needed = blocks.where(F.col("block") < at).withColumn("_later", later).where(F.col("_later") < bars)
        return needed.agg(F.min("block").alias("b")).first().b

    def read(self, begin: str | None = None, end: str | None = None, bars_before: int | None = 0, where: Column | None = None) -> DataFrame:
        """Bars up to end, from begin on, and of each series at least bars_before more before it (None: all of them); where: a condition of
        the keys. Blocks outside aren't read."""
        blocks = self._blocks(self._number())
        wanted = F.lit(True) if where is None else where
        at = lambda t: F.lit(t).cast("timestamp")
        if begin is not None and bars_before is not None:
            first = self.reach(begin, bars_before, where) if bars_before else None
            edge = self.block(at(begin))
            wanted = wanted & (F.col("block") >= (edge if first is None else F.least(edge, F.lit(first))))
        if end is not None:
            wanted = wanted & (F.col("block") <= self.block(at(end)))
        bars = self._data(blocks, wanted)
        if begin is not None and bars_before == 0:
            bars = bars.where(F.col("ending") >= at(begin))
        if end is not None:
            bars = bars.where(F.col("ending") <= at(end))
        return bars.select(*self.columns.names)

    # commits

    def applied(self, stream: str, epoch: int) -> bool:
        """Whether this epoch of the stream, or a later one, is in the store. Epochs of different streams have nothing to do with each other."""
        return self._streams(self._number()).where((F.col("stream") == stream) & (F.col("epoch") >= epoch)).limit(1).count() > 0

    def _commit(self, number: int, bars: DataFrame, replaced: Callable[[DataFrame], DataFrame], stream: str | None, epoch: int | None) -> None:
        """Writes bars as blocks and the manifest after `number`; replaced(blocks) are those that go."""
        commit = uuid.uuid4().hex
        out = bars.select(*[F.col(c).cast(self.columns[c].dataType).alias(c) for c in self.columns.names]).withColumn("block", self.block(F.col("ending")))
        target = f"{self.path}/blocks/commit={commit}"
        out.repartition(*self.keys, "block").sortWithinPartitions(*self.keys, "block", "ending").write.partitionBy(*self.keys, "block").parquet(target)
        old = self._blocks(number)
        written = self.spark.read.schema(out.schema).parquet(target)
        new = written.groupBy(*self.keys, "block").agg(F.lit(commit).alias("commit"), F.count(F.lit(1)).alias("bars"), F.min("ending").alias("first"), F.max("ending").alias("last"), F.lit(True).alias("live"))
        gone = replaced(old.where("live")).select(*self.keys, "block", F.lit(True).alias("_gone"))
        kept = old.join(gone, [*self.keys, "block"], "left").withColumn("live", F.col("live") & F.col("_gone").isNull()).drop("_gone")
        self._swap(number, kept.unionByName(new), stream, epoch)

    def _swap(self, number: int, blocks: DataFrame, stream: str | None, epoch: int | None) -> None:
        streams = self._streams(number)
        if stream is not None:
            streams = streams.where(F.col("stream") != stream).unionByName(self.spark.createDataFrame([(stream, epoch)], streams.schema))
        made = f"_made-{uuid.uuid4().hex}"
        blocks.write.parquet(f"{self.path}/manifests/{made}/blocks")
        streams.coalesce(1).write.parquet(f"{self.path}/manifests/{made}/streams")
        place = self._at(f"manifests/{number + 1}")
        if self._files.exists(place) or not self._files.rename(self._at(f"manifests/{made}"), place):
            self._files.delete(self._at(f"manifests/{made}"), True)
            raise RuntimeError("another commit came first; read the store again and repeat")

    def _recent(self, number: int, series: DataFrame) -> DataFrame:
        """The last bar and the one before it of series (their keys): _last and _second, structs; null where there are none."""
        blocks = self._blocks(number)
        later = F.sum("bars").over(W.partitionBy(*self.keys).orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, 0)) - F.col("bars")
        tail = blocks.where("live").join(series, self.keys, "left_semi").withColumn("_later", later).where("_later < 2").select(*self.keys, "block")
        bars = self._data(blocks, F.lit(True)).join(tail, [*self.keys, "block"], "left_semi")
        rest = [c for c in self.columns.names if c not in self.keys]
        nth = F.row_number().over(W.partitionBy(*self.keys).orderBy(F.desc("ending")))  # rows of the last blocks only
        two = bars.select(*self.keys, F.struct(*rest).alias("_bar"), nth.alias("_n")).where("_n <= 2")
        return two.groupBy(*self.keys).agg(F.max(F.when(F.col("_n") == 1, F.col("_bar"))).alias("_last"), F.max(F.when(F.col("_n") == 2, F.col("_bar"))).alias("_second"))

    def append(self, bars: DataFrame, reload: Callable[[DataFrame], DataFrame] | None = None, stream: str | None = None, epoch: int | None = None) -> DataFrame:
        """Adds newer bars and returns what became of each series: keys and kind.

        The last stored bar may have been incomplete, so bars must come again from the one before it on. If the first bar of a series is
        equal to the last but one stored (all columns), the bars after it take the place of the last one: `extended`. A series not in the
        store is `new`. If they differ, what is stored was changed at its source (a split, a correction): reload(keys of such series)
        gives all their bars, which replace the stored ones: `replaced`; without reload these series stay as they are: `incompatible`.

        With stream and epoch, a batch that is in the store already is passed over (its series are returned as none)."""
        number = self._number()
        kinds_schema = [*self.keys, "kind"]
        if stream is not None and self.applied(stream, epoch):
            return self.spark.createDataFrame([], ", ".join(f"`{c}` string" for c in kinds_schema))
        rest = [c for c in self.columns.names if c not in self.keys]
        typed = bars.select(*self.keys, *[F.col(c).cast(self.columns[c].dataType).alias(c) for c in rest])
        whole = F.struct(*rest)
        first = typed.groupBy(*self.keys).agg(F.min_by(whole, "ending").alias("_first"))
        states = first.join(self._recent(number, first.select(*self.keys)), self.keys, "left")
        kind = F.when(F.col("_last").isNull(), NEW).when(F.col("_second").eqNullSafe(F.col("_first")), EXTENDED).otherwise(REPLACED if reload else INCOMPATIBLE)
        states = states.select(*self.keys, kind.alias("kind"), F.col("_first.ending").alias("_cut")).persist()  # a row a series of the batch
        try:
            of = lambda k: states.where(F.col("kind") == k)
            cut = of(EXTENDED).withColumn("_block", self.block(F.col("_cut"))).select(*self.keys, "_cut", "_block")
            old = self._data(self._blocks(number), F.lit(True)).join(cut, self.keys).where((F.col("block") >= F.col("_block")) & (F.col("ending") <= F.col("_cut")))
            out = old.select(typed.columns).unionByName(typed.join(cut, self.keys).where(F.col("ending") > F.col("_cut")).select(typed.columns))
            out = out.unionByName(typed.join(of(NEW).select(*self.keys), self.keys, "left_semi"))
            if reload is not None and of(REPLACED).limit(1).count():
                again = reload(of(REPLACED).select(*self.keys))
                out = out.unionByName(again.select(*self.keys, *[F.col(c).cast(self.columns[c].dataType).alias(c) for c in rest]))
            self._commit(number, out, self._gone_by(cut, of(REPLACED).select(*self.keys)), stream, epoch)
            return self._kept(states.select(*kinds_schema))
        finally:
            states.unpersist()

    def _kept(self, kinds: DataFrame) -> DataFrame:
        """What became of the series, written beside the blocks: computed anew after the commit it would be something else."""
        path = f"{self.path}/appended/{uuid.uuid4().hex}"
        kinds.write.parquet(path)
        return self.spark.read.schema(kinds.schema).parquet(path)

    def _gone_by(self, cut: DataFrame, whole: DataFrame) -> Callable[[DataFrame], DataFrame]:
        def gone(blocks: DataFrame) -> DataFrame:
            partly = blocks.join(cut, self.keys).where(F.col("block") >= F.col("_block")).select(*self.keys, "block")
            return partly.unionByName(blocks.join(whole, self.keys, "left_semi").select(*self.keys, "block"))

        return gone

    def upsert(self, bars: DataFrame, version: str, stream: str | None = None, epoch: int | None = None) -> None:
        """Keeps, of each series and ending, the bar of the highest version; bars may be late, changed or both, and only blocks that they
        fall into are rewritten. A batch that is in the store already is passed over."""
        number = self._number()
        if stream is not None and self.applied(stream, epoch):
            return
        new = bars.select(*self.columns.names).withColumn("block", self.block(F.col("ending")))
        touched = new.select(*self.keys, "block").distinct()
        old = self._data(self._blocks(number), F.lit(True)).join(touched, [*self.keys, "block"], "left_semi")
        rest = [c for c in self.columns.names if c not in (*self.keys, "ending")]
        both = new.select(*self.columns.names).unionByName(old.select(*self.columns.names))
        latest = both.groupBy(*self.keys, "ending").agg(F.max_by(F.struct(*rest), version).alias("_b")).select(*self.keys, "ending", "_b.*")
        self._commit(number, latest, lambda blocks: blocks.join(touched, [*self.keys, "block"], "left_semi"), stream, epoch)

    def vacuum(self) -> int:
        """Deletes folders of commits that hold no live block, and manifests but the latest; returns how many folders went. Readers that
        began before should have ended."""
        number = self._number()
        blocks = self._blocks(number)
        live = {r.commit for r in blocks.where("live").select("commit").distinct().collect()}
        kept = blocks.where(F.col("commit").isin(sorted(live))) if live else blocks.where(F.lit(False))
        if blocks.count() != kept.count():
            self._swap(number, kept, None, None)
            number += 1
        gone = 0
        for folder, stays in (("blocks", lambda n: n.removeprefix("commit=") in live), ("manifests", lambda n: n == str(number)), ("appended", lambda n: False)):
            for f in self._files.listStatus(self._at(folder)) if self._files.exists(self._at(folder)) else []:
                if not stays(f.getPath().getName()):
                    gone += self._files.delete(f.getPath(), True)
        return gone
