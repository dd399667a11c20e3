"""Bars of a stream: tumbling windows with a watermark, and a store that takes late and changed bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(ticks: DataFrame, length: str, late: str, symbol: Column, price: Column, ts: str = "ts") -> DataFrame:
    """Bars of a stream of ticks; ticks later than `late` behind the latest are dropped, as is the state of their windows. The same
    frame of a finished table gives the same bars."""
    at = F.struct(F.col(ts), price.alias("p"))
    b = ticks.withWatermark(ts, late).groupBy(symbol.alias("symbol"), F.window(ts, length).alias("w"))
    out = b.agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return out.select("symbol", F.col("w.end").alias("ending"), "open", "high", "low", "close", "volume", F.col("close").alias("adj_close"))


def sliding(ticks: DataFrame, length: str, slide: str, late: str, symbol: Column, price: Column, ts: str = "ts") -> DataFrame:
    """The mean and range of the last `length`, every `slide`."""
    b = ticks.withWatermark(ts, late).groupBy(symbol.alias("symbol"), F.window(ts, length, slide).alias("w"))
    return b.agg(F.avg(price).alias("mean"), F.max(price).alias("high"), F.min(price).alias("low")).select("symbol", F.col("w.end").alias("ending"), "mean", "high", "low")


def sessions(ticks: DataFrame, gap: str, late: str, symbol: Column, price: Column, ts: str = "ts") -> DataFrame:
    """Bars of activity without a pause of `gap`."""
    b = ticks.withWatermark(ts, late).groupBy(symbol.alias("symbol"), F.session_window(ts, gap).alias("w"))
    return b.agg(F.max(price).alias("high"), F.min(price).alias("low"), F.count(F.lit(1)).alias("volume")).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("ending"), "high", "low", "volume")


def upsert(spark: SparkSession, path: str, keys: list[str], version: str, partition: Column) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps, for each key, the row of the highest version, rewriting only the partitions that a batch touches.

    What the touched partitions become is first written whole to a folder of the batch's own beside them (readers pass over it), and only
    then put in their place, from there. If that is broken off, the batch comes again, finds the folder whole and puts it in place. The
    folder is named by stream and epoch, since another stream into the same table counts its epochs from 0 too, and is gone once it is
    in place: a batch that comes again after that is merged again, which changes nothing. Streams must take turns; a `BlockStore` also
    keeps commits apart that come at once."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    staging = hadoop.Path(path, "_staged")
    fs = staging.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def write(batch: DataFrame, epoch: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        staged = f"{path.rstrip('/')}/_staged/{stream}-{epoch}"
        if not fs.exists(hadoop.Path(staged, "_SUCCESS")):
            new = batch.withColumn("part", partition)
            touched = [r.part for r in new.select("part").distinct().collect()]  # partitions of one micro-batch
            if not touched:
                return
            try:
                old = spark.read.parquet(path).where(F.col("part").isin(touched))
            except AnalysisException as e:  # the first batch finds no table
                if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                    raise
                old = new.limit(0)
            rest = [c for c in new.columns if c not in (*keys, "part")]
            both = new.unionByName(old.select(*[F.col(c).cast(new.schema[c].dataType).alias(c) for c in new.columns]))
            both.groupBy("part", *keys).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*keys, "_r.*", "part").write.mode("overwrite").parquet(staged)
        spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
        fs.delete(hadoop.Path(staged), True)

    return write


def run_to_end(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "update") -> StreamingQuery:
    """Processes what there is and stops."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
