"""What the operators of this subpackage share: reading tables, shared storage, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch; at the longest texts seen (about 100 KB) a batch stays near 50 MB.
BATCH_ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary folder if driver and executors
    are one machine (local mode, as in tests); on a cluster each executor would write to a disk of its own, so that is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        path = own_dir(spark.sparkContext.applicationId)
    return path.rstrip("/")


@cache
def own_dir(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix=f'tidemark-{application}-')}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read again: cuts lineage and survives lost executors. What was shuffled for it goes from
    the disks once it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with setting(spark, CLEANUP_CONF, "true"):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["stored_at"] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the files of stored frames that nothing reads any more."""
    for df in frames:
        path = df.__dict__.get("stored_at")
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Whether Spark deletes the shuffle files of a query when it ends; else they stay until the driver's garbage collector finds them unused.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """Batches of BATCH_ROWS rows from here on: results are lazy, so the setting must still hold when the caller runs them."""
    spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for what is run inside."""
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


def batches_of(spark: SparkSession, rows: int):  # noqa: ANN201
    """Batches of so many rows for what is run inside."""
    return setting(spark, BATCH_CONF, str(rows))


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while (name := f"_{name}").lower() in taken:
        pass
    return name


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text as string, with the further columns asked for; any other column is left behind."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c) for c in more])


def learnable(doc_id: Column) -> Column:
    """Rows that a model may learn from: crc32 of doc_id as text, mod 4, is not 2. A null id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(df: DataFrame, by: str, per_value: int, seed: int = 7, most_values: int = 1000) -> DataFrame:
    """About per_value rows of each value of `by`, for the most_values values with most rows (documented bounds on what a model is fitted on).

    Which rows: those of smallest doc_id hash, by a share of the value's count; one small count job, no sort."""
    counts = df.groupBy(by).count().orderBy(F.desc("count"), by).limit(most_values)
    share = F.least(F.lit(1.0), F.lit(1.2 * per_value) / F.col("count"))
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return df.join(F.broadcast(counts), by).where(u < share).drop("count")  # most_values rows


def one_an_id(df: DataFrame) -> DataFrame:
    """Of the rows of each doc_id the least by the other columns, in their order: what is fitted on is then the same in each run, and
    no larger where very many rows share an id. Combined before the shuffle."""
    rest = [c for c in df.columns if c != "doc_id"]
    return df.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("_r")).select("doc_id", *[F.col(f"_r.{c}").alias(c) for c in rest])


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None], schema: str) -> DataFrame:
    """df.mapInArrow with a function of one batch."""
    small_batches(df.sparkSession)
    arrow = to_arrow(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None:
                    yield record(out, arrow)

    return df.mapInArrow(each, schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def to_arrow(schema: str) -> pa.Schema:
    """The Arrow schema of "name type, name type, ..."; usable where no session is, as in tasks."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (field.split() for field in schema.split(","))])


def record(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip((columns[f.name] for f in schema), schema, strict=True)], schema=schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """Whole texts as UTF-8; null as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in col.cast(pa.binary() if pa.types.is_string(col.type) else pa.large_binary()).to_pylist()]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lengths[i] - 1, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
