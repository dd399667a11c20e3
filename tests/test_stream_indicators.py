"""A running stream's indicators against those of the finished table, over a restart and bars out of order."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import lookback as lb
from tidemark.streaming import indicators

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(PROVIDER)


def test_running_indicators_equal_the_batch(rocks, tmp_path):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(s, start + dt.timedelta(hours=i), 100 + rng.gauss(0, 5)) for s in ("a", "b") for i in range(90)]
    by_time = sorted(rows, key=lambda r: r[1])
    schema = "symbol string, ending timestamp, value double"
    batches = [by_time[k : k + 60] for k in range(0, len(by_time), 60)]
    for b in range(len(batches) - 1):  # some bars come a batch late, some twice
        for k in range(0, 10):
            batches[b + 1].append(batches[b].pop(-1 - k) if k % 2 else batches[b][-1 - k])
    batches.append([("z", start + dt.timedelta(days=300), 0.0)])  # moves the watermark past the others
    batches.append([("z", start + dt.timedelta(days=301), 0.0)])

    def run(n):
        rocks.createDataFrame(batches[n], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = rocks.readStream.schema(schema).parquet(f"{tmp_path}/in")
        found = indicators.running(stream, ["symbol"], {"ema": indicators.ema(3), "rsi": indicators.rsi(5)}, "36 hours")
        q = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    for n in range(len(batches)):  # each run is a restart
        run(n)
    got = {(r.symbol, r.ending): (r.value, r.ema, r.rsi) for r in rocks.read.parquet(f"{tmp_path}/out").where("symbol <> 'z'").collect()}
    w = W.partitionBy("symbol").orderBy("ending")
    df = rocks.createDataFrame(rows, schema)
    want = {(r.symbol, r.ending): (r.value, r.ema, r.rsi) for r in df.select("*", lb.ema(3, F.col("value"), w).alias("ema"), lb.rsi(5, F.col("value"), w).alias("rsi")).collect()}
    assert set(got) == set(want)
    for k, (x, e, r) in want.items():
        assert got[k][0] == x and got[k][1] == pytest.approx(e), k
        assert got[k][2] == pytest.approx(r, nan_ok=True) if r is not None else got[k][2] is None or got[k][2] != got[k][2], k
