"""Running medians, span by span, against all rows sorted anew."""

import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import medians


def test_medians_of_a_span():
    rng = random.Random(1)
    for _ in range(500):
        old = sorted(rng.randrange(12) * 1.0 for _ in range(rng.randint(0, 30)))
        own = [float("nan") if rng.random() < 0.2 else rng.randrange(12) * 1.0 for _ in range(rng.randint(1, 6))]
        mid, m = len(old) // 2, len(own)
        lo, hi = max(0, mid - m - 1), min(len(old), mid + m + 2)
        got = medians.medians(np.array(old[lo:hi]), lo, len(old), np.array(own))
        seen = list(old)
        for x, g in zip(own, got.tolist(), strict=True):
            seen += [x] if x == x else []
            assert (g != g) if not seen else g == median(seen)


@pytest.mark.parametrize("shape", ["random", "rising", "equal", "two levels"])
def test_running(spark, shape, monkeypatch):
    rng = random.Random(2)
    rows = []
    for s in ("a", "b", None):
        for t in range({"a": 500, "b": 37, None: 5}[s]):
            x = {"random": rng.gauss(0, 9), "rising": float(t), "equal": 1.0, "two levels": 1.0 if t < 200 else rng.choice([1.0, 90.0])}[shape]
            rows.append((s, t // 3, t % 3, None if rng.random() < 0.1 or t < 2 else x, "k"))
    df = spark.createDataFrame(rows, "segment string, time int, seq int, x double, other string").repartition(5)
    got = {(r.segment, r.time, r.seq): r.m for r in medians.running(df, ["time", "seq"], "x", "m", ["segment"], span=16).collect()}
    assert len(got) == len(rows)
    for s in ("a", "b", None):
        seen = []
        for _, t, k, x, _ in (r for r in rows if r[0] == s):
            seen += [] if x is None else [x]
            assert got[s, t, k] == (pytest.approx(median(seen)) if seen else None), (s, t, k)


def test_without_segments_and_rows(spark):
    df = spark.createDataFrame([(t, float((t * 7919) % 101)) for t in range(300)], "t int, x double").repartition(3)
    got = [r.m for r in medians.running(df, ["t"], "x", "m", [], span=20).orderBy("t").collect()]
    assert got == [median([(u * 7919) % 101 for u in range(t + 1)]) for t in range(300)]
    assert medians.running(df.where(F.lit(False)), ["t"], "x", "m", []).count() == 0
