"""The graph search against brute force."""

import numpy as np

from tidemark.llm import nearest


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, shard int, n int")


def brute(rows, every, k):
    x = {}
    for i, v, *_ in rows:
        if i is None or v is None or len(v) != 8 or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            continue
        x[i] = min(x.get(i, v), v)
    ids = np.array(sorted(x))
    m = np.array([np.array(x[i], np.float32) for i in ids], float)
    out = {}
    for q in ids[ids % every == 0]:
        s = m @ m[np.flatnonzero(ids == q)[0]]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def rows_of(n, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, [float(c) for c in rng.normal(size=8) * (1 + i % 3)], 0, 1, 2) for i in range(n)]


def test_nearest_recall_and_scores(spark, monkeypatch):
    rows = rows_of(900)
    rows += [(2000, rows[4][1], 0, 1, 2), (2020, None, 0, 1, 2), (2040, [0.0] * 8, 0, 1, 2), (2060, [1.0, None] + [0.0] * 6, 0, 1, 2), (2080, [float("nan")] + [1.0] * 7, 0, 1, 2), (2100, [1.0] * 5, 0, 1, 2), (None, [1.0] * 8, 0, 1, 2), (8, rows[8][1], 0, 1, 2)]
    want = brute(rows, 20, 20)
    held = nearest.usable(table(spark, rows)).cache()
    got = nearest.search(held.where("vec_id % 20 = 0"), nearest.index(held, 300), 20).toPandas()
    assert set(got.query_id) == set(want)
    hits = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and q not in set(g.vec_id)
        assert list(zip(-g.score, g.vec_id, strict=True)) == sorted(zip(-g.score, g.vec_id, strict=True))
        exact = dict(want[q])
        assert all(abs(exact[i] - s) < 1e-9 for i, s in zip(g.vec_id, g.score, strict=True) if i in exact)
        hits += len(set(g.vec_id) & set(exact))
    assert hits / (20 * len(want)) > 0.95


def test_few_and_none(spark):
    got = nearest.nearest(table(spark, rows_of(5))).collect()
    assert [(r.query_id, r.rank) for r in sorted(got, key=lambda r: r.rank)] == [(0, k) for k in range(1, 5)]
    assert nearest.nearest(table(spark, [])).count() == 0
    assert nearest.nearest(table(spark, rows_of(1))).count() == 0


def test_many_copies(spark):
    """More copies than a beam holds, some of them queries: the smaller ids win, and no other vector is lost."""
    rows = rows_of(600)
    rows += [(1000 + i, rows[7][1], 0, 1, 2) for i in range(400)] + [(3000 + i, rows[11][1], 0, 1, 2) for i in range(30)]
    want = brute(rows, 20, 20)
    got = nearest.nearest(table(spark, rows)).toPandas()
    assert set(got.query_id) == set(want)
    hits = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and q not in set(g.vec_id)
        if 1000 <= q < 1400:
            assert list(g.vec_id) == [i for i, _ in want[q]], q
        hits += len(set(g.vec_id) & {i for i, _ in want[q]})
    assert hits / (20 * len(want)) > 0.98


def test_recall_at_the_shipped_settings_on_uneven_norms():
    """Clustered vectors of 64 dimensions, norms spread by a factor e^0.6, in one shard."""
    for n in (4000, 12_000):
        rng = np.random.default_rng(3)
        x = rng.normal(size=(200, 64))[rng.integers(0, 200, n)] + 0.6 * rng.normal(size=(n, 64))
        x *= np.exp(0.6 * rng.normal(size=n))[:, None]
        norms = (x * x).sum(1)
        near = np.c_[x, np.sqrt(np.maximum(0.0, norms.max() - norms))].astype(np.float32)
        graph, start = nearest.build(near)
        q = x[:200]
        found, _ = nearest.beam_search(near, graph, start, np.c_[q, np.zeros(200)].astype(np.float32), nearest.BEAM)
        score = q @ x.T
        score[np.arange(200), np.arange(200)] = -np.inf
        want = np.argsort(-score, 1)[:, :20]
        recall = [len(set(f[f != i][np.argsort(-score[i, f[f != i]])][:20]) & set(w)) / 20 for i, (f, w) in enumerate(zip(found, want, strict=True))]
        assert np.mean(recall) > 0.97 and min(recall) >= 0.8


def test_each_row_is_a_candidate_and_each_shard_has_a_partition(spark):
    rows = rows_of(64)
    rows += [(7, rows[7][1], 0, 1, 2), (20, rows[20][1], 0, 1, 2)]
    got = nearest.nearest(table(spark, rows), 20, 20).toPandas()
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    ids = np.array([r[0] for r in rows])
    for q in (0, 20, 40, 60):
        score = x @ x[q]
        order = [j for j in np.lexsort((ids, -score)) if j != q][:20]
        g = got[got.query_id == q].sort_values("rank")
        assert list(g.vec_id) == ids[order].tolist()
    held = nearest.usable(table(spark, rows_of(900))).cache()
    parts = nearest.index(held, 60).select("shard").rdd.glom().map(len).collect()
    assert max(parts) == 1 and sum(parts) > 12
