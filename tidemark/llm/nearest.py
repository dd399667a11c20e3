"""Approximate nearest neighbours by inner product: a robust-pruned directed graph in every shard.

Equal vectors are one node, which keeps the smallest of their ids. Vectors are dealt into shards by their hash. One more component makes
all norms of the index equal, so the largest inner product is the smallest distance. In each shard the graph is built in two passes: greedy
searches from the middle propose neighbours of each vector, and pruning keeps a neighbour only if no kept one is nearer to it by the
factor alpha; edges back are added and pruned alike. A query has none of the extra component, so where norms differ it lies far from all
nodes: each vector is searched for as a node and as a query, and pruning sees what both find. Queries travel in blocks to every shard; a task loads a shard once, the blocks
stream past it, a beam search from the middle answers them, and the best are merged.

Each query meets each shard, so the work is that of queries times shards: the more rows a shard holds, the less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches_of, discard, ragged, record, small_batches, stored, to_arrow

#: Share of a vector's square that the extra component may be without a search of its own.
ALIKE = 1e-4
#: Vectors of a shard and their bytes, about; edges of a node; beams when building and when searching.
SHARD_BYTES = 64 << 20
SHARD_ROWS, DEGREE, BUILD_BEAM, BEAM, ALPHAS = 50_000, 32, 64, 256, (1.0, 1.2)
#: Ids kept of equal vectors: as many as neighbours are asked for, and the query's own.
COPIES = 21


def distances(x: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of q[i] and x[at[i, j]]."""
    rows = x[at]
    return np.einsum("ijk,ijk->ij", rows, rows) - 2 * np.einsum("ijk,ik->ij", rows, q) + np.einsum("ik,ik->i", q, q)[:, None]


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search for each row of q: the `beam` nearest nodes met and their distances, nearest first (-1: none)."""
    n, b = len(x), len(q)
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True
    ids, dist, done = np.full((b, beam), -1), np.full((b, beam), np.inf), np.ones((b, beam), bool)
    ids[:, 0], done[:, 0], seen[:, start] = start, False, True
    dist[:, 0] = distances(x, ids[:, :1], q)[:, 0]
    alive = np.arange(b)
    while len(alive):
        open_ = ~done[alive]
        order = np.argsort(~open_, axis=1, kind="stable")[:, :step]
        chosen = np.take_along_axis(open_, order, 1)
        node = np.where(chosen, np.take_along_axis(ids[alive], order, 1), -1)
        sub = done[alive]
        np.put_along_axis(sub, order, True, 1)
        done[alive] = sub
        next_ = np.where(node[:, :, None] >= 0, graph[node], -1).reshape(len(alive), -1)
        next_ = np.sort(np.where(next_ < 0, n, next_), axis=1)
        next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = n
        fresh = ~seen[alive[:, None], next_]
        seen[alive[:, None], next_] = True
        d = np.where(fresh, distances(x, np.where(fresh, next_, 0), q[alive]), np.inf)
        all_d = np.concatenate([dist[alive], d], 1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[alive] = np.take_along_axis(all_d, best, 1)
        ids[alive] = np.take_along_axis(np.concatenate([ids[alive], np.where(fresh, next_, -1)], 1), best, 1)
        done[alive] = np.take_along_axis(np.concatenate([done[alive], ~fresh], 1), best, 1)
        alive = alive[~done[alive].all(1)]
    return ids, dist


def robust_prune(x: np.ndarray, node: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """For each node at most `degree` of its candidates (-1: none), so that kept ones are spread."""
    c = np.sort(candidates, axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    c[c == node[:, None]] = -1
    d = np.where(c >= 0, distances(x, np.maximum(c, 0), x[node]), np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    c, d = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)
    rows = x[np.maximum(c, 0)]
    sq = np.einsum("ijk,ijk->ij", rows, rows)
    between = sq[:, :, None] + sq[:, None, :] - 2 * rows @ rows.transpose(0, 2, 1)
    left, out, at = np.isfinite(d), np.full((len(node), degree), -1), np.arange(len(node))
    for k in range(degree):
        first = left.argmax(1)
        some = left[at, first]
        if not some.any():
            break
        out[some, k] = c[at, first][some]
        left &= ~(some[:, None] & (alpha * between[at, first] <= d + 1e-12))
        left[at, first] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, batch: int = 128, seed: int = 5) -> tuple[np.ndarray, int]:
    """The graph (a row of neighbours for each node, -1: none) and the node where searches start. The last component of x is the extra
    one, which queries have not."""
    n = len(x)
    graph = np.full((n, degree), -1)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    if n == 1:
        return graph, start
    rng = np.random.default_rng(seed)
    few = min(degree // 2, n - 1)
    graph[:, :few] = (np.arange(n)[:, None] + rng.integers(1, n, (n, few))) % n
    for alpha in ALPHAS:
        order = rng.permutation(n)
        for i in range(0, n, batch):
            p = order[i : i + batch]
            found = [beam_search(x, graph, start, x[p], beam)[0]]
            far = x[p, -1] ** 2 > ALIKE * (x[p] ** 2).sum(1)
            if far.any():  # where norms are alike, a vector is near itself as a query
                asked = x[p].copy()
                asked[:, -1] = 0
                found.append(beam_search(x, graph, start, asked, beam)[0])
            graph[p] = robust_prune(x, p, np.concatenate([*found, graph[p]], 1), alpha, degree)
            to, by = graph[p].ravel(), np.repeat(p, degree)
            by, to = by[to >= 0], to[to >= 0]
            srt = np.argsort(to, kind="stable")
            to, by = to[srt], by[srt]
            target, first, count = np.unique(to, return_index=True, return_counts=True)
            for wide in (False, True):
                pick = np.flatnonzero((count > degree) == wide)
                for j in range(0, len(pick), 8 if wide else 512):
                    some = pick[j : j + (8 if wide else 512)]
                    new = np.full((len(some), count[some].max()), -1)
                    col = np.arange(count[some].sum()) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
                    new[np.repeat(np.arange(len(some)), count[some]), col] = by[np.repeat(first[some], count[some]) + col]
                    both = np.concatenate([graph[target[some]], new], 1)
                    over = ((both >= 0).sum(1) > degree)
                    if over.any():
                        graph[target[some[over]]] = robust_prune(x, target[some[over]], both[over], alpha, degree)
                    fits = np.sort(both[~over], axis=1)[:, ::-1].copy()
                    fits[:, 1:][fits[:, 1:] == fits[:, :-1]] = -1
                    graph[target[some[~over]]] = np.sort(fits, axis=1)[:, ::-1][:, :degree]
    return graph, start


INDEX = "shard int, n int, dim int, start int, ids binary, counts binary, vectors binary, extra binary, graph binary"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (array of double) of the vectors that take part: not null, all components finite, not all zero, and of the
    length that most have."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = v.where("vec_id is not null and vector is not null").where(~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0))
    lengths = v.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return v.where(F.size("vector") == (lengths[0].n if lengths else -1))


def repeated(hashed: DataFrame) -> DataFrame:
    """hashed (vec_id, a, b: two hashes of the vector): of each vector of several rows its COPIES smallest ids (an id as often as it has
    rows) and their smallest, first. A vector's ids are cut to the smallest in 64 parts, in 8 and then in all, so that no task reads all of a common vector."""
    for parts in (64, 8, 1):
        part = F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(parts))
        nth = F.row_number().over(W.partitionBy("a", "b", *([part] if parts > 1 else [])).orderBy("vec_id"))
        hashed = hashed.withColumn("nth", nth).where(F.col("nth") <= COPIES).drop("nth")
    ids = hashed.groupBy("a", "b").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # at most COPIES
    return ids.where(F.size("ids") > 1).select("a", F.col("ids")[0].alias("first"), "ids")


def index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row a shard: its distinct vectors, the ids of each (at most COPIES, the smallest; counts: how many) and the graph."""
    hashes = F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(7), "vector").alias("b")
    stats = vectors.agg(F.approx_count_distinct(hashes[0]).alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("most"), F.max(F.size("vector")).alias("dim")).first()
    shards = max(1, -(-stats.n // max(1, min(shard_rows, SHARD_BYTES // (8 * (stats.dim or 1))))))
    top = float(stats.most or 0.0)

    def graph(shard: int, rows: pd.DataFrame) -> pd.DataFrame:
        more = rows[rows["vector"].isna()]
        rows = rows[rows["vector"].notna()].sort_values("first")
        x = np.stack(rows["vector"].to_numpy()).astype(np.float64)
        extra = np.sqrt(np.maximum(0.0, top - (x * x).sum(1)))
        g, start = build(np.c_[x, extra].astype(np.float32))
        known = dict(zip(zip(more["first"], more["a"], strict=True), more["ids"], strict=True))
        ids = [known.get(i, (i[0],)) for i in zip(rows["first"], rows["a"], strict=True)]
        counts = np.array([len(i) for i in ids], np.int32)
        return pd.DataFrame([{"shard": shard, "n": len(x), "dim": x.shape[1], "start": start, "ids": np.concatenate(ids).astype(np.int64).tobytes(), "counts": counts.tobytes(), "vectors": x.tobytes(), "extra": extra.tobytes(), "graph": g.astype(np.int32).tobytes()}])

    def built(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, here = [], None
        for frame in frames:
            for shard, part in frame.groupby("shard", sort=False):
                if here is not None and shard != here:
                    yield graph(here, pd.concat(held))
                    held = []
                here = int(shard)
                held.append(part)
        if held:
            yield graph(here, pd.concat(held))

    shard = F.pmod(F.col("a"), F.lit(shards)).cast("int").alias("shard")
    distinct = vectors.groupBy("vector").agg(F.min("vec_id").alias("first")).select("first", hashes[0], F.lit(None).cast("array<long>").alias("ids"), "vector").select(shard, "*")
    copies = repeated(vectors.select("vec_id", *hashes)).select(shard, "first", "a", "ids", F.lit(None).cast("array<double>").alias("vector"))
    # a partition a shard: a shard is few bytes and much work, so partitions are not to be merged by their bytes, nor shards to meet in one
    dealt = distinct.unionByName(copies).repartitionById(shards, "shard").sortWithinPartitions("shard")
    return dealt.mapInPandas(built, INDEX)


def best(ids: np.ndarray, score: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Where the k of largest score in each row are, ties to the smaller id."""
    order = np.lexsort((ids, -score, row))
    return order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < k]


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, vector) -> blocks of them."""
    arrow = to_arrow("asked binary, by binary")
    for b in batches:
        if b.num_rows:
            yield record({"asked": [b.column(0).to_numpy().tobytes()], "by": [b.column(1).flatten().to_numpy().tobytes()]}, arrow)


class Shard:
    """A shard of the index, as a task holds it."""

    def __init__(self, r: dict):
        self.x = np.frombuffer(r["vectors"]).reshape(r["n"], r["dim"])
        self.near = np.c_[self.x, np.frombuffer(r["extra"])].astype(np.float32)
        self.graph, self.ids = np.frombuffer(r["graph"], np.int32).reshape(r["n"], -1).astype(np.int64), np.frombuffer(r["ids"], np.int64)
        self.counts = np.frombuffer(r["counts"], np.int32).astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.start = r["start"]

    def answer(self, qid: np.ndarray, q: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest rows found of each query: its number, ids and scores."""
        found, _ = beam_search(self.near, self.graph, self.start, np.c_[q, np.zeros(len(q))].astype(np.float32), beam)
        at = found.ravel()
        row = np.repeat(np.arange(len(q)), found.shape[1])[at >= 0]
        at = at[at >= 0]
        score = np.einsum("ij,ij->i", q[row], self.x[at])
        near = best(self.ids[self.first[at]], score, row, k + 1)  # one may be the query alone
        many = self.counts[at[near]]
        out_id, at, score, row = self.ids[ragged(self.first[at[near]], many)], np.repeat(at[near], many), np.repeat(score[near], many), np.repeat(row[near], many)
        own = np.flatnonzero(out_id == qid[row])  # the query's id: its own row if the vector is its own too, and others like it
        own = own[(self.x[at[own]] == q[row[own]]).all(1)]
        own = own[np.unique(row[own], return_index=True)[1]]
        other = np.setdiff1d(np.arange(len(out_id)), own)
        top = other[best(out_id[other], score[other], row[other], k)]
        return row[top], out_id[top], score[top]


def search(queries: DataFrame, indexed: DataFrame, k: int = 20, beam: int = BEAM) -> DataFrame:
    """queries (vec_id, vector) against every shard of the index: query_id, rank, vec_id, score (inner product in double precision).
    Queries of one id with different vectors have ranks of their own."""
    if k >= COPIES:
        raise ValueError(f"the index keeps {COPIES} ids of equal vectors, too few for {k} neighbours")
    last = indexed.agg(F.max("shard")).first()[0]
    shards = 0 if last is None else int(last) + 1
    blocks = stored(queries.mapInArrow(packed, "asked binary, by binary"), "blocks")
    names = [f.name for f in indexed.schema.fields if f.name != "shard"]
    held = indexed.select("shard", *names, *[F.lit(None).cast("binary").alias(c) for c in ("asked", "by")])
    sent = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(max(0, shards - 1)))).alias("shard"), *[F.lit(None).cast(indexed.schema[c].dataType).alias(c) for c in names], "asked", "by")
    schema = "query_id long, which long, vec_id long, score double"
    arrow = to_arrow(schema)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["asked"] is None:
                    shard = Shard(r)
                    continue
                qid = np.frombuffer(r["asked"], np.int64)
                q = np.frombuffer(r["by"]).reshape(len(qid), -1)
                for i in range(0, len(q), 128):
                    row, ids, score = shard.answer(qid[i : i + 128], q[i : i + 128], k, beam)
                    which = np.array([xxhash.xxh3_64_intdigest(v.tobytes()) for v in q[i : i + 128]], np.uint64).view(np.int64)
                    yield record({"query_id": qid[i : i + 128][row], "which": which[row], "vec_id": ids, "score": score}, arrow)

    dealt = held.unionByName(sent).repartitionById(max(1, shards), "shard").sortWithinPartitions("shard", F.col("asked").isNotNull())
    with batches_of(queries.sparkSession, 2):  # a row holds a shard
        hits = stored(dealt.mapInArrow(answers, schema), "hits")
    discard(blocks)
    rank = F.row_number().over(W.partitionBy("query_id", "which").orderBy(F.desc("score"), "vec_id"))  # k rows a shard for each query
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """Queries: rows whose vec_id is divisible by `every`; candidates: every row but the query's own. Returns query_id, rank (from 1),
    vec_id, score, nearest first, ties to the smaller vec_id; fewer than k rows where there are fewer candidates.

    Vectors null, zero, with null or non-finite components, or of another length than most take no part; nor do null ids. Equal
    vectors under different ids are candidates of their own, and so is each of several rows of one id and vector; as queries such rows
    are asked once, with the others of them among the candidates. An empty table gives no rows."""
    small_batches(vectors.sparkSession)
    held = stored(usable(vectors), "vectors")
    asked = held.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vector"])
    return search(asked, stored(index(held), "index"), k)
