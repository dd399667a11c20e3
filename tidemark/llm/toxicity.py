"""Toxicity by compression distance: zstandard dictionaries trained on ordinary and on toxic text.

Texts are cut into windows of about 64 bytes at word ends. Each window is compressed with either dictionary; the bytes that the
toxic one saves over the ordinary one are the window's evidence. Both dictionaries hold the ordinary content, so that only what
is peculiar to toxic text tells them apart; rounds of hard ordinary windows (those that the toxic dictionary wrongly favoured) are
added to that common content. A logistic curve over a text's strongest windows, fitted on labelled rows that trained no
dictionary, gives the score, placed so that the best threshold on those rows is 0.3.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, held_out, learnable, map_batches, one_an_id, sampled, texts

#: Labelled rows of each class on which the dictionaries and thresholds are fitted, at most about.
FIT_ROWS = 2400
WINDOW, LEVEL, ROUNDS, HARD, THRESHOLD = 64, 3, 3, 400, 0.3
#: Bytes of ordinary content in both dictionaries, and of words peculiar to toxic text in the toxic one, at most.
DICTIONARY = 16384


def words(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().split()


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """Whole text, cut at the first word end after each `size` bytes; each window starts and ends with a space."""
    line, out, i = b" " + b" ".join(words(text)) + b" ", [], 0
    if len(line) <= 2:
        return []
    while i < len(line) - 1:
        e = line.find(b" ", min(i + size, len(line) - 1))
        out.append(line[i : e + 1])
        i = e
    return out


@cache
def compressor(content: bytes):  # noqa: ANN201
    p = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=4, window_log=18, write_content_size=0, write_checksum=0, write_dict_id=0)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    bias: float

    def features(self, text: bytes) -> list[float]:
        o, t = compressor(self.ordinary), compressor(self.toxic)
        saved = sorted((len(o(w)) - len(t(w)) for w in windows(text)), reverse=True) or [0]
        second = saved[1] if len(saved) > 1 else 0
        return [saved[0], max(0, second), max(0.0, sum(saved) / len(saved)), math.log(len(saved)), len([s for s in saved if s >= 5]) / len(saved)]

    def score(self, text: bytes) -> float:
        z = self.bias + sum(w * x for w, x in zip(self.weights, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def group_key(text: bytes) -> int:
    """One smallest three-word shingle hash: near copies mostly share it, and only one of them trains."""
    w = words(text)
    return min((xxhash.xxh64_intdigest(b" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0)


def ending(all_words: list[bytes], most: int = DICTIONARY) -> bytes:
    """The last words, in order, that fit into so many bytes: what stands last is found cheapest."""
    size = np.cumsum([len(w) + 1 for w in reversed(all_words)]) if all_words else np.zeros(0, np.int64)
    return b" ".join(all_words[len(all_words) - int((size <= most + 1).sum()) :])


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The contents of the ordinary and the toxic dictionary."""
    seen_t, seen_o = Counter(), Counter()
    for seen, group in ((seen_t, toxic), (seen_o, ordinary)):
        for x in group:
            seen.update(set(words(x)))
    least = max(2, round(0.01 * len(toxic)))

    def odds(w: bytes) -> float:
        return math.log((seen_t[w] + 0.5) / (len(toxic) + 1)) - math.log((seen_o[w] + 0.5) / (len(ordinary) + 1))

    peculiar = sorted((w for w, n in seen_t.items() if n >= least and odds(w) > 2.0), key=lambda w: (seen_t[w], w))
    tail = b" " + ending(peculiar) + b" "
    lines = [b" ".join(words(x)) for x in ordinary]
    try:
        common = zstandard.train_dictionary(DICTIONARY, lines).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        common = ending([w for x in lines for w in x.split()])
    pool = [w for x in ordinary for w in windows(x)]
    for _ in range(ROUNDS):
        o, t = compressor(common), compressor(common + tail)
        saved = np.array([len(o(w)) - len(t(w)) for w in pool])
        hard = [i for i in np.argsort(-saved, kind="stable")[:HARD] if saved[i] >= 3]
        if not hard:
            break
        common += b"".join(pool[i] for i in hard)
    return common, common + tail


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton's method on standardised columns."""
    mean, sd = x.mean(0), x.std(0) + 1e-9
    a = np.c_[(x - mean) / sd, np.ones(len(x))]
    w, ridge = np.zeros(a.shape[1]), np.diag([0.5] * (a.shape[1] - 1) + [1e-6])
    for _ in range(min(steps, 40)):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / sd, float(w[-1] - (w[:-1] * mean / sd).sum())


def fit(rows: list[tuple[bytes, int]]) -> Model | None:
    """rows: whole texts and 0/1 labels. None unless both classes have rows. Near copies train once."""
    groups: dict[int, tuple[bytes, int]] = {}
    for t, label in rows:
        groups.setdefault(group_key(t) * 2 + label, (t, label))
    by = [[t for t, label in groups.values() if label == k] for k in (0, 1)]
    if not all(by):
        return None
    third = [len(g) // 3 if len(g) >= 6 else 0 for g in by]
    ordinary, toxic = dictionaries(by[1][third[1] :], by[0][third[0] :])
    model = Model(ordinary, toxic, (1.0, 0, 0, 0, 0), -5.0)
    calibrate = [(t, k) for k in (0, 1) for t in (by[k][: third[k]] if all(third) else by[k])]
    x, y = np.array([model.features(t) for t, _ in calibrate]), np.array([k for _, k in calibrate], float)
    w, b = logistic(x, y)
    z = x @ w + b
    # the threshold of the best F1 on the calibration rows; labelled classes may be sampled apart, and F1 here favours neither
    best = max(sorted(set(z)), key=lambda c: (2 * y[z >= c].sum() / ((z >= c).sum() + y.sum()), c))
    below = z[z < best]
    cut = (best + below.max()) / 2 if len(below) else best - 1e-6
    return Model(ordinary, toxic, tuple(float(v) for v in w), float(b - cut + math.log(THRESHOLD / (1 - THRESHOLD))))


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Model | None:
    """Fits on a bounded sample of labelled rows whose id's crc32 mod 4 is not 2; contradicting or null labels teach nothing."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where("toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_other")).where("toxic = _other").drop("_other")
    rows = sampled(marked.where(learnable(F.col("doc_id"))), "toxic", most)
    got = documents(docs).where("text is not null").join(F.broadcast(rows), "doc_id")  # 1.2 * most rows a class
    return fit([(r.text.encode(), r.toxic) for r in one_an_id(got.select("doc_id", "text", "toxic")).orderBy("doc_id").collect()])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= 0.3) of every row; only the text enters a score.

    Null and empty texts get the score of a text with no evidence; without a model every score is 0. Repeated rows stay."""

    def each(batch: pa.RecordBatch) -> dict:
        got = [0.0 if model is None else model.score(t) for t in texts(batch)]
        return {"doc_id": batch.column(0), "score": got, "predicted": [int(s >= THRESHOLD) for s in got]}

    return map_batches(documents(docs), each, "doc_id long, score double, predicted int").withColumn("held_out", held_out(F.col("doc_id")))


def keep(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, with all their columns, whose text is not predicted toxic; the text is scored in the same pass."""
    schema = docs.schema
    at = docs.columns.index("text")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        fine = [model is None or model.score(t) < THRESHOLD for t in texts(batch)]
        return batch.filter(pa.array(fine))

    from .common import small_batches

    small_batches(docs.sparkSession)
    assert at >= 0
    return docs.mapInArrow(lambda it: (each(b) for b in it), schema)
