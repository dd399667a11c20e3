"""Quality by co-training of two views.

The text view sees the content (byte-pair shares and shape of the text), the metadata view sees only what stands beside it (source,
language, length). Each is a logistic classifier fitted on labelled rows. In rounds, each labels the unlabelled rows of a pool about
which it is most sure and hands them to the other, which is fitted again. Both are then calibrated on labelled rows that trained
neither, a last logistic curve combines the two calibrated views, and every document is scored.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, learnable, map_batches, one_an_id, sampled, texts
from .toxicity import logistic

#: Labelled rows a class and rows of the unlabelled pool on which the classifiers are fitted, at most about.
FIT_ROWS, POOL_ROWS, ROUNDS, SHARE = 1500, 3000, 4, 0.04
PAIRS, META = 512, 128


def content(text: bytes) -> np.ndarray:
    """The text view of a whole text."""
    b = np.frombuffer(text, np.uint8)
    n = max(1, len(b))
    pairs = np.bincount(((b[:-1].astype(np.uint32) * 257 + b[1:]) * np.uint32(0x9E3779B1) >> np.uint32(23)) & np.uint32(PAIRS - 1), minlength=PAIRS) if len(b) > 1 else np.zeros(PAIRS)
    one = np.bincount(b, minlength=256) / n
    words, lines = text.split(), text.split(b"\n")
    shape = [
        one[65:91].sum(), one[97:123].sum(), one[48:58].sum(), one[33:48].sum() + one[58:65].sum() + one[91:97].sum() + one[123:127].sum(), one[10], one[32], one[33] * 10, one[124] * 10,
        len(words) / n, len(set(words)) / max(1, len(words)), len(set(lines)) / len(lines), math.log1p(len(b)) / 10, zlib_ratio(text),
    ]
    return np.r_[np.sqrt(pairs / n), shape]


def zlib_ratio(text: bytes) -> float:
    """Distinct eight-byte pieces over pieces: low where a text repeats itself."""
    cut = len(text) // 8 * 8
    pieces = np.frombuffer(text[:cut], np.uint64)
    return len(np.unique(pieces)) / max(1, len(pieces))


def metadata(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """The metadata view; nulls are values of their own."""
    out = np.zeros(META)
    out[zlib.crc32(f"s:{source}".encode()) % (META - 34)] = 1
    out[META - 34 + zlib.crc32(f"l:{lang}".encode()) % 14] = 1
    out[META - 20 + (19 if n_chars is None or n_chars < 0 else min(18, int(math.log2(1 + n_chars))))] = 1
    return out


@dataclass
class Model:
    weights: list[np.ndarray]
    bias: list[float]
    calibration: np.ndarray  # a slope and a bias for each view
    mixing: np.ndarray

    def calibrated(self, view: int, x: np.ndarray) -> np.ndarray:
        return (x @ self.weights[view] + self.bias[view]) * self.calibration[view, 0] + self.calibration[view, 1]

    def score(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        z = self.calibrated(0, a) * self.mixing[0] + self.calibrated(1, b) * self.mixing[1] + self.mixing[2]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS, share: float | None = None) -> Model | None:
    """views: the two views of labelled rows, in an order that says nothing; y: 0/1; share: of good rows among all
    labelled ones, where y has the classes sampled apart (the score is then that of the whole). None unless both classes have rows."""
    if len(set(y.tolist())) < 2:
        return None
    part = np.arange(len(y)) % 3 == 0
    if len(set(y[part].tolist())) < 2 or len(set(y[~part].tolist())) < 2:
        part[:] = False
    learn = ~part
    prior = y[learn].mean()
    own = [[(views[v][learn], y[learn])] for v in (0, 1)]
    free = np.ones(len(pool[0]), bool)
    n = max(1, int(SHARE * len(pool[0])))
    weights, bias = [np.zeros(0)] * 2, [0.0] * 2
    for r in range(rounds + 1):
        for v in (0, 1):
            weights[v], bias[v] = logistic(np.concatenate([x for x, _ in own[v]]), np.concatenate([t for _, t in own[v]]), 25)
        if r == rounds or not free.any():
            break
        for v in (0, 1):  # each view teaches the other
            at = np.flatnonzero(free)
            order = at[np.argsort(pool[v][at] @ weights[v] + bias[v], kind="stable")]
            low, high = order[: round(n * (1 - prior))], order[len(order) - round(n * prior) :]
            picked = np.unique(np.concatenate([low, high]))
            label = np.isin(picked, high).astype(float)
            own[1 - v].append((pool[1 - v][picked], label))
            free[picked] = False
    use = part if part.any() else learn
    z = [views[v][use] @ weights[v] + bias[v] for v in (0, 1)]
    cal = np.array([[*np.ravel(w), b] for w, b in (logistic(s[:, None], y[use]) for s in z)])
    w, b = logistic(np.c_[z[0] * cal[0, 0] + cal[0, 1], z[1] * cal[1, 0] + cal[1, 1]], y[use])
    if share is not None and 0 < share < 1:
        own_share = y[use].mean()
        b += math.log(share / (1 - share)) - math.log(own_share / (1 - own_share))
    return Model(weights, bias, cal, np.array([*w, b]))


COLUMNS = ("source", "lang", "n_chars")


def views(rows: list) -> tuple[np.ndarray, np.ndarray]:
    a = np.array([content(r.text.encode()) for r in rows]).reshape(-1, PAIRS + 13)
    return a, np.array([metadata(r.source, r.lang, r.n_chars) for r in rows]).reshape(-1, META)


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS, pool: int = POOL_ROWS) -> Model | None:
    """Fits on bounded samples: labelled rows whose id's crc32 mod 4 is not 2, and a pool of rows without a label."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_o")).where("quality = _o").drop("_o")
    rows = documents(docs, *COLUMNS).where("text is not null")
    fair = marked.where(learnable(F.col("doc_id")))
    share = fair.agg(F.avg("quality")).first()[0]
    known = one_an_id(rows.join(F.broadcast(sampled(fair, "quality", most)), "doc_id"))  # 1.2 * most a class
    known = known.orderBy(F.xxhash64("doc_id"), "text").collect()
    few = sampled(rows.where(learnable(F.col("doc_id"))).select("doc_id", F.lit(0).alias("all")), "all", pool, seed=11).select("doc_id").distinct()
    few = few.join(marked, "doc_id", "left_anti")  # of ids alone: no text is to be dealt for it
    free = one_an_id(rows.join(F.broadcast(few), "doc_id")).orderBy(F.xxhash64("doc_id"), "text").collect()  # 1.2 * pool
    return fit(views(known), np.array([r.quality for r in known], float), views(free), share=share) if known else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score (0 to 1, higher: better), text_score, meta_score and keep (score >= 0.5) of every row.

    Null text is empty text; null metadata are values of their own; repeated rows stay; without a model every score is 1."""

    def each(batch: pa.RecordBatch) -> dict:
        a = np.array([content(t) for t in texts(batch)])
        b = np.array([metadata(*r) for r in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)])
        if model is None:
            s = z = y = np.ones(len(a))
        else:
            s = model.score(a, b)
            z, y = (1 / (1 + np.exp(-np.clip(model.calibrated(v, x), -60, 60))) for v, x in ((0, a), (1, b)))
        return {"doc_id": batch.column(0), "score": s, "text_score": z, "meta_score": y, "keep": s >= 0.5}

    return map_batches(documents(docs, *COLUMNS), each, "doc_id long, score double, text_score double, meta_score double, keep boolean")
