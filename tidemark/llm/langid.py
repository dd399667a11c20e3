"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams (3 and 4 bytes, inside words and at their edges); a linear layer
and a softmax give the language. Trained by stochastic gradient descent in numpy on a bounded sample; a part of the sample that
the descent doesn't see sets the temperature and the level under which a prediction is rejected. To score, embedding and layer
are multiplied once, so each n-gram adds one short row of logits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, held_out, learnable, map_batches, one_an_id, sampled, texts

#: Rows a language on which the model is fitted, at most about; all of its documents are scored.
FIT_ROWS = 400
BUCKETS, DIM, ORDERS = 1 << 16, 16, (3, 4)
UNKNOWN = "und"


def grams(text: bytes) -> np.ndarray:
    """The hashed n-grams of a whole text. White space counts as one word edge; no n-gram holds an edge inside."""
    b = np.frombuffer(b" " + b" ".join(text.decode("utf-8", "replace").lower().encode().split()) + b" ", np.uint8)
    space, found = b == 32, []
    for n in ORDERS:
        if len(b) < n:
            continue
        h = np.full(len(b) - n + 1, n, np.uint32)
        for i in range(n):
            h = (h ^ b[i : len(h) + i]) * np.uint32(0x01000193)
        whole = np.ones(len(h), bool)
        for i in range(1, n - 1):
            whole &= ~space[i : len(h) + i]
        found.append(((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1))[whole])
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # a row for each bucket
    bias: np.ndarray
    temperature: float
    reject: float

    def predict(self, text: bytes) -> tuple[int, float]:
        g = grams(text)
        z = (self.logits[g].mean(0) if len(g) else 0) + self.bias
        p = softmax(z / self.temperature)
        k = int(p.argmax())
        return k, float(min(1.0, max(0.0, p[k])))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(rows: list[tuple[bytes, str]], epochs: int = 6, rate: float = 12.0, accept: float = 0.99, seed: int = 1) -> Model:
    """rows: whole texts and their languages; ties and order: as given. With one language only, that language is always predicted."""
    langs = sorted({lang for _, lang in rows})
    y = np.array([langs.index(lang) for _, lang in rows], np.int64)
    bags = [np.unique(grams(t), return_counts=True) for t, _ in rows]
    rng = np.random.default_rng(seed)
    E, Wt, b = rng.normal(0, 1 / DIM, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, len(langs))), np.zeros(len(langs))
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5]
    seen = order[len(rows) // 5 :]
    steps, step = max(1, epochs * len(seen)), 0
    for _ in range(epochs):
        for i in rng.permutation(seen):
            lr, step = rate * (1 - step / steps), step + 1
            g, n = bags[i]
            if not len(g):
                continue
            x = n / n.sum()
            hidden = x @ E[g]
            err = softmax(hidden @ Wt + b)
            err[y[i]] -= 1
            back = Wt @ err
            Wt -= 0.02 * lr * np.outer(hidden, err)
            E[g] -= lr * x[:, None] * back[None, :]
    P = E @ Wt
    z = np.array([(n @ P[g]) / max(1, n.sum()) + b for g, n in (bags[i] for i in held)]).reshape(-1, len(langs))

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float(-(s - np.log(np.exp(s).sum(1, keepdims=True)))[np.arange(len(held)), y[held]].mean())

    temperature = min((0.05 * 1.3**k for k in range(20)), key=loss) if len(held) else 1.0
    reject = 0.0
    if len(held):
        p = np.array([softmax(r / temperature) for r in z])
        top, right = p.max(1), p.argmax(1) == y[held]
        for level in np.sort(top):
            if right[top >= level].mean() >= accept:
                reject = float(level) if not right.all() else float(top.min()) * 0.9
                break
    return Model(langs, P.astype(np.float32), b, temperature, reject)


def train(docs: DataFrame, per_lang: int = FIT_ROWS) -> Model | None:
    """Fits on a bounded sample of the rows with a language whose id's crc32 mod 4 is not 2; None if there are none."""
    rows = sampled(documents(docs, "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learnable(F.col("doc_id"))), "lang", per_lang)
    got = [(r.text.encode(), r.lang) for r in one_an_id(rows.select("doc_id", "text", "lang")).orderBy("doc_id").collect()]  # 1.2 * per_lang rows a language
    return fit(got) if got else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row.

    Null text or text without a letter: `und`, score 0, rejected. `rejected` marks scores under the calibrated level; lang_pred is
    then still the likeliest language. Without a model every row is `und`. Only the text enters a prediction."""
    rows = documents(docs).select("doc_id", F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))

    def each(batch: pa.RecordBatch) -> dict:
        none = batch.column(1).is_null().to_pylist()
        got = [(-1, 0.0) if missing or model is None else model.predict(t) for t, missing in zip(texts(batch), none, strict=True)]
        return {
            "doc_id": batch.column(0), "lang_pred": [UNKNOWN if k < 0 else model.langs[k] for k, _ in got], "score": [s for _, s in got],
            "rejected": [k < 0 or s < model.reject for k, s in got],
        }

    return map_batches(rows, each, "doc_id long, lang_pred string, score double, rejected boolean").withColumn("held_out", held_out(F.col("doc_id")))
