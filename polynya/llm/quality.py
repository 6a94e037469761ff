"""Quality by supervised subword embeddings.

A document is the mean of the vectors of its features: hashed words, and hashed character
n-grams of the text with a blank between words. A softmax over the mean gives the class; vectors
and softmax are trained by stochastic gradient descent. Once trained, the softmax is applied to
each vector beforehand, so scoring a text sums one number per feature over the whole text.

Definitions: a null or empty text has no features and gets the score of the mean of the training
texts. Case and marks count. Equal texts get equal scores, repeated rows one each. Very long
texts are read whole, in memory that grows with the text (about 60 bytes a character). An empty
table gives an empty one; without labels of both classes every score is 1.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import pyarrow as pa

from polynya.llm.base import crc_mod, labelled_sample, scored

THRESHOLD = 0.3
PRIME = np.uint32(16777619)
SPREAD = np.uint32(2654435769)


@dataclass(frozen=True)
class Settings:
    """``per_class`` bounds the labelled rows that the fit sees, whole texts; nothing else is bounded."""

    per_class: int = 2000
    bits: int = 17
    dim: int = 8
    orders: tuple[int, ...] = (2, 3, 4)
    epochs: int = 8
    rate: float = 8.0
    seed: int = 7
    pair_weight: int = 4


@dataclass(frozen=True)
class Model:
    table: np.ndarray
    offset: float
    settings: Settings


def features(text: str, s: Settings) -> np.ndarray:
    """Buckets of all words and n-grams of the text, repeats included."""
    flat = " ".join(text.split())
    if not flat:
        return np.empty(0, np.uint32)
    code = np.frombuffer(f" {flat} ".encode("utf-32-le", "replace"), np.uint32)
    out, rolled = [], code.copy()
    for n in range(2, max(s.orders) + 1):
        rolled = rolled[:-1] * PRIME + code[n - 1 :]
        if n in s.orders:
            out.append(rolled ^ np.uint32(n))
    blank = np.flatnonzero(code == 32)
    start = np.repeat(blank, np.diff(np.append(blank, len(code))))
    within = np.arange(len(code)) - start
    powers = np.cumprod(np.full(int(within.max()) + 1, PRIME, np.uint32), dtype=np.uint32)
    word = np.add.reduceat((code * powers[within])[:-1], blank[:-1], dtype=np.uint32)
    out.append(word ^ np.uint32(0x5BD1E995))
    # Word pairs by shape: the second repeats the first, or not.
    again = (word[1:] == word[:-1]).astype(np.uint32) + np.uint32(0xA511E9B3)
    out.append(np.repeat(again, s.pair_weight))
    return (np.concatenate(out) * SPREAD) >> np.uint32(32 - s.bits)


def fit(sample: Sequence[tuple[str, int]], s: Settings = Settings()) -> Model:
    """Train on (text, label). Without both classes nothing can be learned; every score is 1."""
    sample = [x for x in dict.fromkeys(sample) if x[0].split()]
    if len({y for _, y in sample}) < 2:
        return Model(np.zeros(1 << s.bits, np.float32), 30.0, s)
    counted = []
    for text, _ in sample:
        bucket, times = np.unique(features(text, s), return_counts=True)
        counted.append((bucket, (times / times.sum()).astype(np.float32)[:, None]))
    y = np.array([v for _, v in sample])
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (1 << s.bits, s.dim)).astype(np.float32)
    out = np.zeros((2, s.dim), np.float32)
    steps, done = s.epochs * len(sample), 0
    weight = len(y) / (2 * np.bincount(y, minlength=2))
    for _ in range(s.epochs):
        for i in rng.permutation(len(sample)):
            rate = s.rate * (1 - done / steps)
            done += 1
            bucket, share = counted[i]
            mean = (vectors[bucket] * share).sum(0)
            z = out @ mean
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= weight[y[i]]
            back = p @ out
            out -= 0.05 * rate * np.outer(p, mean).astype(np.float32)
            vectors[bucket] -= rate * share * back
    table = vectors @ (out[1] - out[0])
    z = np.array([(table[b] * c[:, 0]).sum() for b, c in counted])
    # Scale and offset of the log-odds, by Newton steps on the training texts.
    x, a = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        a += np.linalg.solve(h, x.T @ (y - p) - 0.1 * a)
    return Model((table * a[0]).astype(np.float32), float(a[1]), s)


def scorer(model: Model) -> Callable[[list[str]], np.ndarray]:
    table, offset, s = model.table, model.offset, model.settings

    def one(text: str) -> float:
        bucket = features(text, s)
        return float(table[bucket].mean(dtype=np.float64)) + offset if len(bucket) else offset

    def score(texts: list[str]) -> np.ndarray:
        z = np.array([one(t) for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    return score


def learnt(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Fit on labelled rows outside the held-out fifth (crc32 of the id, remainder 0 of 5)."""
    return fit(labelled_sample(docs, labels, "quality", crc_mod(F.col("doc_id"), 5) != 0, s.per_class), s)


def rate(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` of every row; the table of the model is 2**bits numbers."""
    out = scored(docs, scorer(model))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` predicted good, with their columns as they were."""
    score = scorer(model)

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.names.index("text")).to_pylist()]
            yield b.filter(pa.array(score(texts) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = rate(docs, learnt(docs, labels))
    return out.select(
        "doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted"
    )
