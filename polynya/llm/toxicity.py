"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on all windows of ordinary text, one on the short
windows of toxic text that hold a word which ordinary text hardly has. A window of a text is
compressed twice: with the ordinary dictionary, and with the toxic one laid before it. Both know
ordinary text equally well, so the bytes the second saves are those of toxic phrasing, wherever in
the window it stands. A logistic curve over the savings of all windows of a text, fitted on texts
the dictionaries have not seen, gives the score; it is shifted so that the best cut on those texts
lies at the threshold.

Definitions: a null or empty text has no windows and saves nothing; it gets the score of savings
zero. Every window of a text counts, however long it is. Equal texts get equal scores, repeated
rows one each. An empty table gives an empty one; without labels of both classes every score is 0.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polynya.llm.base import crc_mod, labelled_sample, scored

THRESHOLD = 0.7
MARKS = b".,;:!?\"'()[]"
AT_ENDS = re.compile(rb"(?<!\S)[%b]+|[%b]+(?!\S)" % (re.escape(MARKS), re.escape(MARKS)))
# zstandard looks for no match in the last bytes of its input, so these follow every window. Both
# dictionaries hold them: every window has a match, and one more costs the same in each.
TAIL = bytes(range(1, 17))
# The last entry of a dictionary's head, the three repeat offsets 1, 4 and 8.
TABLES_END = np.array([1, 4, 8], "<u4").tobytes()


@dataclass(frozen=True)
class Settings:
    """``per_class`` bounds the labelled rows that the fit sees, whole texts; nothing else is bounded.

    Chosen by cross-validation inside the learning rows.
    """

    per_class: int = 1500
    window_words: int = 6
    toxic_words: int = 2
    ordinary_bytes: int = 65536
    toxic_bytes: int = 2048
    contexts: float = 0.012
    contrast: float = 10.0
    calibration: float = 0.3
    seed: int = 7


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    window_words: int
    weights: tuple[float, ...]


def tokens(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split()


def apart(word: bytes) -> bytes:
    """A word and the marks at its ends, with blanks between them."""
    return AT_ENDS.sub(rb" \g<0> ", word).strip()


def windows(text: str, n: int) -> list[bytes]:
    words = [apart(w) for w in tokens(text)]
    return [b" " + b" ".join(words[i : i + n]) + b" " for i in range(0, len(words), n)]


def compressor(content: bytes) -> Callable[[bytes], bytes]:
    """Compressor that starts from ``content`` and leaves out every constant frame field."""
    given = zstandard.ZstdCompressionParameters(
        window_log=20, hash_log=17, chain_log=18, search_log=5, min_match=4,
        strategy=zstandard.STRATEGY_LAZY, write_checksum=False, write_content_size=False, write_dict_id=False,
    )
    known = zstandard.ZstdCompressionDict(TAIL + content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=given)
    compress = zstandard.ZstdCompressor(dict_data=known, compression_params=given).compress
    return lambda window: compress(window + TAIL)


def savings(model: Model) -> Callable[[str], np.ndarray]:
    """Per text: bytes the toxic dictionary saves in each window."""
    plain, toxic = compressor(model.ordinary), compressor(model.toxic + model.ordinary)
    n = model.window_words

    def of(text: str) -> np.ndarray:
        return np.array([len(plain(w)) - len(toxic(w)) for w in windows(text, n)], float)

    return of


def features(saved: np.ndarray) -> list[float]:
    n = max(len(saved), 1)
    top = saved.max(initial=0.0)
    return [1.0, saved.sum() / n, saved.sum() / np.sqrt(n), top / 4, 4 * float((saved >= 4).sum()) / np.sqrt(n)]


def dictionary(samples: Sequence[bytes], size: int) -> bytes:
    """Content of a trained dictionary; samples too few to train on serve as they are."""
    try:
        trained = zstandard.train_dictionary(size, list(samples), level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))
    return trained[trained.index(TABLES_END) + len(TABLES_END) :]


def contexts(texts: Sequence[str]) -> Counter:
    """Number of different words that each word follows."""
    met: set[tuple[bytes, bytes]] = set()
    for t in texts:
        words = [w.strip(MARKS) for w in tokens(t)]
        met.update(zip([b"", *words], words, strict=False))
    return Counter(w for _, w in met if w)


def train_dictionaries(ordinary: Sequence[str], toxic: Sequence[str], s: Settings) -> tuple[bytes, bytes]:
    # A word counts once for each word before it, so a copied passage counts once as a whole.
    seen, met = contexts(ordinary), contexts(toxic)
    least = max(3, int(s.contexts * len(toxic)))
    telling = {
        w for w, n in met.items() if n >= least and n * len(ordinary) >= s.contrast * seen[w] * len(toxic)
    }
    harsh = [
        w for t in toxic for w in dict.fromkeys(windows(t, s.toxic_words))
        if any(v.strip(MARKS) in telling for v in w.split())
    ]
    usual = sorted({w for t in ordinary for w in windows(t, s.window_words)})
    # The trainer learns from the first samples and tries the rest, so their order must be mixed.
    mixed = random.Random(s.seed)
    mixed.shuffle(harsh)
    mixed.shuffle(usual)
    return dictionary(usual, s.ordinary_bytes), dictionary(harsh, s.toxic_bytes)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The cut with the highest F1 for ``z >= cut``, in the middle of its gap."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
    last = np.append(z[order][1:] != z[order][:-1], True)
    at = int(np.argmax(np.where(last, f1, -1)))
    below = z[order][at + 1] if at + 1 < len(z) else z[order][at] - 1.0
    return float((z[order][at] + below) / 2)


def fit(sample: Sequence[tuple[str, int]], s: Settings = Settings()) -> Model:
    """Dictionaries from one part of the sample, curve and cut from the rest.

    Without texts of both classes nothing can be learned, and every score is 0.
    """
    sample = list(dict.fromkeys(sample))
    if len({y for _, y in sample}) < 2:
        return Model(b" ", b" ", s.window_words, (-30.0, 0.0, 0.0, 0.0, 0.0))
    every = max(2, round(1 / s.calibration))
    learn = [x for i, x in enumerate(sample) if i % every] or sample
    check = sample[::every]
    if len({y for _, y in check}) < 2 or len({y for _, y in learn}) < 2:
        learn = check = sample
    ordinary, toxic = train_dictionaries([t for t, y in learn if not y], [t for t, y in learn if y], s)
    saved = savings(Model(ordinary, toxic, s.window_words, ()))
    x = np.array([features(saved(t)) for t, _ in check])
    y = np.array([y for _, y in check], float)
    w = logistic(x, y, np.ones(len(y)))
    w[0] += np.log(THRESHOLD / (1 - THRESHOLD)) - best_cut(x @ w, y)
    return Model(ordinary, toxic, s.window_words, tuple(float(v) for v in w))


def scorer(model: Model) -> Callable[[list[str]], np.ndarray]:
    held: list = []

    def score(texts: list[str]) -> np.ndarray:
        if not held:
            held.append(savings(model))
        z = np.array([features(held[0](t)) for t in texts]).reshape(len(texts), -1) @ np.array(model.weights)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    return score


def learnt(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Fit on labelled rows outside the held-out third (crc32 of the id, remainder 1 of 3)."""
    return fit(labelled_sample(docs, labels, "toxic", crc_mod(F.col("doc_id"), 3) != 1, s.per_class), s)


def rate(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` of every row."""
    out = scored(docs, scorer(model))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns as they were."""
    score = scorer(model)

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.names.index("text")).to_pylist()]
            yield b.filter(pa.array(score(texts) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = rate(docs, learnt(docs, labels))
    return out.select(
        "doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted"
    )
