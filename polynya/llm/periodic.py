"""Periodic runs of words, found online by a sparse diagonal DP.

Words are read from left to right. The earlier occurrences of what is read give lags; each lag's
match length grows by one while word and earlier word stay equal (a diagonal of the text's match
table). A diagonal that ends after at least its own lag of matches has read a stretch of that
period, at least two periods long, and emits it at once.

Two rules keep the table sparse, neither loses a run:

* A run needs at least 12 words and two periods, hence six matches in a row at its lag. So six
  words are looked up instead of one: a diagonal of six-word matches is five shorter than the same
  diagonal of single words, and running prose has next to none.
* Inside a run of period q, a lag k*q whose earlier word lies in the run too ends where lag q ends
  and never has k*q as its smallest period. When each six words stand once per period there, these
  are all lags but q, and they are not looked up.

Time grows with the six-word matches between different runs of the same words; memory with the
text.

Definitions: a null or empty text has no words and no runs. A null doc_id has the empty decimal.
Every row is worked alone, so repeated rows give equal results and an empty table stays empty.
Very long texts are read whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polynya.llm.base import frames

SHORTEST = 12
GRAM = 6
FEW = 10  # up to so many lags, hits that change nothing are told ahead and passed over
Run = tuple[int, int, int]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def numbered(words: Sequence[bytes]) -> np.ndarray:
    """One number per word, equal for equal words."""
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.array(list(map(known.__getitem__, words)), np.int64)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number per pair, equal for equal pairs; both arrays hold numbers under their length."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]


def grams(ids: np.ndarray) -> np.ndarray:
    """One number per six words in a row."""
    two = paired(ids[:-1], ids[1:])
    four = paired(two[:-2], two[2:])
    return paired(four[:-2], two[4:])


def steady(hits: np.ndarray, order: np.ndarray, at: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """For each hit: it follows the hit before it, and all lags are the same (told for few lags)."""
    same = np.zeros(len(hits), bool)
    if len(hits) < 2:
        return same
    now, then = hits[1:], hits[:-1]
    same[1:] = (now == then + 1) & (earlier[now] == earlier[then]) & (earlier[now] <= FEW)
    for k in range(1, FEW + 1):
        some = np.flatnonzero(same & (earlier[hits] >= k))
        if not len(some):
            break
        now = hits[some]
        same[some] = order[at[now] - k] == order[at[now - 1] - k] + 1
    return same


def periodic_runs(words: Sequence[bytes]) -> list[Run]:
    """All runs as (start, length, period), by start and period.

    A run is a stretch of at least max(12, 2 periods) words with that smallest period which no
    neighbour extends.
    """
    if len(words) < SHORTEST:
        return []
    gram = grams(numbered(words))
    order = np.argsort(gram, kind="stable")
    at = np.empty(len(gram), np.int64)  # the place of each gram in ``order``
    at[order] = np.arange(len(gram))
    earlier = at - np.searchsorted(gram[order], gram)  # how often it came before
    hits = np.flatnonzero(earlier)
    if not len(hits):
        return []
    changes = np.flatnonzero(~steady(hits, order, at, earlier))
    opened = np.zeros(len(gram) + 1, np.int64)  # by lag: where its diagonal begins
    last = np.full(len(gram) + 1, -2, np.int64)  # by lag: last change it went through
    active = np.empty(0, np.int64)
    found: list[Run] = []

    def emit(ended: np.ndarray, end: int) -> None:
        matches = end - opened[ended] + GRAM - 1
        for lag in ended[(matches >= ended) & (matches + ended >= SHORTEST)].tolist():
            start = int(opened[lag]) - lag
            inner = active[(active < lag) & (opened[active] - active <= start)]
            if not (lag % inner == 0).any():
                found.append((start, end + GRAM - 1 - start, lag))

    def through(i: int, q: int, start: int) -> int:
        """Up to where lag q goes on and all other lags are multiples of it inside the run."""
        step = 64
        while i < len(gram):
            stop = min(i + step, len(gram))
            on = gram[i:stop] == gram[i - q : stop - q]
            on &= earlier[i:stop] == (np.arange(i, stop) - start) // q
            if not on.all():
                return i + int(on.argmin())
            i, step = stop, 2 * step
        return i

    starts = hits[changes]
    reach = hits[np.append(changes[1:], len(hits)) - 1]  # the last hit before the next change
    turn, before = 0, -2  # the change that is read, the last hit before it
    while turn < len(starts):
        i = int(starts[turn])
        if i != before + 1 and len(active):
            emit(active, before + 1)
            last[active] = -2
            active = active[:0]
        places = order[at[i] - earlier[i] : at[i]]
        ahead = turn
        if len(active) and len(places) > 2:
            q = int(active.min())
            start = int(opened[q]) - q
            inside = int(np.searchsorted(places, start))
            if len(places) - inside == (i - start) // q and places[-1] == i - q:
                places = np.append(places[:inside], i - q)
                if not inside:
                    ahead = int(np.searchsorted(starts, through(i, q, start))) - 1
        lags = i - places
        fresh = lags[last[lags] != turn - 1]
        ended = active[last[active] == turn - 1]
        last[lags] = ahead
        ended = ended[last[ended] != ahead]
        if len(ended):
            emit(ended, i)
        opened[fresh] = i
        active, before, turn = lags, int(reach[ahead]), ahead + 1
    if len(active):
        emit(active, before + 1)
    return sorted((s, n, q) for s, n, q in found)


def collapsed(words: Sequence[bytes], runs: Sequence[Run]) -> list[bytes]:
    """The words outside runs and those of each run's first period."""
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edges[start + q] += 1
        edges[start + length] -= 1
    gone = np.cumsum(edges)
    return [w for w, g in zip(words, gone.tolist(), strict=False) if not g]


def find_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, start, length, period``, one row per run of each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in frames(batches, 256):
            out = [(r["doc_id"], *run) for r in rows for run in periodic_runs(words_of(r["text"]))]
            yield as_batch(out, ["doc_id", "start", "length", "period"], kind)

    kind = docs.schema["doc_id"].dataType
    few = docs.select("doc_id", F.col("text").cast("string"))
    return few.mapInArrow(work, f"doc_id {kind.simpleString()}, start long, length long, period long")


def collapse_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with every run in ``text`` cut to its first period, words joined by one space.
    Texts without runs, and all other columns, stay as they are."""

    def shorter(text: str | None) -> str | None:
        words = words_of(text)
        runs = periodic_runs(words)
        return b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass") if runs else text

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.names.index("text")
            texts = pa.array([shorter(t) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), texts)

    return docs.mapInArrow(work, docs.schema)


def as_batch(rows: list[tuple], names: list[str], key) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {"doc_id": to_arrow_type(key), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    arrays = [pa.array(list(c), kinds.get(n, pa.int64())) for n, c in zip(names, columns, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def planted(words: list[bytes], doc_id) -> list[bytes]:
    """The words with a run planted where the checksum of the doc_id says so."""
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op11_row(doc_id, text: str | None) -> tuple:
    words = planted(words_of(text), doc_id)
    runs = periodic_runs(words)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    kept = b" ".join(collapsed(words, runs) if runs else words)
    return (
        doc_id, len(runs), s, n, q, 1000 * n // q if runs else None,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


def op11_periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per document: its number of runs, the longest, digests of all and of what is left."""
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in frames(batches, 256):
            yield as_batch([op11_row(r["doc_id"], r["text"]) for r in rows], names, kind)

    kind = docs.schema["doc_id"].dataType
    schema = (
        f"doc_id {kind.simpleString()}, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string"
    )
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(work, schema)


# Lags from all pairs of equal words, diagonals as islands; no six-word rule.
OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ord(c)::UBIGINT) AS bytes
  FROM documents
), h AS MATERIALIZED (
  SELECT r, doc_id, w, len(w)::BIGINT AS n,
         xor(4294967295::UBIGINT, list_reduce(bytes, lambda c, b: list_reduce(range(8)::UBIGINT[],
             lambda x, i: xor(x >> 1, 3988292384::UBIGINT * (x & 1)), xor(c, b)), 4294967295::UBIGINT))::BIGINT AS h
  FROM d
), p AS (
  SELECT *, h // 10 AS g, h % 10 = 0 AND n > 0 AS yes, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h
), q AS (
  SELECT *, CASE WHEN yes THEN 1 + (n - a) // (3 + g % 8) END AS p FROM p
), x AS MATERIALIZED (
  SELECT r, i, CASE WHEN yes AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM q)
), m AS (
  SELECT y.r, y.i - x.i AS lag, y.i, y.i - row_number() OVER (PARTITION BY y.r, y.i - x.i ORDER BY y.i) AS island
  FROM x JOIN x AS y ON x.r = y.r AND x.word = y.word AND x.i < y.i
), s AS MATERIALIZED (
  SELECT r, lag, min(i) - lag AS start, max(i) + 1 AS stop FROM m GROUP BY r, lag, island
  HAVING count(*) >= lag AND count(*) + lag >= 12
), u AS MATERIALIZED (
  SELECT * FROM s WHERE NOT EXISTS (
    SELECT 1 FROM s AS t WHERE t.r = s.r AND t.lag < s.lag AND s.lag % t.lag = 0 AND t.start <= s.start AND t.stop >= s.stop)
), f AS (
  SELECT r, count(*) AS n_runs,
         arg_min(struct_pack(start := start, length := stop - start, period := lag),
                 struct_pack(a := start - stop, b := start, c := lag)) AS best,
         string_agg(start || ',' || (stop - start) || ',' || lag || chr(10), '' ORDER BY start, lag) AS listed
  FROM u GROUP BY r
), k AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM x
  WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.r = x.r AND x.i >= u.start + u.lag AND x.i < u.stop) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length,
       best.period::BIGINT AS period, (1000 * best.length // best.period)::BIGINT AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM h LEFT JOIN f USING (r) LEFT JOIN k USING (r)
"""
