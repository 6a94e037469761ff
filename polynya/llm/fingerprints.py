"""Document fingerprints by order MinHash.

The k-mers of a text are numbered by occurrence, so a repeated k-mer counts as often as it
occurs. For each hash function the few smallest are selected, put back into text order, and the
tuple of their k-mers is hashed to one number of the signature. Two texts agree in a number with
the probability that the same k-mers are smallest and stand in the same order, which falls with
the edit distance, also when only the order changes.

Definitions: a null text is the empty text. A text shorter than k is one k-mer, the whole text;
the empty text has a signature of its own. Equal texts have equal signatures. Very long texts are
read whole, at about 80 bytes of memory a character. Rows of one doc_id are told apart by their
text; rows equal in both give equal results. An empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polynya.llm.base import pieces, text_size, written

FNV, GOLD = np.uint64(1099511628211), np.uint64(0x9E3779B97F4A7C15)
MOST_CUTS = 500
BLOCK = 1 << 15


@dataclass(frozen=True)
class Settings:
    k: int = 6
    functions: int = 32
    tuple_size: int = 2
    seed: int = 11


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Signer:
    def __init__(self, s: Settings):
        self.s = s
        rng = np.random.default_rng(s.seed)
        self.factor = (rng.integers(0, 2**32, s.functions, np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
        self.shift = rng.integers(0, 2**32, s.functions, np.uint64).astype(np.uint32)[:, None]

    def kmers(self, text: str) -> np.ndarray:
        code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        if not len(code):
            return code
        n = min(self.s.k, len(code))
        rolled = np.full(len(code) - n + 1, len(code) if len(code) < self.s.k else self.s.k, np.uint64)
        for i in range(n):
            rolled = rolled * FNV + code[i : len(code) - n + 1 + i]
        return mixed(rolled)

    def sign(self, text: str) -> np.ndarray:
        """One uint32 per hash function."""
        kmer = self.kmers(text)
        if not len(kmer):
            return np.zeros(self.s.functions, np.uint32)
        order = np.argsort(kmer, kind="stable")
        ranked = kmer[order]
        first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        run = np.arange(len(kmer)) - np.repeat(first, np.diff(np.append(first, len(kmer))))
        occurrence = np.empty(len(kmer), np.uint64)
        occurrence[order] = run
        numbered = (mixed(kmer + GOLD * occurrence) >> np.uint64(32)).astype(np.uint32)
        chosen = self.smallest(numbered, min(self.s.tuple_size, len(kmer)))
        chosen.sort(1)
        out = np.full(self.s.functions, GOLD, np.uint64)
        for i in range(chosen.shape[1]):
            out = mixed(out * FNV + kmer[chosen[:, i]])
        return (out >> np.uint64(32)).astype(np.uint32)


    def smallest(self, numbered: np.ndarray, width: int) -> np.ndarray:
        """Per function the places of the ``width`` smallest hashes, the first of equal ones.

        Hashes are drawn for a block of k-mers at a time, and the smallest so far are kept.
        """
        rows = np.arange(self.s.functions)
        for at in range(0, len(numbered), BLOCK):
            value = (numbered[None, at : at + BLOCK] ^ self.shift) * self.factor
            value ^= value >> np.uint32(15)
            n = min(width, value.shape[1])
            place, hashed = np.empty((len(rows), n), np.int64), np.empty((len(rows), n), np.uint32)
            for i in range(n):
                place[:, i] = value.argmin(1)
                hashed[:, i] = value[rows, place[:, i]]
                value[rows, place[:, i]] = np.uint32(0xFFFFFFFF)
            if at:
                place, hashed = np.hstack([kept_place, place + at]), np.hstack([kept_hash, hashed])
                order = np.argsort(hashed, axis=1, kind="stable")[:, :width]
                place, hashed = np.take_along_axis(place, order, 1), np.take_along_axis(hashed, order, 1)
            kept_place, kept_hash = place, hashed
        return kept_place


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of hash functions on which two signatures agree."""
    return float((a == b).mean())


def hexed(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, fingerprint`` of every row; the signature as lowercase hex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(s)
        for b in batches:
            signed = [hexed(signer.sign(t or "")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(signed, pa.string())], names=["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, fingerprint string")


def buckets_of(docs: DataFrame, buckets: int) -> Column:
    """Bucket of a row by its integer doc_id: approximate quantiles, then even cuts in each.

    Buckets follow the order of the ids; null ids lie in bucket -1. How even the buckets are
    changes the balance of the work, never the result.
    """
    key = F.col("doc_id").cast("double")
    most = min(buckets, MOST_CUTS)
    found = docs.select(key.alias("k")).stat.approxQuantile("k", [i / most for i in range(most + 1)], 0.2 / most)
    cuts = sorted({float(c) for c in found})
    if len(cuts) < 2:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(F.lit(0)).cast("long")
    each = pieces(buckets, most)
    cut = F.array(*[F.lit(c) for c in cuts])
    at = F.least(F.greatest(F.size(F.filter(cut, lambda c: c <= key)), F.lit(1)), F.lit(len(cuts) - 1))
    low, high = F.element_at(cut, at), F.element_at(cut, at + 1)
    part = F.least(F.greatest(F.floor((key - low) / (high - low) * each), F.lit(0)), F.lit(each - 1))
    return F.when(F.col("doc_id").isNull(), -1).otherwise(at * each + part).cast("long")


def with_next(docs: DataFrame, chars_each: int = 8_000_000) -> DataFrame:
    """Rows ``_bucket, _extra, doc_id, text`` laid out so that a task meets each row's successor.

    Rows are dealt by bucket and sorted by doc_id (null first, then text). The row after a
    bucket's last is the head of the next bucket, so heads (all rows that share the bucket's
    smallest id) are sent to the bucket before as extra rows too; the first bucket's to the
    last. Texts cross one shuffle; whole buckets are sorted with spilling, never held.
    """
    named = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tasks = pieces(text_size(named), chars_each, 12)
    placed = named.withColumn("_bucket", buckets_of(named, 4 * tasks))
    heads = placed.groupBy("_bucket").agg(F.min("doc_id").alias("_head"))
    by = Window.orderBy("_bucket")
    last = F.max("_bucket").over(Window.partitionBy())
    before = heads.select("_head", F.coalesce(F.lag("_bucket").over(by), last).alias("_before"))
    before = written(before, "heads")
    if 4 * tasks <= 10_000:
        before = F.broadcast(before)
    met = placed.join(before, F.col("doc_id").eqNullSafe(F.col("_head")), "left")
    own = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("e"))
    extra = F.struct(F.col("_before").alias("b"), F.lit(True).alias("e"))
    ways = F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, extra))
    dealt = met.select(F.explode(ways).alias("w"), "doc_id", "text").select(
        F.col("w.b").alias("_bucket"), F.col("w.e").alias("_extra"), "doc_id", "text"
    )
    return dealt.repartition(tasks, "_bucket").sortWithinPartitions(
        "_bucket", "_extra", F.col("doc_id").asc_nulls_first(), "text"
    )


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the beginning of the other."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def compare_edits(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Signature of every text and of its edited text, and how alike they and the next are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(s)
        held = None
        for batch in batches:
            out = []
            for bucket, extra, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if extra and held is None:
                    continue
                mine = signer.sign(text)
                if held is not None:
                    _, id_before, before, signed = held
                    changed = edited(before, text)
                    other = signer.sign(changed) if changed != before else signed
                    out.append((
                        id_before, len(before), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(),
                        hexed(signed), hexed(other), likeness(signed, other), likeness(signed, mine),
                    ))
                held = None if extra else (bucket, doc_id, text, mine)
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=schema.fieldNames()
                )

    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
    ])
    number = pa.int32() if isinstance(docs.schema["doc_id"].dataType, T.IntegerType) else pa.int64()
    kinds = [number, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return with_next(docs).mapInArrow(run, schema)


def op4_order_minhash(docs: DataFrame) -> DataFrame:
    return compare_edits(docs)
