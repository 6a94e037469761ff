"""Sharding: weighted rendezvous hashing of stable record keys.

Each shard draws a score from the key, ``-weight / ln(u)`` with ``u`` a hash of (seed, shard,
key) in (0, 1); the highest score takes the record. A shard's score does not depend on the
other shards, so a new shard takes records only into itself and a removed shard gives up only
its own. Expressions only; nothing is shuffled to find a shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polynya.operators.scale import durable


def score(key: Column, shard: int, weight: float, seed: int) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(shard), key.cast("string")), 12)
    unit = (bits.cast("double") + 0.5) / float(2**52)
    return F.lit(-float(weight)) / F.log(unit)


def best(key: Column, weights: Sequence[float], seed: int) -> Column:
    """Struct (score, shard) of the winner; equal scores go to the higher shard number."""
    scored = [
        F.struct(score(key, i, w, seed).alias("score"), F.lit(i).alias("shard"))
        for i, w in enumerate(weights)
    ]
    return F.array_max(F.array(*scored))


def assign(
    docs: DataFrame, key: str, weights: Sequence[float], seed: int = 0, new_weight: float = 1.0
) -> DataFrame:
    """Add ``shard`` and ``grown_shard`` (the shard once one of ``new_weight`` is added).

    Rows with equal keys share a shard; a null key hashes as one key of its own. Columns of these
    two names are replaced, all others are untouched, an empty table stays empty.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    mark = unused("won", docs)
    won = docs.withColumn(mark, best(F.col(key), weights, seed))
    new = score(F.col(key), len(weights), new_weight, seed)
    grown = F.when(new >= F.col(mark)["score"], F.lit(len(weights))).otherwise(F.col(mark)["shard"])
    return won.withColumns({"shard": F.col(mark)["shard"], "grown_shard": grown}).drop(mark)


def slots(sharded: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``slot`` (one of that name is replaced), gapless from 0 within each shard.

    No shard passes through one task: rows are numbered within (input split, shard) and each
    split starts where the splits before it end. The splits are those of a reliable checkpoint,
    so a lost executor does not move rows between them. Rows equal in every column get
    different slots.
    """
    split, start, at = (unused(name, sharded) for name in ("split", "start", "at"))
    fixed = durable(sharded).withColumn(split, F.spark_partition_id())
    counts = fixed.groupBy(split, "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy(split).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(split, "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    within = Window.partitionBy(split, "shard").orderBy(*order)
    numbered = fixed.withColumn(at, F.row_number().over(within) - 1)
    slot = F.col(start) + F.col(at)
    return numbered.join(starts, [split, "shard"]).withColumn("slot", slot).drop(split, start, at)


def unused(name: str, df: DataFrame) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def op10_rendezvous_sharding(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: where it lies among equal shards, and its place there.

    Null texts have no bytes (size 1, checksum 0); a null doc_id is one more key.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    small = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = slots(assign(small, "doc_id", [1.0] * shards), ["doc_id", "text_crc32", "size"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"),
        "grown_shard",
    )
