"""Mixing sources to target weights.

Tokens are counted per source, targets are shares of the whole by weight that stop at a
multiple of the source's size (the excess is shared again), and a source's rate is target /
size. Each document is emitted floor(rate) times, plus once more when a coin seeded by its id
falls below the fraction. Expressions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polynya.llm.base import written

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_SOURCES = 10_000


def words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """One row per source: ``source, source_size, target, rate``. ``docs`` has ``source, size``.

    Sharing the excess again until no target is above its cap gives min(weight * level, cap *
    size) for the one level at which the targets sum to the whole. Sources sorted by cap / weight
    reach their caps in that order, so the level follows from running sums over the sources.
    Only this table of one row per source is ordered as a whole. A source without words has
    target 0 and rate 0.
    """
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_code) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), place.cast("int") + 1).cast("long")
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sizes.withColumn("_w", weight).withColumn(
        "_fills", F.lit(cap) * F.col("source_size") / F.col("_w")
    )
    everything = Window.partitionBy()
    before = Window.orderBy("_fills", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.col("_all") - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    ) / (F.col("_weights") - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    running = (
        ranked.withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_weights", F.sum("_w").over(everything))
        .withColumn("_level", level)
    )
    # The level is that of the first source whose cap lies at or above it.
    found = F.min(F.when(F.col("_fills") >= F.col("_level"), F.struct("_fills", "_level"))).over(everything)
    capped = F.lit(cap) * F.col("source_size")
    full = F.col("_w") * F.col("_found._level") >= capped
    return running.withColumn("_found", found).select(
        "source",
        "source_size",
        F.when(full, capped.cast("double")).otherwise(F.col("_w") * F.col("_found._level")).alias("target"),
        F.when(F.col("source_size") == 0, 0.0)
        .when(full, F.lit(float(cap)))
        .otherwise(F.col("_w") * F.col("_found._level") / F.col("source_size"))
        .alias("rate"),
    )


def coin(key: Column, seed: str) -> Column:
    """A number in [0, 1) fixed by key and seed."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(2**52)


def mix(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: str = "mix"
) -> DataFrame:
    """``doc, size, source_size, target, copies`` of every row; ``doc`` is the row itself, so its
    columns may have any names.

    Rows with the same doc_id share a coin. A null text has size 0, a null source is a source,
    a null doc_id tosses the coin of the empty id. An empty table stays empty.
    """
    sized = docs.select(F.struct(*docs.columns).alias("doc"), words(F.col("text")).alias("size"))
    of_source = sized.select(F.col("doc.source").alias("source"), "size")
    rates = written(targets(of_source, weights, cap), "mix-rates")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    joined = sized.join(rates, F.col("doc.source").eqNullSafe(F.col("source")))
    whole = F.floor("rate")
    extra = F.when(coin(F.col("doc.doc_id"), seed) < F.col("rate") - whole, 1).otherwise(0)
    copies = (whole + extra).cast("long").alias("copies")
    return joined.select("doc", "size", "source_size", "target", copies)


def emit(mixed: DataFrame) -> DataFrame:
    """Each document as often as its copies say, with its own columns."""
    times = F.array_repeat(F.lit(0), F.col("copies").cast("int"))
    return mixed.select("doc", F.explode(times)).select("doc.*")


def op8_source_mixing(docs: DataFrame) -> DataFrame:
    """One row per document: its size, its source's size and target, the words the mix takes."""
    return mix(docs.select("doc_id", "text", "source")).select(
        "doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS w FROM s
), f AS (
  SELECT *, (3 * source_size)::DOUBLE / w AS fills, sum(source_size) OVER () AS all_words,
         sum(w) OVER () AS weights FROM w
), r AS (
  SELECT *, (all_words - 3 * coalesce(sum(source_size) OVER p, 0))::DOUBLE
            / (weights - coalesce(sum(w) OVER p, 0))::DOUBLE AS level
  FROM f
  WINDOW p AS (ORDER BY fills, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT arg_min(level, struct_pack(a := fills, b := level)) AS level FROM r WHERE fills >= level
), t AS (
  SELECT source, source_size,
         CASE WHEN w * l.level >= 3 * source_size THEN (3 * source_size)::DOUBLE ELSE w * l.level END AS target,
         CASE WHEN source_size = 0 THEN 0.0 WHEN w * l.level >= 3 * source_size THEN 3.0::DOUBLE
              ELSE w * l.level / source_size::DOUBLE END AS rate
  FROM r, l
)
SELECT d.doc_id, d.size, t.source_size, t.target,
       (d.size * (floor(rate) + CASE WHEN ('0x' || md5('mix:' || coalesce(d.doc_id::VARCHAR, ''))[1:13])::BIGINT::DOUBLE
             / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
