"""Exact quantiles (linear between order statistics) for groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polynya.operators.ordered import Ordered
from polynya.operators.scale import null_safe_join


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    probs: Mapping[str, float],
    small: bool = False,
    **kw,
) -> DataFrame:
    """One row per group with the named quantiles of the non-null values.

    ``small``: the groups are small by construction, one task may hold a group's values.
    Otherwise values are counted, and the counts summed along the ordered values in blocks.
    """
    if not keys:
        whole = group_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs, **kw)
        return whole.drop("_all")
    column = F.col(value) if isinstance(value, str) else value
    slim = df.select(*keys, column.cast("double").alias("_v"))
    if small:
        return slim.groupBy(*keys).agg(*[F.percentile("_v", p).alias(n) for n, p in probs.items()])
    # A group without values has one row, of a null value that counts nothing.
    counts = slim.groupBy(*keys, "_v").agg(F.count("_v").alias("_c"))
    sums = Ordered(counts, keys, ["_v"], **kw).cumulative(
        {"_cum": ("sum", F.col("_c")), "_rest": ("rest", F.col("_c"))}
    )
    before, n = F.col("_cum") - F.col("_c"), F.col("_cum") + F.col("_rest") - F.col("_c")
    aggs = []
    for name, p in probs.items():
        at = (n - 1) * F.lit(float(p))

        def pick(rank: Column) -> Column:
            return F.max(F.when((before <= rank) & (rank < F.col("_cum")), F.col("_v")))

        low, high = pick(F.floor(at)), pick(F.ceil(at))
        aggs.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return sums.groupBy(*keys).agg(*aggs)


def add_group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str | Column, probs: Mapping[str, float], **kw
) -> DataFrame:
    return null_safe_join(df, group_quantiles(df, keys, value, probs, **kw), keys)
