"""Group aggregates. All combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polynya.functions.quantiles import group_quantiles
from polynya.operators.scale import null_safe_join


def mean_sd_n(df: DataFrame, keys: Sequence[str], value: Column, prefix: str = "") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(value).alias(f"{prefix}mean"),
        F.stddev_samp(value).alias(f"{prefix}sd"),
        F.count(value).alias(f"{prefix}n"),
    )


def mean_cv(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and absolute coefficient of variation in percent (null when the mean is 0 or n < 2)."""
    stats = df.groupBy(*keys).agg(
        F.avg(value).alias(f"mean_{value}"), F.stddev_samp(value).alias("_sd")
    )
    cv = F.abs(F.try_divide(F.col("_sd") * 100, F.col(f"mean_{value}")))
    return stats.withColumn(f"cv_{value}", cv).drop("_sd")


def any_known(condition: Column, inside: Column) -> Column:
    """Three-valued any over the rows ``inside``: true, else unknown if one is, else false."""
    c = F.when(inside, condition)
    return (
        F.when(F.coalesce(F.bool_or(c), F.lit(False)), F.lit(True))
        .when(F.count(c) < F.count_if(inside), F.lit(None).cast("boolean"))
        .otherwise(F.lit(False))
    )


def strict_median(value: Column, inside: Column) -> Column:
    """Median of ``value`` over the rows ``inside``, unknown if one is null or there is none.

    The aggregate holds the values: for groups that are small by construction."""
    return F.when(F.count_if(inside & value.isNull()) == 0, F.percentile(F.when(inside, value), 0.5))


def band_median(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    x: str,
    low: float,
    high: float,
    out: str,
    strict: bool = False,
    **kw,
) -> DataFrame:
    """Median of ``value`` where low <= x <= high, one row per group (null if the band is empty).

    ``strict``: one null value inside the band makes the median null.
    """
    band = F.col(x).between(low, high)
    medians = group_quantiles(df, keys, F.when(band, value), {out: 0.5}, **kw)
    if not strict:
        return medians
    gaps = df.groupBy(*keys).agg(F.count_if(band & value.isNull()).alias("_gaps"))
    joined = null_safe_join(medians, gaps, keys)
    return joined.withColumn(out, F.when(F.col("_gaps") == 0, F.col(out))).drop("_gaps")


def value_at_max(
    df: DataFrame, keys: Sequence[str], x: str, y: str, ties: Sequence[str] = ()
) -> DataFrame:
    """y at the largest x (on equal x the row lowest in ``ties``) and the largest y."""
    place = F.struct(F.col(x), *[-F.col(c) for c in ties], F.col(y))
    return df.groupBy(*keys).agg(
        F.max_by(y, F.when(F.col(x).isNotNull(), place)).alias(f"{y}_at_max_{x}"),
        F.max(y).alias(f"max_{y}"),
    )


def has_ids(df: DataFrame, keys: Sequence[str], text: str, patterns: Sequence[str]) -> DataFrame:
    """Groups holding at least one id for each pattern: TRUE/FALSE per group."""
    ok = F.lit(True)
    for p in patterns:
        ok = ok & F.bool_or(F.coalesce(F.col(text).rlike(f"(?i){p}"), F.lit(False)))
    return df.groupBy(*keys).agg(ok.alias("is_valid"))


def count_sorted(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(key))


def daily_counts(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: Column, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """Counts in bins of ``width`` centred on its multiples."""
    centre = F.floor(value / width + 0.5) * F.lit(width)
    return df.groupBy(*keys, centre.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, keys: Sequence[str], value: str, **kw) -> DataFrame:
    """Quartiles, whiskers at the last point within 1.5 IQR, count and outlier count."""
    quartiles = group_quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, **kw)
    joined = null_safe_join(df.select(*keys, value), quartiles, keys)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return joined.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.first("q1").alias("q1"),
        F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def group_size_check(df: DataFrame, keys: Sequence[str], expected: int) -> DataFrame:
    """Groups that do not have exactly ``expected`` rows."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.filter(F.col("n") != expected)


def signal_to_noise(
    df: DataFrame, keys: Sequence[str], x: str, kind: str, value: str,
    signal: str = "s", noise: str = "r",
) -> DataFrame:
    """Per group and x: mean signal, mean absolute reference, and their ratio."""
    is_signal, is_noise = F.col(kind) == signal, F.col(kind) == noise
    means = df.groupBy(*keys, x).agg(
        F.avg(F.when(is_signal, F.col(value))).alias("signal"),
        F.avg(F.when(is_noise, F.abs(value))).alias("noise"),
    )
    return means.withColumn("ratio", F.try_divide("signal", "noise"))
