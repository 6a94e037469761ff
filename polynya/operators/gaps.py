"""Missing values: fills, completed grids, fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polynya.functions.scalars import nan_to_null
from polynya.operators.ordered import Ordered
from polynya.operators.relational import mutate_across, numeric_doubles
from polynya.operators.scale import null_safe_join, with_group


def fill_down_up(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], columns: Sequence[str], **kw
) -> DataFrame:
    """Carry the last known value forward within the group, then the next one backward."""
    specs = {}
    for c in columns:
        specs[f"_down_{c}"] = ("last", F.col(c))
        specs[f"_up_{c}"] = ("next", F.col(c))
    walked = Ordered(df, keys, order, **kw).cumulative(specs)
    filled = walked.withColumns(
        {c: F.coalesce(F.col(f"_down_{c}"), F.col(f"_up_{c}")) for c in columns}
    )
    return filled.drop(*specs)


def fill_from_below(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], columns: Sequence[str], **kw
) -> DataFrame:
    """Take a missing value from the next deeper row of the group."""
    walked = Ordered(df, keys, order, **kw).cumulative(
        {f"_up_{c}": ("next", F.col(c)) for c in columns}
    )
    filled = walked.withColumns({c: F.col(f"_up_{c}") for c in columns})
    return filled.drop(*[f"_up_{c}" for c in columns])


def complete_grid(
    df: DataFrame, key: str, step: str, always: Sequence[float]
) -> DataFrame:
    """Add the missing (key, step) rows: every key gets ``always`` besides its own steps."""
    wanted = (
        df.select(key)
        .distinct()
        .select(key, F.explode(F.array(*[F.lit(float(a)) for a in always])).alias(step))
    )
    keys = df.select(key, step).unionByName(wanted).distinct()
    return null_safe_join(keys, df, [key, step], "left")


def fill_group_max(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    filled = with_group(df, keys, {"_max": F.max(column)})
    return filled.withColumn(column, F.coalesce(column, "_max")).drop("_max")


def fallback_sum(first: Column, second: Column, default: float) -> Column:
    """Two sources added, missing as 0; a zero sum becomes the default. Both present: both count."""
    total = F.coalesce(first, F.lit(0.0)) + F.coalesce(second, F.lit(0.0))
    return F.when(total == 0, F.lit(default)).otherwise(total)


def nans_to_null(df: DataFrame) -> DataFrame:
    return mutate_across(df, numeric_doubles(df), nan_to_null)
