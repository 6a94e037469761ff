"""Projections, filters, set operations and reshaping."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from polynya.operators.ordered import Ordered
from polynya.operators.scale import null_safe_join, with_group


# -- names and projections ------------------------------------------------------------------


def tidy_name(name: str) -> str:
    """snake_case: camel humps split, other signs to underscores."""
    humps = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)
    return re.sub(r"[^0-9A-Za-z]+", "_", humps).strip("_").lower()


def tidy_names(df: DataFrame) -> DataFrame:
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        base = tidy_name(c)
        seen[base] = seen.get(base, 0) + 1
        names.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return df.toDF(*names)


def drop_empty(df: DataFrame) -> DataFrame:
    """Drop all-null rows and all-null columns (one pass of counts picks the columns)."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.dropna("all").select(*[F.col(f"`{c}`") for c in df.columns if counts[c]])


def select_like(
    df: DataFrame,
    contains: str | None = None,
    starts: str | None = None,
    first_to_last: tuple[str, str] | None = None,
) -> list[str]:
    """Column names by substring, by prefix or by range, in table order."""
    cols = df.columns
    if first_to_last:
        a, b = (cols.index(c) for c in first_to_last)
        return cols[a : b + 1]
    return [
        c
        for c in cols
        if (contains is None or contains in c) and (starts is None or c.startswith(starts))
    ]


def mutate_across(df: DataFrame, names: Sequence[str], f) -> DataFrame:
    return df.withColumns({c: f(F.col(c)) for c in names})


def numeric_doubles(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]


def round_numeric(df: DataFrame, digits: int = 2) -> DataFrame:
    """Round every floating column, half to even."""
    return mutate_across(df, numeric_doubles(df), lambda c: F.bround(c, digits))


def entry_template(df: DataFrame, before: Mapping[str, str], after: Mapping[str, str]) -> DataFrame:
    """Blank typed columns around the data, for later entry by hand."""
    blank = lambda spec: [F.lit(None).cast(t).alias(n) for n, t in spec.items()]
    return df.select(*blank(before), "*", *blank(after))


# -- filters --------------------------------------------------------------------------------


def in_box(
    lon: Column, lat: Column, west: float, east: float, south: float, north: float,
    closed: bool = True,
) -> Column:
    if closed:
        return lon.between(west, east) & lat.between(south, north)
    return (lon > west) & (lon < east) & (lat > south) & (lat < north)


def matches(text: Column, pattern: str) -> Column:
    """Case-insensitive regular expression."""
    return text.rlike(f"(?i){pattern}")


def in_season(
    day: Column, first_month: int | None = None, start: str | None = None, end: str | None = None
) -> Column:
    cond = F.lit(True)
    if first_month is not None:
        cond = cond & (F.month(day) >= first_month)
    if start is not None:
        cond = cond & (day >= F.to_date(F.lit(start)))
    if end is not None:
        cond = cond & (day <= F.to_date(F.lit(end)))
    return cond


def keep_groups(df: DataFrame, keys: Sequence[str], condition: Column) -> DataFrame:
    """All rows of the groups whose aggregate condition holds."""
    good = df.groupBy(*keys).agg(condition.alias("_ok")).filter("_ok").select(*keys)
    return null_safe_join(df, good, keys, "left_semi")


def keep_repeated(df: DataFrame, keys: Sequence[str], more_than: int = 1) -> DataFrame:
    return keep_groups(df, keys, F.count(F.lit(1)) > more_than)


def keep_mixed(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Groups with more than one distinct value of ``column``."""
    return keep_groups(df, keys, F.min(column) != F.max(column))


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows null (or NaN) in the columns."""
    cols = list(subset or df.columns)
    return df.dropna("any", subset=cols)


def distinct_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Distinct keys with the first full row by ``order``, missing values last; an aggregate, so hot
    keys combine early."""
    rest = [c for c in df.columns if c not in keys]
    place = F.struct(*[c for o in order for c in (F.col(o).isNull().alias(f"no_{o}"), F.col(o))])
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), place).alias("_row"))
    return first.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


# -- set operations and stacking ------------------------------------------------------------


def union_sources(tables: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    """Stack tables with different columns (missing ones null) and tag where rows came from."""
    stacked = None
    for name, df in tables.items():
        tagged = df.withColumn(tag, F.lit(name))
        stacked = tagged if stacked is None else stacked.unionByName(tagged, True)
    return stacked


def union_all(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def table_diff(a: DataFrame, b: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``a`` with no equal row in ``b`` (nulls equal)."""
    return null_safe_join(a, b.select(*(keys or a.columns)).distinct(), keys or a.columns, "left_anti")


# -- sort and head --------------------------------------------------------------------------


def sort_multi(df: DataFrame, *by: str) -> DataFrame:
    """Sort by names, ``-name`` for descending; missing values last either way."""
    return df.orderBy(
        *[
            F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last()
            for c in by
        ]
    )


def head_n(df: DataFrame, n: int, *by: str) -> DataFrame:
    return sort_multi(df, *by).limit(n)


def head_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return distinct_first(df, keys, order)


# -- reshape --------------------------------------------------------------------------------


def unpivot_columns(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], key: str, value: str
) -> DataFrame:
    """Wide to long, nulls kept."""
    return df.unpivot(list(ids), list(columns), key, value)


def unpivot_numbered(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], key: str, value: str
) -> DataFrame:
    """Wide to long with the key read from the column name (``replicate_2`` gives 2.0).

    The number is taken from each name once, not from every row.
    """
    def number(name: str) -> float | None:
        found = re.search(r"-?[0-9]+(\.[0-9]+)?", name)
        return float(found.group()) if found else None

    cells = [
        F.struct(F.lit(number(c)).cast("double").alias(key), F.col(f"`{c}`").alias(value))
        for c in columns
    ]
    return df.select(*ids, F.inline(F.array(*cells)))


def pivot_columns(
    df: DataFrame, ids: Sequence[str], key: str, values: Sequence[str], agg: Column
) -> DataFrame:
    return df.groupBy(*ids).pivot(key, list(values)).agg(agg)


def even_grid(df: DataFrame, low: str, high: str, n: int, out: str) -> DataFrame:
    """``n`` even steps from ``low`` to ``high``, one row each."""
    step = (F.col(high) - F.col(low)) / (n - 1)
    return df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(
        out, F.col(low) + F.col("_i") * step
    )


def map_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    walks: Mapping[str, tuple[str, Column]],
    totals: Mapping[str, Column],
    **kw,
) -> DataFrame:
    """Nest, work per group, unnest, without holding a group in one cell: walks and group totals."""
    walked = Ordered(df, keys, order, **kw).cumulative(walks)
    return with_group(walked, keys, totals)
