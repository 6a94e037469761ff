"""Gridded arrays to cell tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wrap_longitude(lon: Column) -> Column:
    return F.when(lon > 180, lon - 360).otherwise(lon)


def grid_to_cells(
    df: DataFrame,
    keep: Sequence[str | Column],
    lon: str,
    lat: str,
    values: str | Mapping[str, str],
    scale: float = 1.0,
) -> DataFrame:
    """Array record to one row per cell, longitude varying fastest.

    Adds ``cell_id`` (place in the flattened array), ``lon`` (wrapped to ±180), ``lat`` and
    ``value``. ``values`` may name several layers of one record (output column to array column);
    a layer that is shorter than the longest gives null.
    """
    layers = {"value": values} if isinstance(values, str) else dict(values)
    inputs = [F.col(c).alias(f"_v{i}") for i, c in enumerate(layers.values())]
    records = df.select(*keep, F.col(lon).alias("_lon"), F.col(lat).alias("_lat"), *inputs)
    cells = records.select(
        "*", F.posexplode(F.arrays_zip(*[f"_v{i}" for i in range(len(layers))])).alias("cell_id", "_v")
    )
    nx = F.size("_lon")
    return cells.select(
        *records.columns[: len(keep)],
        "cell_id",
        wrap_longitude(F.get("_lon", (F.col("cell_id") % nx).cast("int"))).alias("lon"),
        F.get("_lat", F.floor(F.col("cell_id") / nx).cast("int")).alias("lat"),
        *[
            (F.col("_v")[f"_v{i}"].cast("double") * F.lit(scale)).alias(name)
            for i, name in enumerate(layers)
        ],
    )


def crop_arrays(
    df: DataFrame, lon: str, lat: str, layers: Sequence[str], west: float, east: float, south: float, north: float
) -> DataFrame:
    """Array records cut to a box (closed edges), columns from west to east.

    Longitudes may run from 0 to 360 or from −180 to 180. The axis is turned so that it starts at
    ``west``: a box over the seam, also one with ``west`` above ``east``, is one range of columns,
    and longitudes come out rising from ``west``. A record outside the box keeps empty arrays.
    """
    nx = F.size(lon)
    along = F.transform(lon, lambda x, i: F.struct(F.pmod(x - F.lit(west), F.lit(360.0)).alias("d"), i.alias("i")))
    span = (east - west) % 360.0
    cols = F.array_sort(F.filter(along, lambda c: c["d"] <= span))
    rows = F.filter(F.transform(lat, lambda y, i: F.struct(y.alias("y"), i.alias("i"))), lambda r: r["y"].between(south, north))
    placed = df.withColumns({"_cols": cols, "_rows": rows, "_nx": nx})
    pick = lambda layer: F.flatten(
        F.transform("_rows", lambda r: F.transform("_cols", lambda c: F.get(layer, (r["i"] * F.col("_nx") + c["i"]).cast("int"))))
    )
    cut = {layer: pick(layer) for layer in layers}
    cut[lon] = F.transform("_cols", lambda c: F.lit(west) + c["d"])
    cut[lat] = F.transform("_rows", lambda r: r["y"])
    return placed.withColumns(cut).drop("_cols", "_rows", "_nx")


def bands_to_long(
    df: DataFrame, ids: Sequence[str], bands: Sequence[str], time: str, value: str
) -> DataFrame:
    """One column per time (``X2016.05.01.06.00.00``) to rows (ids, time, value)."""
    long = df.unpivot(list(ids), [f"`{b}`" for b in bands], "_band", value)
    stamp = F.to_timestamp_ntz(F.substring("_band", 2, 19), F.lit("yyyy.MM.dd.HH.mm.ss"))
    return long.select(*ids, stamp.alias(time), value)


def bind_by_position(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach columns that belong together by place; the place travels as a key."""
    return left.join(right, list(keys))
