"""Wind and cloud fields at stations and cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polynya.functions.geodesy import PolarStereographic
from polynya.operators.joins import blocked_join
from polynya.operators.spatial import cell_extract, polygon_mask, reproject
from polynya.sources.grids import bands_to_long, crop_arrays, grid_to_cells
from polynya.sources.text import date_in_name


def wind_speed(
    stations: DataFrame, u: DataFrame, w: DataFrame, bands: Sequence[str], keys: Sequence[str],
    west: float, south: float, dx: float, dy: float,
) -> DataFrame:
    """Station × time wind: cell values of both components, long form, joined, speed.

    ``u`` and ``w`` are regular grids (ix, iy, one column per time).
    """
    def component(grid: DataFrame, name: str) -> DataFrame:
        at = cell_extract(stations, grid, "lon", "lat", west, south, dx, dy)
        return bands_to_long(at.select(*keys, *[f"`{b}`" for b in bands]), keys, bands, "wind_date", name)

    both = component(u, "uwnd").join(component(w, "vwnd"), [*keys, "wind_date"])
    return both.withColumn("speed", F.sqrt(F.col("uwnd") * F.col("uwnd") + F.col("vwnd") * F.col("vwnd")))


def wind_from_arrays(
    stations: DataFrame, records: DataFrame, time: str, box: tuple[float, float, float, float], dx: float, dy: float,
    digits: int | None = None,
) -> DataFrame:
    """Station × time wind from raw array records (time, lon, lat, uwnd, vwnd), one per time.

    Grids are cut to ``box`` (west, east, south, north); a station takes the cell that contains it,
    cells being ``dx`` by ``dy`` around their positions. Stations outside the box have no wind.
    The speed, rounded to ``digits`` if given, is worked out once per cell and time, not per station.
    """
    west, _, south, _ = box
    cut = crop_arrays(records, "lon", "lat", ["uwnd", "vwnd"], *box)
    cells = grid_to_cells(cut, [time], "lon", "lat", {"uwnd": "uwnd", "vwnd": "vwnd"})
    turned = lambda lon: F.pmod(lon - F.lit(west) + F.lit(dx / 2), F.lit(360.0))
    place = lambda lon, lat: {
        "_ix": F.floor(turned(F.col(lon)) / F.lit(dx)), "_iy": F.floor((F.col(lat) - F.lit(south)) / F.lit(dy) + 0.5)
    }
    speed = F.sqrt(F.col("uwnd") * F.col("uwnd") + F.col("vwnd") * F.col("vwnd"))
    at = cells.withColumns({**place("lon", "lat"), "speed": speed if digits is None else F.round(speed, digits)})
    at = at.drop("lon", "lat", "cell_id")
    # Few cells hold all stations, and each cell has a row per time.
    return blocked_join(stations.withColumns(place("lon", "lat")), at, ["_ix", "_iy"]).drop("_ix", "_iy")


def grid_map(
    grid: DataFrame, edges: DataFrame, projection: PolarStereographic, resolution: float, origin: tuple[float, float],
    step: tuple[float, float], limits: tuple[float | None, float | None] = (None, None), by: Sequence[str] = (),
) -> DataFrame:
    """Map layer: cells cut to the land's extent, land masked out (holes stay), then projected.

    ``grid`` has cell_id, ix, iy, lon, lat, value and the columns ``by``.
    """
    sea = polygon_mask(grid, "cell_id", "lon", "lat", edges)
    return reproject(sea, projection, resolution, *origin, *step, *limits, by=by)


def cloud_daily(files: DataFrame, thickness: str, fraction: str) -> DataFrame:
    """Cloud thickness and fraction per cell and day from array records (name, lon, lat, layers)."""
    cells = grid_to_cells(files, ["name"], "lon", "lat", {"cot": thickness, "cf": fraction})
    return cells.select("lon", "lat", date_in_name(F.col("name")).alias("day"), "cot", "cf")
