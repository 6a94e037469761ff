"""Sea-ice history and days of open water."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polynya.functions.geodesy import SEA_ICE
from polynya.operators.aggregates import mean_sd_n
from polynya.operators.joins import keyed_override
from polynya.operators.ordered import closest_to_target, next_rows_below
from polynya.operators.relational import in_box, in_season
from polynya.operators.spatial import nearest, nearest_projected

SIC_TARGETS = (0.1, 0.5, 0.8)


def open_water_days(
    history: DataFrame,
    targets: Sequence[float] = SIC_TARGETS,
    first_month: int | None = None,
    start: str | None = None,
    **kw,
) -> DataFrame:
    """Per station and target: the day ice fell below the target for the next three records.

    ``history`` has station, ice_date, sic and sampling_date. The walk runs once per station
    over the three targets side by side, so targets do not multiply the rows that are sorted.
    """
    season = history.filter(in_season(F.col("ice_date"), first_month, start))
    flagged = next_rows_below(
        season, ["station"], ["ice_date"], "sic", targets, "sic_target", **kw
    )
    best = closest_to_target(
        flagged, ["station", "sic_target"], "next_below", "sic", "sic_target", "ice_date"
    )
    return with_length(
        best.select(
            "station", "sic_target", "sampling_date",
            F.col("ice_date").alias("dow_date"), F.col("sic").alias("dow_sic"),
        )
    )


def with_length(dow: DataFrame) -> DataFrame:
    return dow.withColumn("dow_length", F.date_diff("sampling_date", "dow_date"))


def apply_corrections(dow: DataFrame, corrections: DataFrame, history: DataFrame) -> DataFrame:
    """Manual dates by (station, target); concentration comes from the history at that date."""
    return with_length(
        keyed_override(
            dow,
            corrections,
            ["station", "sic_target"],
            {"dow_date": "new_date"},
            series=history,
            series_on={"station": "station", "new_date": "ice_date"},
            take={"dow_sic": "sic"},
        )
    )


def days_open_water(
    history: DataFrame, corrections: DataFrame | None = None, **kw
) -> DataFrame:
    dow = open_water_days(history, **kw)
    if corrections is not None:
        dow = apply_corrections(dow, corrections, history)
    return dow.select(
        "station", "sic_target", "sampling_date", "dow_date", "dow_length", "dow_sic"
    )


# -- history from daily grids ---------------------------------------------------------------

# Scale of the stored concentration, area of interest.
SIC_SCALE = 0.00999999977648258
AREA = {"west": -65.0, "east": -50.0, "south": 65.0, "north": 72.0}


def sic_history(
    stations: DataFrame, cells: DataFrame, daily: DataFrame, scale: float = SIC_SCALE
) -> DataFrame:
    """Station × day concentration at the cell nearest to the station.

    ``stations`` has long_deg_w (positive west) and lat_deg_n; ``cells`` cell_id, lon, lat;
    ``daily`` cell_id, ice_date, sic. Cell places do not change from day to day, so the nearest
    cell is found once and the days follow by an equi-join.
    """
    area = cells.filter(in_box(F.col("lon"), F.col("lat"), **AREA))
    placed = stations.filter(F.col("lat_deg_n") >= 65).withColumns(
        {"lon": -F.col("long_deg_w"), "lat": F.col("lat_deg_n")}
    )
    found = nearest_projected(placed, area, SEA_ICE).drop("lon", "lat")
    return found.join(daily, "cell_id").withColumn("sic", F.col("sic") * F.lit(scale)).drop("cell_id")


def sic_point_history(
    points: DataFrame, cells: DataFrame, daily: DataFrame
) -> DataFrame:
    """All days of the cells nearest (in degrees) to fixed points; concentration as stored."""
    found = nearest(points, cells, ("lon", "lat"), ("lon", "lat"), "cell_id").drop("distance")
    return daily.join(found, "cell_id").withColumn("year", F.year("ice_date"))


def sic_daily_summary(history: DataFrame) -> DataFrame:
    """Mean ± standard deviation over stations per day, in percent, with the band edges."""
    out = mean_sd_n(history, ["ice_date"], F.col("sic") * 100)
    return out.select(
        "ice_date", F.col("mean").alias("mean_sic"), F.col("sd").alias("sd_sic"),
        (F.col("mean") - F.col("sd")).alias("low"), (F.col("mean") + F.col("sd")).alias("high"),
    )


def sampling_day_value(history: DataFrame) -> DataFrame:
    """Per station the row whose ice date is the sampling date."""
    return history.filter(F.col("sampling_date") == F.col("ice_date"))
