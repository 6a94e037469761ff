"""Bottle files: two text lines per bottle to one typed row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polynya.functions.scalars import parse_number
from polynya.sources.text import after_marker, cast_in_name, two_line_records

# The fields of a record by position; temp* are filler.
SENSORS = [
    "sva", "sigma_t", "density", "sigma_theta", "svcm", "prdm", "depsm", "t090c", "oxsat_ml_l",
    "flsp", "wet_cdom", "par", "spar", "cstar_tr0", "upoly0", "sbeox0_ml_l", "sal00",
]
FIELDS = (
    ["temp1", "bottle", "month", "day", "year"]
    + SENSORS
    + ["temp2", "temp3", "time"]
    + [f"temp{i}" for i in range(4, 17)]
)


def bottle_table(lines: DataFrame, keys: Sequence[str] = ("file_name",)) -> DataFrame:
    """Lines (file_name, pos, line) to bottles with sensors, UTC time and cast number."""
    body = after_marker(lines, keys, "Bottle", skip=1)
    records = two_line_records(body, keys, FIELDS).drop("record")
    day = F.try_to_date(F.concat_ws(" ", "year", "month", "day"), "yyyy MMM dd")
    stamp = F.concat(day.cast("string"), F.lit(" "), F.col("time")).try_cast("timestamp_ntz")
    return records.select(
        *keys,
        parse_number(F.col("bottle")).alias("bottle"),
        *[parse_number(F.col(c)).alias(c) for c in SENSORS],
        stamp.alias("date"),
        cast_in_name(F.col("file_name")).alias("cast"),
    )
