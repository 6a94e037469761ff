"""Scalar column expressions: text, numbers, dates, guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"-?[0-9]+(\.[0-9]+)?"


def regex_or_null(text: Column, pattern: str, group: int = 0) -> Column:
    """Captured text, null when the pattern does not match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def known(x: Column) -> Column:
    """Neither null nor NaN; models leave other rows out."""
    return x.isNotNull() & ~F.isnan(x.cast("double"))


def parse_number(text: Column) -> Column:
    """First number in a text, grouping commas removed; null if there is none."""
    plain = F.regexp_replace(text, r"(?<=[0-9]),(?=[0-9])", "")
    return regex_or_null(plain, NUMBER, 0).try_cast("double")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")


def to_ascii(text: Column) -> Column:
    """Accented Latin letters to their base letters."""
    return F.translate(
        text, "àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ",
        "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY",
    )


def year_day(day: Column) -> Column:
    """Date to year and day of year, as in 2015123."""
    return F.date_format(day, "yyyyDDD")


def from_year_day(text: Column) -> Column:
    return F.try_to_date(text, "yyyyDDD")


def from_epoch_days(days: Column, epoch: str) -> Column:
    return F.date_add(F.to_date(F.lit(epoch)), days.cast("int"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def safe_log(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def signif(x: Column, digits: int) -> Column:
    """Significant digits."""
    power = F.pow(F.lit(10.0), F.lit(digits - 1.0) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x * power) / power)


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)
