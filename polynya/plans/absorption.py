"""Dissolved-matter absorption spectra: from readings to corrected, flagged spectra."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polynya.functions.scalars import parse_number, regex_or_null
from polynya.operators.aggregates import any_known, strict_median
from polynya.operators.joins import reference_rows
from polynya.operators.relational import unpivot_numbered
from polynya.operators.scale import durable, null_safe_join, with_group
from polynya.sources.text import name_layout

# Path factor, baseline band, band of the quality rules and their limits.
PATH_FACTOR = 2.303 / 2
BASELINE = (683, 687)
QUALITY_BAND = (350, 500)
R_LOW, R_HIGH = 2.303 * 0.005 / 2, 2.303 * 0.01 / 2
SHIP_FIELDS = ("mission", "station", "cast", "bottle", "depth", "sample_type")
CAMP_FIELDS = (
    "mission", "year", "jday", "water_type", "snow_type", "from_depth", "to_depth", "sample_type",
)
DILUTION_KEYS = ("jday", "snow_type", "from_depth", "to_depth")


def absorption_long(readings: DataFrame, file: str, replicates: Sequence[str]) -> DataFrame:
    """Wide readings (file, wavelength, replicate_1…n of absorbance) to long absorption."""
    keys = name_layout(F.col(file), "AM", list(SHIP_FIELDS), list(CAMP_FIELDS))
    named = readings.withColumns(keys)
    ids = [c for c in named.columns if c not in replicates]
    long = unpivot_numbered(named, ids, replicates, "replicate", "absorbance")
    return long.filter(F.col("sample_type").isin("r", "s")).select(
        *ids,
        F.col("replicate").cast("int").alias("replicate"),
        (2.303 * F.col("absorbance") / 2).alias("absorption"),
    )


def replicate_means(spectra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per wavelength: mean of reference (r) and sample (s), and the sample's |CV| in percent.

    One aggregation gives what the correction and the replicate rule need.
    """
    of = lambda kind: F.when(F.col("sample_type") == kind, F.col("absorption"))
    stats = spectra.groupBy(*keys, "wavelength").agg(
        F.avg(of("r")).alias("r"), F.avg(of("s")).alias("s"), F.stddev_samp(of("s")).alias("_sd")
    )
    cv = F.abs(F.try_divide(F.col("_sd") * 100, F.col("s")))
    return stats.withColumn("cv_absorption", cv).drop("_sd")


def subtract_reference(means: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sample minus reference, minus the median of the baseline band of the spectrum."""
    raw = means.withColumn("absorption", F.col("s") - F.col("r"))
    band = F.col("wavelength").between(*BASELINE)
    joined = with_group(raw, keys, {"_base": strict_median(F.col("absorption"), band)})
    return joined.withColumn("absorption", F.col("absorption") - F.col("_base")).drop("_base")


def corrected(spectra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Corrected spectra with the means they come from."""
    return subtract_reference(replicate_means(spectra, keys), keys).drop("cv_absorption")


def dilution_table(df: DataFrame) -> DataFrame:
    """Sample volumes with the keys found in the cast label, and the undiluted share ``f``."""
    cast = F.col("cast")
    depth = F.when(regex_or_null(cast, r"\d(\d*)cm", 1) == "3", "003cm").otherwise("010cm")
    total = F.col("total_volumn_ml")
    return df.select(
        "cast",
        F.col("jday").cast("string").alias("jday"),
        regex_or_null(cast, "HS|LS|xx", 0).alias("snow_type"),
        regex_or_null(cast, r"(\d)\d*cm", 1).alias("from_depth"),
        F.when(cast.rlike(r"\d(\d*)cm"), depth).alias("to_depth"),
        F.try_divide(total - F.col("added_fsw_ml"), total).alias("f"),
    )


def undiluted(df: DataFrame, group: str = "jday", depth: str = "to_depth", record: str | None = None) -> DataFrame:
    """Remove the part of the added water: its spectrum is the day's shallowest undiluted sample.

    Rows without a reference or without a share ``f`` keep their value. ``record`` names a
    column that is null where there is no dilution record at all; without it a null ``f`` says so.
    Depths such as ``30cm`` are compared by their number.
    """
    df = df.withColumn("_depth", parse_number(F.col(depth).cast("string")))
    joined = reference_rows(
        df, group, "_depth", F.col(record or "f").isNull(), ["wavelength"], {"a_ref": "absorption"}
    )
    own, f = F.col("absorption"), F.col("f")
    fixed = F.try_divide(own - F.col("a_ref") * (1 - f), f)
    return joined.withColumn("absorption", F.coalesce(fixed, own)).drop("_depth")


def quality_flags(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flag per spectrum from columns wavelength, r, absorption, cv_absorption.

    Later rules win; an unknown condition makes the flag unknown, except for the replicate rule.
    One aggregate per spectrum; its median sees the wavelengths of one band of one instrument.
    """
    band = F.col("wavelength").between(*QUALITY_BAND)
    facts = df.groupBy(*keys).agg(
        strict_median(F.abs("r"), band).alias("_noise"),
        any_known(F.col("cv_absorption") > 5, band).alias("_spread"),
        any_known(F.col("absorption") < 0, band).alias("_negative"),
        F.max(F.when(F.col("wavelength") == 350, F.col("absorption"))).alias("_a350"),
    )

    def rule(flag: Column, condition: Column, value: int) -> Column:
        return F.when(condition.isNull(), F.lit(None)).when(condition, value).otherwise(flag)

    flag = F.coalesce(F.when(F.col("_spread"), 7), F.lit(0))
    flag = rule(flag, F.col("_noise").between(R_LOW, R_HIGH), 1)
    flag = rule(flag, F.col("_noise") > R_HIGH, 8)
    flag = rule(flag, F.col("_a350") > F.lit(1.8), 6)
    flag = rule(flag, F.col("_negative"), 9)
    return facts.select(*keys, flag.alias("qf"))


def flagged(spectra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Corrected spectra of the ship with their quality flag.

    The means are far smaller than the readings and feed several steps, so they are written
    once and the readings are scanned once.
    """
    means = durable(replicate_means(spectra, keys))
    cdom = subtract_reference(means, keys)
    flags = quality_flags(cdom, keys)
    return null_safe_join(cdom, flags, keys).select(*keys, "wavelength", "absorption", "qf")


def flagged_camp(spectra: DataFrame, dilution: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Corrected spectra of the ice camp, freed of the added water, with their quality flag.

    ``keys`` name a spectrum and hold day, snow type and depths, on which the records of
    ``dilution`` (a ``dilution_table``) are found. Flags look at the spectrum after dilution.
    """
    means = durable(replicate_means(spectra, keys))
    records = dilution.select(*DILUTION_KEYS, "cast", "f")
    cdom = null_safe_join(subtract_reference(means, keys), records, DILUTION_KEYS, "left")
    fixed = undiluted(cdom, record="cast").select(
        *keys, "wavelength", "r", "cv_absorption", "absorption"
    ).distinct()
    flags = quality_flags(fixed, keys)
    return null_safe_join(fixed, flags, keys).select(*keys, "wavelength", "absorption", "qf")
