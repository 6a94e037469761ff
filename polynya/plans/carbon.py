"""Dissolved inorganic carbon in place and modelled from salinity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polynya.operators.gaps import complete_grid, fill_from_below, nans_to_null
from polynya.operators.joins import natural_join
from polynya.operators.relational import unpivot_numbered
from polynya.operators.statistics import lm, lm_predict, residual_compare

# Density used without a profile, and the high-salinity subset.
FIXED_DENSITY = 1027.0
HIGH_DIC, HIGH_SALINITY = 25600.0, 32.3


def ctd_profile(casts: DataFrame) -> DataFrame:
    """Casts (date, depth, sigt, psal) to one profile per day with 0.5 and 1.5 m present.

    Casts of a day are averaged to one row a level; a gap takes the value of the next deeper level.
    """
    mean = nans_to_null(casts).groupBy("date", "depth").agg(
        F.avg("sigt").alias("sigt"), F.avg("psal").alias("psal"), F.count(F.lit(1)).alias("n")
    )
    full = mean.withColumns(
        {"water_density": F.col("sigt") + 1000, "doy": F.dayofyear("date")}
    )
    grid = complete_grid(full, "date", "depth", [0.5, 1.5])
    return fill_from_below(grid, ["date"], ["depth"], ["sigt", "psal", "water_density", "doy"], small=True)


def dic_long(sheet: DataFrame, depths: Sequence[str]) -> DataFrame:
    """Wide sheet (date, one column per depth) to (date, depth, dic); surface counts as 0.5 m."""
    long = unpivot_numbered(sheet, ["date"], depths, "depth", "dic").filter(F.col("dic").isNotNull())
    depth = F.col("depth")
    return nans_to_null(long.withColumn("depth", F.when(depth == 0, F.lit(0.5)).otherwise(depth)))


def dic_insitu(dic: DataFrame, ctd: DataFrame) -> DataFrame:
    """µmol per kg to µg per litre with the density of the profile (next deeper one if missing)."""
    joined = natural_join(dic, ctd, "left")
    filled = fill_from_below(joined, ["date"], ["depth"], ["water_density"], small=True)
    return filled.withColumn("dic", F.col("dic") * F.col("water_density") / 1e6 * 12 * 1000)


def dic_fixed(dic: DataFrame, density: float = FIXED_DENSITY) -> DataFrame:
    return dic.withColumn("dic", F.col("dic") * F.lit(density) / 1e6 * 12 * 1000)


def compare_models(insitu: DataFrame, ctd: DataFrame) -> DataFrame:
    """|in place − model| for the two regressions and the step rule, one row per method."""
    x, y = F.col("psal"), F.col("dic")
    high = insitu.filter((y >= HIGH_DIC) & (x >= HIGH_SALINITY))
    models = lm_predict(ctd, lm(insitu, [], x, y), "psal", "all_salinity")
    models = lm_predict(models, lm(high, [], x, y), "psal", "high_salinity")
    step = F.when(F.col("psal").isNull(), F.lit(None)).when(F.col("psal") >= 30, 25900.0).otherwise(24000.0)
    seen = insitu.select("date", "depth", F.col("dic").alias("dic_insitu"))
    joined = natural_join(models.withColumn("step", step), seen, "left")
    return residual_compare(
        joined, ["date", "depth"], "dic_insitu",
        {"all": "all_salinity", "high": "high_salinity", "rule": "step"},
    )
