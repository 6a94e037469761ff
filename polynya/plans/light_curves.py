"""Radiotracer counts to production, light-response curves, normalised parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polynya.operators.aggregates import value_at_max
from polynya.operators.fitting import pe_photoinhibition, pe_saturating
from polynya.operators.gaps import fill_down_up, fill_group_max
from polynya.operators.joins import inner_keys, left_lookup, without_partner
from polynya.operators.relational import round_numeric
from polynya.operators.scale import null_safe_join

SAMPLE, STANDARD, BLANK = "(?i)^p", "(?i)tc|t0", "(?i)black|dark"


def curve_references(
    df: DataFrame, keys: Sequence[str], standard: str = STANDARD, blank: str = BLANK
) -> DataFrame:
    """Mean counts of the standard and of the blank per curve."""
    dpm = F.col("dpm")
    return df.groupBy(*keys).agg(
        F.avg(F.when(F.col("id").rlike(standard), dpm)).alias("standard"),
        F.avg(F.when(F.col("id").rlike(blank), dpm)).alias("blank"),
    )


# -- carbon from salinity -------------------------------------------------------------------

# Fixed values of the three rules (µg per litre).
DIC_HIGH, DIC_LOW, DIC_SALINITY = 25900.0, 24000.0, 30.0


def salinity_to_dic(salinity: Column, rule: str = "step") -> Column:
    """``linear``, ``step`` or ``constant`` rule for dissolved carbon."""
    if rule == "linear":
        return (salinity * F.lit(0.067) - F.lit(0.05)) * F.lit(0.96) * 12000
    if rule == "step":
        return F.when(salinity.isNull(), F.lit(None)).when(salinity >= DIC_SALINITY, DIC_HIGH).otherwise(DIC_LOW)
    if rule == "constant":
        return F.lit(DIC_HIGH)
    raise ValueError(f"unknown rule {rule}")


# -- counts to production -------------------------------------------------------------------


def dpm_to_production(
    df: DataFrame,
    keys: Sequence[str],
    minutes: Column,
    incubation_ml: float = 50.0,
    pipette_ml: float = 0.02,
    rule: str = "step",
    standard: str = STANDARD,
    blank: str = BLANK,
) -> DataFrame:
    """Sample rows with blank-corrected counts and production per hour."""
    refs = curve_references(df, keys, standard, blank)
    samples = null_safe_join(df.filter(F.col("id").rlike(SAMPLE)), refs, keys)
    net = F.col("dpm") - F.col("blank")
    per_hour = F.col("standard") * minutes / 60
    p = F.try_divide(salinity_to_dic(F.col("salinity"), rule) * net, per_hour) / F.lit(
        incubation_ml / pipette_ml
    )
    return samples.withColumns({"p": p, "dpm": net}).drop("standard", "blank")


def model_choice(df: DataFrame, keys: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Per curve: inhibited (model1) when production at the strongest light is below its maximum."""
    peaks = value_at_max(df, keys, "light", "p", ties)
    below = F.col("p_at_max_light") < F.col("max_p")
    label = F.when(below.isNull(), F.lit(None)).when(below, "model1").otherwise("model2")
    return peaks.select(*keys, label.alias("model_type"))


# -- parameters -----------------------------------------------------------------------------


def fit_curves(df: DataFrame, keys: Sequence[str], ps_max: float | None = None, **kw) -> DataFrame:
    """Fit every curve with the model its ``model_type`` names; one row per curve."""
    one = pe_photoinhibition(df.filter("model_type = 'model1'"), keys, ps_max=ps_max, **kw)
    two = pe_saturating(df.filter("model_type = 'model2'"), keys, **kw)
    tag = lambda fit, name: fit.withColumn("model_type", F.lit(name))
    return tag(one, "model1").unionByName(tag(two, "model2"))


def metrics(params: DataFrame, chla: str | None = None) -> DataFrame:
    """Derived parameters of the fitted curves.

    The pseudo-R² divides by n times the sample variance. A curve without inhibition has no
    ``beta``; what depends on it is null. ``chla`` adds the normalised parameters.
    """
    ps, a, b = F.col("ps"), F.col("alpha"), F.col("beta")
    share = lambda v: F.try_divide(v, a + b)
    pm = ps * share(a) * F.pow(share(b), F.try_divide(b, a))
    ratio = F.try_divide(a + b, b)
    out = {
        "pm": pm,
        "ek": F.try_divide(pm, a),
        "im": F.try_divide(ps, a) * F.when(ratio > 0, F.log(ratio)),
        "ib": F.try_divide(ps, b),
        "r2": 1 - F.try_divide(F.col("rss"), F.col("n") * F.try_divide(F.col("tss"), F.col("n") - 1)),
    }
    if chla:
        out |= {
            "alpha_b": F.try_divide(a, F.col(chla)),
            "beta_b": F.try_divide(b, F.col(chla)),
            "pb_max": F.try_divide(pm, F.col(chla)),
        }
    return params.withColumns(out)


def normalised(
    params: DataFrame, pigments: DataFrame, keys: Sequence[str], chla: str = "tchla", digits: int = 2
) -> DataFrame:
    """Join pigments and divide α, β and pm by chlorophyll; every number rounded half to even."""
    joined = params.join(pigments, list(keys), "left")
    star = {f"{c}_star": F.try_divide(F.col(c), F.col(chla)) for c in ("alpha", "beta", "pm")}
    return round_numeric(joined.withColumns(star), digits)


def assemble_samples(
    sheets: DataFrame, bottles: DataFrame, pigments: DataFrame, order: Sequence[str], **kw
) -> tuple[DataFrame, DataFrame]:
    """Sheet rows to samples with bottle depth and pigment; also the rows without a bottle.

    Cast and bottle are carried within a curve, then the cast within a station; a bottle still
    missing takes the station's largest. Ice samples are left out at the end.
    """
    within = fill_down_up(sheets, ["station", "curve_id"], order, ["cast", "bottle"], **kw)
    station = fill_down_up(within, ["station"], order, ["cast"], **kw)
    filled = fill_group_max(station, ["station"], "bottle")
    orphans = without_partner(filled, bottles, ["cast", "bottle"])
    sampled = left_lookup(filled, bottles, ["cast", "bottle"])
    water = sampled.filter(~F.col("curve_id").contains("ice"))
    return inner_keys(water, pigments, ["station", "bottle"]), orphans
