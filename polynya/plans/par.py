"""Photosynthetically available radiation: spectra to one value per depth, then attenuation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polynya.functions.scalars import safe_log
from polynya.operators.fitting import nls_decay
from polynya.operators.scale import durable
from polynya.operators.spline import spline_resample
from polynya.operators.statistics import lm, trapezoid

# Grid in nm and the conversion of the integral.
GRID = (400.0, 700.0, 1.0)
PAR_FACTOR = 0.045998 / 10000


def par_by_depth(irradiance: DataFrame, **kw) -> DataFrame:
    """(file, depth, wavelength, irradiance) to (file, depth, par).

    A spectrum has as many knots as its instrument has channels, resampled the 301 points of the
    grid; the result is one row per depth and feeds several fits, so it is written once.
    """
    fine = spline_resample(irradiance, ["file", "depth"], "wavelength", "irradiance", *GRID, small=True, **kw)
    return durable(trapezoid(fine, ["file", "depth"], "wavelength", "irradiance", "par", PAR_FACTOR, small=True))


def attenuation(par: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exponential decay and log-linear fits per file."""
    return (
        nls_decay(par, ["file"], "depth", "par"),
        lm(par, ["file"], F.col("depth"), safe_log(F.col("par"))),
    )
