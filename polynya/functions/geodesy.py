"""Map projection and distance on the WGS84 ellipsoid, as column expressions.

Formulas: Snyder (1987) for the polar stereographic projection, Vincenty (1975) for distance.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

A = 6378137.0
FLATTENING = 1 / 298.257223563
B = A * (1 - FLATTENING)
E2 = 2 * FLATTENING - FLATTENING**2
E = math.sqrt(E2)


def _t(phi: float) -> float:
    s = E * math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (E / 2)


@dataclass(frozen=True)
class PolarStereographic:
    """North polar stereographic, true scale at ``lat_ts``, ``lon_0`` pointing down."""

    lat_ts: float
    lon_0: float

    @property
    def scale(self) -> float:
        """Metres per unit of t."""
        phi = math.radians(self.lat_ts)
        m = math.cos(phi) / math.sqrt(1 - E2 * math.sin(phi) ** 2)
        return A * m / _t(phi)

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Degrees to metres."""
        phi, lam = F.radians(lat), F.radians(lon - F.lit(self.lon_0))
        s = F.lit(E) * F.sin(phi)
        t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(E / 2))
        rho = F.lit(self.scale) * t
        return rho * F.sin(lam), -rho * F.cos(lam)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Metres to degrees (lon, lat); the latitude series is good to below a millimetre."""
        chi = F.lit(math.pi / 2) - 2 * F.atan(F.sqrt(x * x + y * y) / F.lit(self.scale))
        lat = chi
        for k, c in enumerate(LATITUDE_SERIES, start=1):
            lat = lat + F.lit(c) * F.sin(chi * (2 * k))
        lon = F.lit(self.lon_0) + F.degrees(F.atan2(x, -y))
        return lon, F.degrees(lat)


# Series coefficients from conformal to geodetic latitude.
LATITUDE_SERIES = (
    E2 / 2 + 5 * E2**2 / 24 + E2**3 / 12 + 13 * E2**4 / 360,
    7 * E2**2 / 48 + 29 * E2**3 / 240 + 811 * E2**4 / 11520,
    7 * E2**3 / 120 + 81 * E2**4 / 1120,
    4279 * E2**4 / 161280,
)

SEA_ICE = PolarStereographic(70.0, -45.0)
CAMERA = PolarStereographic(60.0, -80.0)


def given(values: dict[str, Column], f: Callable[[Column], Column]) -> Column:
    """``f`` of named values, each worked out once however often ``f`` uses it.

    They pass through a one-element array; an expression written out in every place that uses it
    is worked out in each of them, and such places multiply from step to step.
    """
    held = F.struct(*[v.alias(n) for n, v in values.items()])
    return F.element_at(F.transform(F.array(held), f), 1)


def geodesic_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, steps: int = 20) -> Column:
    """Ellipsoidal distance in metres; 0 for equal points. A fixed number of iterations."""
    f = FLATTENING

    def sphere(q: Column, lam: Column, then: Callable[[Column], Column]) -> Column:
        """``then`` of the triangle on the sphere at longitude difference ``lam``."""

        def sides(t: Column) -> Column:
            a, b = q["cu2"] * t["sl"], q["cu1"] * q["su2"] - q["su1"] * q["cu2"] * t["cl"]
            return given({
                "sin_sigma": F.sqrt(a * a + b * b),
                "cos_sigma": q["su1"] * q["su2"] + q["cu1"] * q["cu2"] * t["cl"],
                "over": q["cu1"] * q["cu2"] * t["sl"],
            }, azimuth)

        def azimuth(t: Column) -> Column:
            sin_alpha = F.coalesce(F.try_divide(t["over"], t["sin_sigma"]), F.lit(0.0))
            return given({"sin_alpha": sin_alpha, "sin_sigma": t["sin_sigma"], "cos_sigma": t["cos_sigma"]}, middle)

        def middle(t: Column) -> Column:
            cos2 = 1 - t["sin_alpha"] * t["sin_alpha"]
            return given({
                "sin_sigma": t["sin_sigma"], "cos_sigma": t["cos_sigma"], "sin_alpha": t["sin_alpha"], "cos2": cos2,
                "sigma": F.atan2(t["sin_sigma"], t["cos_sigma"]),
                "mid": F.coalesce(t["cos_sigma"] - F.try_divide(2 * q["su1"] * q["su2"], cos2), F.lit(0.0)),
            }, then)

        return given({"sl": F.sin(lam), "cl": F.cos(lam)}, sides)

    def between(q: Column) -> Column:
        def step(lam: Column, _i: Column) -> Column:
            def moved(p: Column) -> Column:
                c = f / 16 * p["cos2"] * (4 + f * (4 - 3 * p["cos2"]))
                inner = p["mid"] + c * p["cos_sigma"] * (2 * p["mid"] * p["mid"] - 1)
                return q["l"] + (1 - c) * f * p["sin_alpha"] * (p["sigma"] + c * p["sin_sigma"] * inner)

            return sphere(q, lam, moved)

        def distance(p: Column) -> Column:
            u = p["cos2"] * ((A * A - B * B) / (B * B))
            aa = 1 + u / 16384 * (4096 + u * (u * (320 - 175 * u) - 768))
            bb = u / 1024 * (256 + u * (u * (74 - 47 * u) - 128))
            m2 = p["mid"] * p["mid"]
            s2 = p["sin_sigma"] * p["sin_sigma"]
            third = bb / 6 * p["mid"] * (4 * s2 - 3) * (4 * m2 - 3)
            delta = bb * p["sin_sigma"] * (p["mid"] + bb / 4 * (p["cos_sigma"] * (2 * m2 - 1) - third))
            return F.lit(B) * aa * (p["sigma"] - delta)

        lam = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), q["l"], step)
        return sphere(q, lam, distance)

    def angles(u: Column) -> Column:
        return given({
            "su1": F.sin(u["u1"]), "cu1": F.cos(u["u1"]), "su2": F.sin(u["u2"]), "cu2": F.cos(u["u2"]), "l": u["l"],
        }, between)

    return given({
        "u1": F.atan((1 - f) * F.tan(F.radians(lat1))), "u2": F.atan((1 - f) * F.tan(F.radians(lat2))),
        "l": F.radians(lon2 - lon1),
    }, angles)
