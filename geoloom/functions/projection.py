"""Albers equal-area conic projection on the ellipsoid (Snyder, Map Projections: A Working Manual, 1987), as columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Albers:
    """Defaults: Africa Albers Equal Area Conic on WGS84 (fixed values of the public registry)."""

    lat1: float = 20.0
    lat2: float = -23.0
    lat0: float = 0.0
    lon0: float = 25.0
    a: float = 6378137.0
    inverse_flattening: float = 298.257223563

    @property
    def e2(self) -> float:
        f = 1 / self.inverse_flattening
        return f * (2 - f)

    def _q(self, sin: float) -> float:
        e = math.sqrt(self.e2)
        return (1 - self.e2) * (sin / (1 - self.e2 * sin * sin) - math.log((1 - e * sin) / (1 + e * sin)) / (2 * e))

    @property
    def constants(self) -> tuple[float, float, float]:
        """n, C and rho0."""
        s1, s2 = math.sin(math.radians(self.lat1)), math.sin(math.radians(self.lat2))
        m1, m2 = (math.cos(math.radians(p)) / math.sqrt(1 - self.e2 * s * s) for p, s in ((self.lat1, s1), (self.lat2, s2)))
        q0, q1, q2 = self._q(math.sin(math.radians(self.lat0))), self._q(s1), self._q(s2)
        n = (m1 * m1 - m2 * m2) / (q2 - q1)
        c = m1 * m1 + n * q1
        return n, c, self.a * math.sqrt(c - n * q0) / n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """x, y in metres from degrees."""
        n, c, rho0 = self.constants
        e = math.sqrt(self.e2)
        s = F.sin(F.radians(lat))
        q = (1 - self.e2) * (s / (1 - self.e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
        rho = self.a * F.sqrt(c - n * q) / n
        theta = n * F.radians(lon - self.lon0)
        return rho * F.sin(theta), rho0 - rho * F.cos(theta)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Degrees from metres, by the series in the authalic latitude."""
        n, c, rho0 = self.constants
        e2 = self.e2
        rho = F.sqrt(x * x + (rho0 - y) * (rho0 - y))
        sign = 1.0 if n > 0 else -1.0
        theta = F.atan2(x * sign, (rho0 - y) * sign)
        q = (c - rho * rho * n * n / (self.a * self.a)) / n
        beta = F.asin(F.greatest(F.least(q / self._q(1.0), F.lit(1.0)), F.lit(-1.0)))
        lat = (
            beta
            + (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) * F.sin(2 * beta)
            + (23 * e2**2 / 360 + 251 * e2**3 / 3780) * F.sin(4 * beta)
            + (761 * e2**3 / 45360) * F.sin(6 * beta)
        )
        return F.degrees(theta / n) + self.lon0, F.degrees(lat)
