"""Map projections in closed form, as column expressions: geographic, spherical Mercator and transverse Mercator systems."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

GEOGRAPHIC, MERCATOR = "EPSG:4326", "EPSG:3857"
RADIUS = 6378137.0
# Inverse flattenings of WGS 84 and GRS 80.
WGS84, GRS80 = 298.257223563, 298.257222101


@dataclass(frozen=True)
class TransverseMercator:
    """An ellipsoidal transverse Mercator system by Krüger's series, to the fourth power of the third flattening (well under a millimetre)."""

    lon0: float
    lat0: float = 0.0
    scale: float = 0.9996
    east: float = 500_000.0
    north: float = 0.0
    flattening: float = WGS84

    @property
    def _n(self) -> float:
        f = 1 / self.flattening
        return f / (2 - f)

    @property
    def _rectifying(self) -> float:
        n = self._n
        return self.scale * RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    # Coefficients of the series.
    @property
    def _alpha(self) -> tuple[float, ...]:
        n = self._n
        return (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)

    @property
    def _beta(self) -> tuple[float, ...]:
        n = self._n
        return (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)

    @property
    def _delta(self) -> tuple[float, ...]:
        n = self._n
        return (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)

    @property
    def _origin(self) -> float:
        """Northing of the origin's latitude on the central meridian."""
        q = 2 * math.sqrt(self._n) / (1 + self._n)
        s = math.sin(math.radians(self.lat0))
        xi = math.atan(math.sinh(math.atanh(s) - q * math.atanh(q * s)))
        return self._rectifying * (xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(self._alpha, 1)))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        q = 2 * math.sqrt(self._n) / (1 + self._n)
        s, away = F.sin(F.radians(lat)), F.radians(lon - self.lon0)
        t = F.sinh(F.atanh(s) - q * F.atanh(q * s))
        xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
        x, y = eta, xi
        for j, a in enumerate(self._alpha, 1):
            x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return self.east + self._rectifying * x, self.north + self._rectifying * y - self._origin

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        xi, eta = (y - self.north + self._origin) / self._rectifying, (x - self.east) / self._rectifying
        a, b = xi, eta
        for j, c in enumerate(self._beta, 1):
            a = a - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            b = b - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        chi = F.asin(F.sin(a) / F.cosh(b))
        lat = chi
        for j, d in enumerate(self._delta, 1):
            lat = lat + d * F.sin(2 * j * chi)
        return self.lon0 + F.degrees(F.atan2(F.sinh(b), F.cos(a))), F.degrees(lat)


def system(crs: str) -> TransverseMercator | None:
    """The transverse Mercator system of a code; none for the other two; an error for what has no closed form here."""
    if crs in (GEOGRAPHIC, MERCATOR):
        return None
    code = int(crs.split(":")[1]) if crs.startswith("EPSG:") and crs[5:].isdigit() else 0
    if 32601 <= code <= 32660 or 32701 <= code <= 32760:
        return TransverseMercator(6.0 * (code % 100) - 183, north=0.0 if code < 32700 else 10_000_000.0)
    # The unified and the central belt systems of Korea.
    if code == 5179:
        return TransverseMercator(127.5, 38.0, 0.9996, 1_000_000.0, 2_000_000.0, GRS80)
    if code == 5186:
        return TransverseMercator(127.0, 38.0, 1.0, 200_000.0, 600_000.0, GRS80)
    raise ValueError(f"no closed form here for {crs}")


def transform(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """Coordinates of one system in another."""
    if source == target:
        return x, y
    before, after = system(source), system(target)
    if before is not None:
        x, y = before.inverse(x, y)
    elif source == MERCATOR:
        x, y = F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2)
    if after is not None:
        return after.forward(x, y)
    if target == MERCATOR:
        return F.radians(x) * RADIUS, F.log(F.tan(F.lit(math.pi / 4) + F.radians(y) / 2)) * RADIUS
    return x, y
