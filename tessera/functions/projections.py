"""Map projections as column expressions: transverse Mercator (UTM), Albers, spherical Mercator.

All are the published series for an ellipsoid, with the third flattening n: Krueger's for
transverse Mercator, Snyder's (Map Projections, 1987, sections 14 and 3) for Albers. Codes name
the reference systems by their numbers in the public EPSG registry. The datums of 4326 and of
NAD83 (26911, 3310) are taken as one, as those systems define their ellipsoids within 0.1 mm of
each other; no datum shift is applied.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Pair = tuple[Column, Column]


@dataclass(frozen=True)
class Ellipsoid:
    """Equatorial radius in metres and flattening."""

    a: float
    f: float

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    @property
    def n(self) -> float:
        return self.f / (2 - self.f)


GRS80 = Ellipsoid(6378137.0, 1 / 298.257222101)
WGS84 = Ellipsoid(6378137.0, 1 / 298.257223563)


def _sines(x: Column, terms: list[float]) -> Column:
    return sum((c * F.sin(2 * k * x) for k, c in enumerate(terms, 1)), F.lit(0.0))


def _atanh(x: Column) -> Column:
    return (F.log1p(x) - F.log1p(-x)) / 2


@dataclass(frozen=True)
class TransverseMercator:
    """One zone: central meridian in degrees, scale on it, false easting and northing."""

    lon0: float
    scale: float = 0.9996
    east: float = 500_000.0
    north: float = 0.0
    ellipsoid: Ellipsoid = GRS80

    def _series(self) -> tuple[float, list[float], list[float], list[float]]:
        """Rectifying radius; coefficients of the forward, the inverse and the latitude series, to n^4."""
        n = self.ellipsoid.n
        radius = self.ellipsoid.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
        beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
        delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
        return radius, alpha, beta, delta

    def forward(self, lon: Column, lat: Column) -> Pair:
        radius, alpha, _, _ = self._series()
        e = math.sqrt(self.ellipsoid.e2)
        phi, lam = F.radians(lat), F.radians(lon - self.lon0)
        conformal = F.sinh(_atanh(F.sin(phi)) - e * _atanh(e * F.sin(phi)))
        xi, eta = F.atan2(conformal, F.cos(lam)), _atanh(F.sin(lam) / F.sqrt(1 + conformal * conformal))
        x = eta + sum((c * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, c in enumerate(alpha, 1)), F.lit(0.0))
        y = xi + sum((c * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, c in enumerate(alpha, 1)), F.lit(0.0))
        return self.east + self.scale * radius * x, self.north + self.scale * radius * y

    def inverse(self, x: Column, y: Column) -> Pair:
        radius, _, beta, delta = self._series()
        xi, eta = (y - self.north) / (self.scale * radius), (x - self.east) / (self.scale * radius)
        across = eta - sum((c * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, c in enumerate(beta, 1)), F.lit(0.0))
        along = xi - sum((c * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, c in enumerate(beta, 1)), F.lit(0.0))
        chi = F.asin(F.sin(along) / F.cosh(across))
        return self.lon0 + F.degrees(F.atan2(F.sinh(across), F.cos(along))), F.degrees(chi + _sines(chi, delta))


@dataclass(frozen=True)
class Albers:
    """Equal-area cone: origin, the two standard parallels in degrees, false easting and northing."""

    lon0: float
    lat0: float
    first: float
    second: float
    east: float = 0.0
    north: float = 0.0
    ellipsoid: Ellipsoid = GRS80

    def _q(self, sine: float) -> float:
        e = math.sqrt(self.ellipsoid.e2)
        return (1 - e * e) * (sine / (1 - e * e * sine * sine) + math.atanh(e * sine) / e)

    def _cone(self) -> tuple[float, float, float]:
        """Constant of the cone, C, and the radius of the origin's parallel."""
        sines = [math.sin(math.radians(v)) for v in (self.first, self.second, self.lat0)]
        m = [math.cos(math.radians(v)) ** 2 / (1 - self.ellipsoid.e2 * s * s) for v, s in zip((self.first, self.second), sines[:2], strict=True)]
        q1, q2, q0 = map(self._q, sines)
        n = (m[0] - m[1]) / (q2 - q1) if self.first != self.second else sines[0]
        c = m[0] + n * q1
        return n, c, self.ellipsoid.a * math.sqrt(c - n * q0) / n

    def forward(self, lon: Column, lat: Column) -> Pair:
        n, c, origin = self._cone()
        e = math.sqrt(self.ellipsoid.e2)
        s = F.sin(F.radians(lat))
        q = (1 - e * e) * (s / (1 - e * e * s * s) + _atanh(e * s) / e)
        rho, theta = self.ellipsoid.a * F.sqrt(c - n * q) / n, n * F.radians(lon - self.lon0)
        return self.east + rho * F.sin(theta), self.north + origin - rho * F.cos(theta)

    def inverse(self, x: Column, y: Column) -> Pair:
        n, c, origin = self._cone()
        dx, dy = x - self.east, origin - (y - self.north)
        rho = F.hypot(dx, dy)
        q = (c - (rho * n / self.ellipsoid.a) ** 2) / n
        e2 = self.ellipsoid.e2
        authalic = F.asin(q / self._q(1.0))
        series = [e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360]
        start = authalic + _sines(authalic, series)
        # The series leaves some 0.1 mm; one Newton step on q takes it below what doubles hold.
        e, s = math.sqrt(e2), F.sin(start)
        flat = 1 - e2 * s * s
        lat = start + flat * flat / (2 * F.cos(start)) * (q / (1 - e2) - s / flat - _atanh(e * s) / e)
        sign = 1.0 if n > 0 else -1.0
        return self.lon0 + F.degrees(F.atan2(sign * dx, sign * dy) / n), F.degrees(lat)


@dataclass(frozen=True)
class SphericalMercator:
    """Mercator of a sphere of the equatorial radius."""

    radius: float = WGS84.a

    def forward(self, lon: Column, lat: Column) -> Pair:
        return self.radius * F.radians(lon), self.radius * _atanh(F.sin(F.radians(lat)))

    def inverse(self, x: Column, y: Column) -> Pair:
        return F.degrees(x / self.radius), F.degrees(F.atan(F.sinh(y / self.radius)))


@dataclass(frozen=True)
class Geographic:
    """Longitude and latitude in degrees."""

    def forward(self, lon: Column, lat: Column) -> Pair:
        return lon, lat

    inverse = forward


#: Fixed values of the public registry: UTM zone 11 north, Albers for California, web Mercator, degrees.
SYSTEMS = {4326: Geographic(), 26911: TransverseMercator(-117.0), 3310: Albers(-120.0, 0.0, 34.0, 40.5, 0.0, -4_000_000.0), 3857: SphericalMercator()}


def _check(*codes: int) -> None:
    for code in codes:
        if code not in SYSTEMS:
            raise ValueError(f"unknown reference system {code}; known are {sorted(SYSTEMS)}")


def transform(x: Column, y: Column, source: int, target: int) -> Pair:
    """Coordinates (longitude or easting first) in another system; null and not-a-number stay what they are."""
    _check(source, target)
    return (x, y) if source == target else SYSTEMS[target].forward(*SYSTEMS[source].inverse(x, y))


def reproject(df: DataFrame, source: int, target: int, x: str = "x", y: str = "y") -> DataFrame:
    """``df`` with its coordinate columns in another system, by way of degrees in a projection between."""
    _check(source, target)
    if source == target:
        return df
    lon, lat = SYSTEMS[source].inverse(F.col(x), F.col(y))
    degrees = df.withColumns({x: lon, y: lat})
    east, north = SYSTEMS[target].forward(F.col(x), F.col(y))
    return degrees.withColumns({x: east, y: north})


def reproject_ring(ring: Column, source: int, target: int) -> Column:
    """A ring of struct(x, y), point by point."""

    def point(p: Column) -> Column:
        x, y = transform(p["x"], p["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, point)
