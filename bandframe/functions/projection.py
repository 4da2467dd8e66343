"""Map projections as Columns: the transverse Mercator family, without a database of reference systems."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def _let(values: list[Column], then: Callable[..., Column]) -> Column:
    """An expression over values that are computed once, however often it names them."""
    bound = F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values)))
    return F.get(F.transform(F.array(bound), lambda s: then(*(s[f"v{i}"] for i in range(len(values))))), F.lit(0))


def _polynomials(n: float, rows: tuple[tuple[float, ...], ...]) -> list[float]:
    """Coefficient j of a series: row j by rising powers of ``n`` from 1."""
    return [sum(c * n ** (i + 1) for i, c in enumerate(row)) for row in rows]


#: Krueger's series to the fourth power of the third flattening (fixed values; Karney, 2011): forward, inverse, latitude.
FORWARD = ((1 / 2, -2 / 3, 5 / 16, 41 / 180), (0, 13 / 48, -3 / 5, 557 / 1440), (0, 0, 61 / 240, -103 / 140), (0, 0, 0, 49561 / 161280))
INVERSE = ((1 / 2, -2 / 3, 37 / 96, -1 / 360), (0, 1 / 48, 1 / 15, -437 / 1440), (0, 0, 17 / 480, -37 / 840), (0, 0, 0, 4397 / 161280))
LATITUDE = ((2, -2 / 3, -2, 116 / 45), (0, 7 / 3, -8 / 5, -227 / 45), (0, 0, 56 / 15, -136 / 35), (0, 0, 0, 4279 / 630))


@dataclass(frozen=True)
class TransverseMercator:
    """A transverse Mercator projection of an ellipsoid (axis in metres, flattening); angles in degrees.

    The series is good to far below a millimetre within a dozen degrees of the central meridian.
    """

    meridian: float
    scale: float = 0.9996
    false_east: float = 500_000.0
    false_north: float = 0.0
    axis: float = 6_378_137.0
    flattening: float = 1 / 298.257223563
    origin: float = 0.0

    @property
    def third(self) -> float:
        return self.flattening / (2 - self.flattening)

    @property
    def radius(self) -> float:
        """The scaled radius of the sphere whose meridian is as long as the ellipsoid's."""
        n = self.third
        return self.scale * self.axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    def _rectified(self, latitude: Column) -> Column:
        """The tangent of the conformal latitude."""
        e = (self.flattening * (2 - self.flattening)) ** 0.5
        return _let([F.sin(F.radians(latitude))], lambda s: F.sinh(F.atanh(s) - e * F.atanh(e * s)))

    @staticmethod
    def _series(x: Column, y: Column, coefficients: list[float], sign: int) -> Column:
        """Both coordinates on the sphere with the terms of a series added."""
        for_x = x + sign * sum((F.lit(c) * F.sin(2 * j * x) * F.cosh(2 * j * y) for j, c in enumerate(coefficients, 1)), F.lit(0.0))
        for_y = y + sign * sum((F.lit(c) * F.cos(2 * j * x) * F.sinh(2 * j * y) for j, c in enumerate(coefficients, 1)), F.lit(0.0))
        return F.struct(for_x.alias("x"), for_y.alias("y"))

    def _north_of(self, latitude: Column) -> Column:
        chi = F.atan(self._rectified(latitude))
        return _let([chi], lambda x: self._series(x, F.lit(0.0), _polynomials(self.third, FORWARD), 1)["x"])

    def forward(self, latitude: Column, longitude: Column) -> Column:
        """East and north of a place, a struct."""
        apart = F.radians(longitude - self.meridian)

        def placed(t: Column, d: Column) -> Column:
            return _let([F.atan2(t, F.cos(d)), F.asinh(F.sin(d) / F.sqrt(t * t + F.cos(d) * F.cos(d)))], lambda x, y: self._series(x, y, _polynomials(self.third, FORWARD), 1))

        start = self._north_of(F.lit(float(self.origin))) if self.origin else F.lit(0.0)
        out = _let([self._rectified(latitude), apart], placed)
        return _let([out, start], lambda p, s: F.struct((self.false_east + self.radius * p["y"]).alias("east"), (self.false_north + self.radius * (p["x"] - s)).alias("north")))

    def inverse(self, east: Column, north: Column) -> Column:
        """Latitude and longitude of a place on the map, a struct."""
        start = self._north_of(F.lit(float(self.origin))) if self.origin else F.lit(0.0)
        onto = _let([(north - self.false_north) / self.radius + start, (east - self.false_east) / self.radius], lambda x, y: self._series(x, y, _polynomials(self.third, INVERSE), -1))

        def placed(p: Column) -> Column:
            chi = F.asin(F.sin(p["x"]) / F.cosh(p["y"]))
            terms = _polynomials(self.third, LATITUDE)
            latitude = _let([chi], lambda c: c + sum((F.lit(k) * F.sin(2 * j * c) for j, k in enumerate(terms, 1)), F.lit(0.0)))
            return F.struct(F.degrees(latitude).alias("latitude"), (self.meridian + F.degrees(F.atan2(F.sinh(p["y"]), F.cos(p["x"])))).alias("longitude"))

        return _let([onto], placed)


def utm(zone: int, south: bool = False) -> TransverseMercator:
    """A zone of the Universal Transverse Mercator system on WGS 84."""
    if not 1 <= zone <= 60:
        raise ValueError(f"no such zone: {zone}")
    return TransverseMercator(6.0 * zone - 183.0, false_north=10_000_000.0 if south else 0.0)


def between(source: TransverseMercator, target: TransverseMercator) -> Callable[[Column, Column], Point]:
    """The ``to_src`` of ``regrid_nearest``: from the target's map to the source's, on one ellipsoid."""
    if (source.axis, source.flattening) != (target.axis, target.flattening):
        raise ValueError("the projections are of different ellipsoids")

    def to_src(x: Column, y: Column) -> Point:
        at = _let([target.inverse(x, y)], lambda p: source.forward(p["latitude"], p["longitude"]))
        return at["east"], at["north"]

    return to_src
