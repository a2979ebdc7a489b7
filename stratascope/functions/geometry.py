"""Column expressions on the sphere, on angles and on periodic axes."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EARTH_KM = 6371.0


def great_circle_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column, radius: float = EARTH_KM) -> Column:
    dlat, dlon = F.radians(lat_b - lat_a), F.radians(lon_b - lon_a)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def wrapped_difference(a: Column, b: Column, period: float) -> Column:
    """a - b on a circle, in [-period / 2, period / 2)."""
    d = a - b + period / 2
    return d - F.floor(d / period) * period - period / 2


@F.pandas_udf(DoubleType())
def facing(dy: pd.Series, dx: pd.Series, angle: pd.Series, period: pd.Series) -> pd.Series:
    """The cosine of an angle against the bearing (dy, dx), the difference taken on a circle of ``period`` degrees.

    By the C library's atan2 and cos: the sum of two cosines that cancel is 0 or the last bit of either, and its sign then
    depends on whose they are. The JVM's differ in that bit.
    """

    def one(y: float, x: float, a: float, p: float) -> float:
        d = math.degrees(math.atan2(x, y)) - a + p / 2
        return math.cos(math.radians(d - math.floor(d / p) * p - p / 2)) if math.isfinite(d) else math.nan

    return pd.Series([one(*r) for r in zip(dy.tolist(), dx.tolist(), angle.tolist(), period.tolist())], dtype="float64")


def periodic_distance(a: Column, b: Column, period: float) -> Column:
    d = F.abs(a - b)
    return F.least(d, period - d)


def cell_area(lat: Column, dlat: float, dlon: float, radius: float = EARTH_KM) -> Column:
    """Exact area of a cell of a latitude-longitude grid, bands cut at the poles."""
    top, low = F.least(F.lit(90.0), lat + dlat / 2), F.greatest(F.lit(-90.0), lat - dlat / 2)
    return radius * radius * F.radians(F.lit(dlon)) * (F.sin(F.radians(top)) - F.sin(F.radians(low)))


def dx_metres(lat: Column, dlon: float, radius: float = EARTH_KM * 1000) -> Column:
    return radius * F.cos(F.radians(lat)) * F.radians(F.lit(dlon))


def dy_metres(dlat: float, radius: float = EARTH_KM * 1000) -> Column:
    return F.lit(radius) * F.radians(F.lit(dlat))


def bearing(dy: Column, dx: Column) -> Column:
    return F.degrees(F.atan2(dy, dx))


def relative_difference(a: Column, b: Column) -> Column:
    """|a - b| over the mean size of both; 0 where both are 0."""
    return F.when((a == 0) & (b == 0), 0.0).otherwise(F.abs(a - b) / ((F.abs(a) + F.abs(b)) / 2))


def signed_coincidence_radius(alpha: float, count: Column, measure: float, dimensions: int) -> Column:
    """Radius at which chance neighbours are expected with probability alpha among ``count`` points in a volume."""
    ball = {1: 2.0, 2: 3.141592653589793, 3: 4.1887902047863905}[dimensions]
    return F.pow(alpha * measure / (count * ball), 1.0 / dimensions)
