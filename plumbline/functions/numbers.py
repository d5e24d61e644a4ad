"""Numeric expressions with the rules for missing values: unknown is null, ranks of absent channels are NO_RANK."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_RANK = 9999
EARTH_KM = 6371.0


def from_nan(c: Column) -> Column:
    """NaN as null: comparisons and maxima would otherwise take it for the largest number."""
    return F.when(~F.isnan(c), c)


def number(c: Column) -> Column:
    """Anything as a double; null if it is no number."""
    return from_nan(c.try_cast("double"))


def price(c: Column) -> Column:
    """A price as a double within 0 and a million; null if it is no number."""
    v = number(c)
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(0.0)), F.lit(1e6)))


def log_count(c: Column) -> Column:
    return F.log1p(F.greatest(F.coalesce(number(c), F.lit(0.0)), F.lit(0.0)))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null unless b is above 0."""
    return F.when(b > 0, a / b)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    known = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    return F.when(known, 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0)))))


def unit(vector: Column) -> Column:
    """L2-normalised vector; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    return F.transform(vector, lambda v: F.when(norm > 0, v.cast("double") / norm).otherwise(F.lit(0.0)))


def seeded(id_col: Column, seed: int) -> Column:
    """A hash that any engine can compute, to draw and shuffle by: md5 of 'id:seed'."""
    return F.md5(F.concat(id_col.cast("string"), F.lit(f":{seed}")))
