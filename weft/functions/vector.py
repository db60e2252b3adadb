"""Vectors as array columns: exact dot products, norms and distances, and plane geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The eight compass points from north, clockwise.
POINTS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def dot(a: Column, b: Column) -> Column:
    """0 where a vector is missing or lengths differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def normalized(a: Column) -> Column:
    """A unit vector; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def bearing(dx: Column, dy: Column) -> Column:
    """The compass point of a direction; null for no direction at all."""
    angle = F.pmod(F.degrees(F.atan2(dx, dy)) + 22.5, F.lit(360.0))
    return F.when((dx != 0) | (dy != 0), F.element_at(F.array(*map(F.lit, POINTS)), (F.floor(angle / 45) + 1).cast("int")))
