"""Column helpers for points, segments and grid cells; a point is a tuple of three columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Point = tuple[Column, Column, Column]


def point(x: str, y: str, z: str) -> Point:
    return F.col(x), F.col(y), F.col(z)


def minus(a: Point, b: Point) -> Point:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def dot(a: Point, b: Point) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Point, b: Point) -> Point:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Point) -> Column:
    return F.sqrt(dot(a, a))


def triangle_area(a: Point, b: Point, c: Point) -> Column:
    return norm(cross(minus(b, a), minus(c, a))) / 2


def cell(value: Column, size: float) -> Column:
    """Grid cell by floor division."""
    return F.floor(value / size).cast("long")


def cells_of_box(lo: Point, hi: Point, size: float) -> tuple[Column, Column, Column]:
    """For three explodes: all cells that a box touches."""
    return tuple(F.sequence(cell(a, size), cell(b, size)) for a, b in zip(lo, hi, strict=True))


def neighbours(column: Column) -> Column:
    """A cell index and its two neighbours, for an explode."""
    return F.array(column - 1, column, column + 1)


def closest_approach(products: DataFrame) -> DataFrame:
    """Adds s and t of the closest points p + s u, q + t v of two lines; parallel lines are left out.

    Needs the dot products uu, uv, vv, uw, vw, where w = p - q.
    """
    den = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    den = products.withColumn("den", F.when(F.abs(den) > 1e-12, den)).where("den is not null")
    s = (F.col("uv") * F.col("vw") - F.col("vv") * F.col("uw")) / F.col("den")
    t = (F.col("uu") * F.col("vw") - F.col("uv") * F.col("uw")) / F.col("den")
    return den.withColumns({"s": s, "t": t})


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is worked out once, however often `then` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
