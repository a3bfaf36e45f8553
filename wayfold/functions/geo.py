"""Geometry on the sphere as Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean radius of the earth in metres.
RADIUS = 6_371_008.8


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = RADIUS) -> Column:
    """Great-circle distance in metres of two places in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lng2) - F.radians(lng1)) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def xyz(lat_e7: Column, lng_e7: Column) -> list[Column]:
    """Place in space in metres. Distances need no special case at the poles or at 180 degrees."""
    lat, lng = F.radians(lat_e7 / 1e7), F.radians(lng_e7 / 1e7)
    return [RADIUS * F.cos(lat) * F.cos(lng), RADIUS * F.cos(lat) * F.sin(lng), RADIUS * F.sin(lat)]


# A grid on the sphere: bands of latitude of equal height, each cut into so many cells that they are about as wide as high.
# A cell is one number, so it travels as 8 bytes, and cells have the same size at the equator, at 180 degrees and at the poles.


def _across(band: Column, height: float) -> Column:
    return F.greatest(F.lit(1), F.floor(360 / height * F.cos(F.radians((band + 0.5) * height - 90)))).cast("long")


def _numbered(band: Column, at: Column) -> Column:
    return band * F.lit(1 << 32) + at


def grid_cell(lat: Column, lng: Column, side: float) -> Column:
    """Cell of a place in degrees; cells are about ``side`` metres long."""
    height = math.degrees(side / RADIUS)
    band = F.floor((lat + 90) / height).cast("long")
    n = _across(band, height)
    return _numbered(band, F.pmod(F.floor((lng + 180) * n / 360).cast("long"), n))


def with_grid_cells(df: DataFrame, lat: Column, lng: Column, half_lat: Column, half_lng: Column, side: float, name: str) -> DataFrame:
    """Rows once for each cell that a box touches, given its middle and half sides in degrees; across 180 degrees too.

    Bands and cells are unrolled in two steps of plain columns, so everything stays in compiled code.
    """
    height = math.degrees(side / RADIUS)
    band = lambda v: F.floor((v + 90) / height).cast("long")
    at = lambda v: F.floor((v + 180) * F.col("_n") / 360).cast("long")
    box = df.withColumns({"_y": lat, "_x": lng, "_h": half_lat, "_w": half_lng})
    banded = box.withColumn("_b", F.explode(F.sequence(band(F.greatest(F.col("_y") - F.col("_h"), F.lit(-90.0))), band(F.least(F.col("_y") + F.col("_h"), F.lit(90.0))))))
    cut = banded.withColumn("_n", _across(F.col("_b"), height))
    cut = cut.withColumns({"_i": at(F.col("_x") - F.col("_w")), "_j": at(F.col("_x") + F.col("_w"))})
    cells = cut.withColumn("_c", F.explode(F.sequence("_i", F.least(F.col("_j"), F.col("_i") + F.col("_n") - 1))))
    return cells.withColumn(name, _numbered(F.col("_b"), F.pmod("_c", "_n"))).drop("_y", "_x", "_h", "_w", "_b", "_n", "_i", "_j", "_c")


def reach(lat: Column, metres: Column) -> tuple[Column, Column]:
    """Half sides in degrees of the box around all places within so many metres; around a pole the box goes round it."""
    d = F.degrees(metres / RADIUS) * (1 + 1e-9) + 1e-9
    wide = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(d)) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-12))))) + 1e-9
    return d, F.when(F.abs(lat) + d >= 90, F.lit(180.0)).otherwise(wide)
