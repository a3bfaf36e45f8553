"""Points near other points and near lines, as equi-joins on the cells of a grid on the sphere.

Each point lies in one cell of a few times the distance asked for; the other side visits the cells its reach touches, about
two for a point. Only cell, key and e7 numbers are shuffled; places in space are computed after the join, for pairs that
the latitude has not ruled out. Both joins are sort-merge joins, whatever the planner thinks of their sizes: nothing that
grows is broadcast, and cells that are much larger than others are split by adaptive execution.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import RADIUS, grid_cell, reach, with_grid_cells, xyz

#: Sides of the cells in multiples of the distance: larger cells are visited less often and hold more candidates.
POINT_CELL, LINE_CELL = 4.0, 10.0


def _sine_squared(metres: float) -> float:
    return math.sin(min(metres / (2 * RADIUS), math.pi / 2)) ** 2


def _degrees(e7: Column) -> Column:
    return e7 / 1e7


def _placed(points: DataFrame, key: str) -> DataFrame:
    """Distinct places (k, y, x) of each key; rows without key or coordinates have none."""
    known = F.col("lat_e7").isNotNull() & F.col("lng_e7").isNotNull() & F.col(key).isNotNull()
    return points.where(known).select(F.col(key).alias("k"), F.col("lat_e7").alias("y"), F.col("lng_e7").alias("x")).distinct()


def near_points(points: DataFrame, key: str, metres: float) -> DataFrame:
    """Pairs (a_id, b_id), a_id < b_id, of different keys with places less than ``metres`` apart.

    Repeated rows count once; a key with several places is near if one of them is. Input needs lat_e7 and lng_e7.
    """
    side = POINT_CELL * metres
    p = _placed(points, key)
    lat, lng = _degrees(F.col("y")), _degrees(F.col("x"))
    at = p.select("k", "y", "x", grid_cell(lat, lng, side).alias("c"))
    around = with_grid_cells(p.select(F.col("k").alias("k2"), F.col("y").alias("y2"), F.col("x").alias("x2"), lat.alias("lat")), F.col("lat"), _degrees(F.col("x2")), *reach(F.col("lat"), F.lit(metres)), side, "c").drop("lat")
    close = F.abs(F.col("y") - F.col("y2")) <= math.ceil(math.degrees(metres / RADIUS) * 1e7)
    apart = F.pow(F.sin(F.radians((F.col("y") - F.col("y2")) / 2e7)), 2) + F.cos(F.radians(_degrees(F.col("y")))) * F.cos(F.radians(_degrees(F.col("y2")))) * F.pow(F.sin(F.radians((F.col("x").cast("long") - F.col("x2")) / 2e7)), 2)
    pairs = at.hint("merge").join(around.hint("merge"), "c").where((F.col("k") < F.col("k2")) & close & (apart < _sine_squared(metres)))
    return pairs.select(F.col("k").alias("a_id"), F.col("k2").alias("b_id")).distinct()


def _scaled(v: list[Column], f: Column | float) -> list[Column]:
    return [c * f for c in v]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def legs(lines: DataFrame, key: str) -> DataFrame:
    """Lines (array of corners with lat_e7, lng_e7) as legs (k2, y1, x1, y2, x2) between neighbouring corners.

    Corners without coordinates are passed over; a line of one corner is a leg without length; others have none.
    """
    known = F.filter("line", lambda p: p["lat_e7"].isNotNull() & p["lng_e7"].isNotNull())
    rows = lines.where(F.col(key).isNotNull()).select(F.col(key).alias("k2"), known.alias("s")).where(F.size("s") > 0)
    n = F.size("s")
    each = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.struct(F.col("s")[i].alias("a"), F.col("s")[F.least(i + 1, n - 1)].alias("b")))
    return rows.select("k2", F.explode(each).alias("l")).select("k2", F.col("l.a.lat_e7").alias("y1"), F.col("l.a.lng_e7").alias("x1"), F.col("l.b.lat_e7").alias("y2"), F.col("l.b.lng_e7").alias("x2")).distinct()


def _with_leg_cells(legs: DataFrame, metres: float, side: float) -> DataFrame:
    """Legs once for each cell within reach; they are covered by disks around the middles of pieces of at most ``side`` metres."""
    a, b = ([F.col(f"{v}{c}") for c in "xyz"] for v in "ab")
    placed = legs.withColumns({f"{v}{c}": e for v, y, x in (("a", "y1", "x1"), ("b", "y2", "x2")) for c, e in zip("xyz", xyz(F.col(y), F.col(x)), strict=True)})
    measured = placed.withColumn("size", F.sqrt(_dot(*[[q - p for p, q in zip(a, b, strict=True)]] * 2))).withColumn("many", F.greatest(F.ceil(F.col("size") / side), F.lit(1)).cast("int"))
    piece = measured.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    piece = piece.withColumns({f"m{c}": p + (q - p) * ((F.col("i") + 0.5) / F.col("many")) for c, p, q in zip("xyz", a, b, strict=True)})
    mid = [F.col(f"m{c}") for c in "xyz"]
    piece = piece.withColumn("far", F.greatest(F.sqrt(_dot(mid, mid)), F.lit(1.0)))
    piece = piece.withColumns({"lat": F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), mid[2] / F.col("far"))))), "lng": F.degrees(F.atan2(mid[1], mid[0]))})
    # a chord's pieces are longer on the ground, the more so the deeper it lies below it
    piece = piece.withColumn("r", metres + F.col("size") / F.col("many") / 2 * (RADIUS / F.col("far")) * 1.01)
    return with_grid_cells(piece, F.col("lat"), F.col("lng"), *reach(F.col("lat"), F.col("r")), side, "c").select(*legs.columns, "c")


def leg_chord(p: list[Column], a: list[Column], b: list[Column]) -> Column:
    """Chord, squared and for a sphere of radius 1, of unit vector ``p`` to the arc from ``a`` to ``b``."""
    n = _cross(a, b)
    over = (_dot(_cross(n, a), p) >= 0) & (_dot(_cross(b, n), p) >= 0) & (_dot(n, n) > 0)
    sine = F.least(F.lit(1.0), F.pow(_dot(n, p), 2) / F.greatest(_dot(n, n), F.lit(1e-300)))
    to = lambda q: _dot(*[[u - v for u, v in zip(p, q, strict=True)]] * 2)
    # chord squared of an angle with that sine: 2 - 2 cos
    return F.when(over, 2 * sine / (1 + F.sqrt(1 - sine))).otherwise(F.least(to(a), to(b)))


def _may_be_near(metres: float) -> Column:
    """False only for points that are certainly too far from a leg: a test in the plane, with a margin.

    It judges legs within a hundredth of a degree, away from poles and from 180 degrees; there the plane is off by a metre
    at most. All others go on to the exact test.
    """
    whole = lambda c: F.col(c).cast("double")
    du, dv = (whole("x2") - whole("x1")) * F.col("shrink"), whole("y2") - whole("y1")
    u, v = (whole("x1") - whole("x")) * F.col("shrink"), whole("y1") - whole("y")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(u * du + v * dv) / F.greatest(du * du + dv * dv, F.lit(1e-9))))
    limit = (1.1 * metres + 1) * math.degrees(1 / RADIUS) * 1e7
    short = (F.abs(dv) < 100_000) & (F.abs(whole("x2") - whole("x1")) < 100_000) & (F.abs(whole("x1") - whole("x")) < 10_000_000) & (F.abs(whole("y")) < 800_000_000)
    return ~short | ((u + t * du) * (u + t * du) + (v + t * dv) * (v + t * dv) < limit * limit)


def near_lines(points: DataFrame, key: str, lines: DataFrame, line_key: str, metres: float) -> DataFrame:
    """Pairs (a_id, b_id) of a point's key and the key of a line less than ``metres`` away on the ground.

    Lines run along great circles between their corners, the short way round.
    """
    side = LINE_CELL * metres
    lat, lng = _degrees(F.col("y")), _degrees(F.col("x"))
    p = _placed(points, key).select("k", "y", "x", F.cos(F.radians(lat)).alias("shrink"), grid_cell(lat, lng, side).alias("c"))
    q = _with_leg_cells(legs(lines, line_key), metres, side)
    met = p.hint("merge").join(q.hint("merge"), "c").where(_may_be_near(metres))
    # an aggregation keeps the planner from writing these columns out into the filter, once for every time they are used
    for v, (y, x) in (("p", ("y", "x")), ("a", ("y1", "x1")), ("b", ("y2", "x2"))):
        met = met.withColumns({f"{v}{c}": e for c, e in zip("xyz", _scaled(xyz(F.col(y), F.col(x)), 1 / RADIUS), strict=True)})
    chord = leg_chord(*[[F.col(f"{v}{c}") for c in "xyz"] for v in "pab"])
    least = met.groupBy("k", "k2").agg(F.min(chord).alias("chord")).where(F.col("chord") < 4 * _sine_squared(metres))
    return least.select(F.col("k").alias("a_id"), F.col("k2").alias("b_id"))
