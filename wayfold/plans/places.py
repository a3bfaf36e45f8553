"""Queries of places near places and in regions (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.near import near_lines, near_points
from ..operators.regions import containing_regions
from ..sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Houses under 30 m apart, streets under 20 m from a house, and the areas that contain a house."""
    houses = table(spark, folder, "house_coordinates")
    near = near_points(houses, "house_id", 30.0)
    street = near_lines(houses, "house_id", table(spark, folder, "street_segments"), "segment_id", 20.0)
    inside = containing_regions(houses, "house_id", table(spark, folder, "osm_areas"), "id")
    return near.select(F.lit("near").alias("kind"), "a_id", "b_id").unionByName(street.select(F.lit("street").alias("kind"), "a_id", "b_id")).unionByName(inside.select(F.lit("inside").alias("kind"), "a_id", "b_id"))


QUERIES = {"p2_found": p2_found}

#: Every pair held against every other, within boxes: haversine for points, the foot on the chord for lines, even-odd
#: counts of crossed edges in whole numbers for areas.
_P2 = """
WITH h AS (SELECT DISTINCT house_id, lat_e7, lng_e7, radians(lat_e7 / 1e7) AS la, radians(lng_e7 / 1e7) AS lo FROM house_coordinates WHERE lat_e7 IS NOT NULL AND lng_e7 IS NOT NULL AND house_id IS NOT NULL),
near AS (SELECT DISTINCT 'near' AS kind, a.house_id AS a_id, b.house_id AS b_id FROM h a JOIN h b ON a.house_id < b.house_id AND b.lat_e7 BETWEEN a.lat_e7 - 3000 AND a.lat_e7 + 3000
  WHERE 2 * 6371008.8 * asin(least(1, sqrt(pow(sin((b.la - a.la) / 2), 2) + cos(a.la) * cos(b.la) * pow(sin((b.lo - a.lo) / 2), 2)))) < 30),
c AS (SELECT DISTINCT segment_id, list_filter(line, lambda p: p.lat_e7 IS NOT NULL AND p.lng_e7 IS NOT NULL) AS l FROM street_segments WHERE segment_id IS NOT NULL),
legs AS (SELECT segment_id, l[i] AS u, l[least(i + 1, len(l))] AS v FROM c, range(1, 8) t(i) WHERE i < len(l) OR len(l) = 1 AND i = 1),
space AS (SELECT segment_id, least(u.lat_e7, v.lat_e7) - 3000 AS low, greatest(u.lat_e7, v.lat_e7) + 3000 AS high,
  [cos(radians(u.lat_e7 / 1e7)) * cos(radians(u.lng_e7 / 1e7)), cos(radians(u.lat_e7 / 1e7)) * sin(radians(u.lng_e7 / 1e7)), sin(radians(u.lat_e7 / 1e7))] AS a,
  [cos(radians(v.lat_e7 / 1e7)) * cos(radians(v.lng_e7 / 1e7)), cos(radians(v.lat_e7 / 1e7)) * sin(radians(v.lng_e7 / 1e7)), sin(radians(v.lat_e7 / 1e7))] AS b FROM legs),
way AS (SELECT segment_id, low, high, a, [b[1] - a[1], b[2] - a[2], b[3] - a[3]] AS d FROM space),
spot AS (SELECT house_id, lat_e7, [cos(la) * cos(lo), cos(la) * sin(lo), sin(la)] AS p FROM h),
met AS (SELECT house_id, segment_id, [p[1] - a[1], p[2] - a[2], p[3] - a[3]] AS w, d FROM spot JOIN way ON lat_e7 BETWEEN low AND high),
foot AS (SELECT house_id, segment_id, w, d, CASE WHEN d[1] * d[1] + d[2] * d[2] + d[3] * d[3] > 0 THEN greatest(0, least(1, (w[1] * d[1] + w[2] * d[2] + w[3] * d[3]) / (d[1] * d[1] + d[2] * d[2] + d[3] * d[3]))) ELSE 0 END AS t FROM met),
street AS (SELECT DISTINCT 'street' AS kind, house_id AS a_id, segment_id AS b_id FROM foot WHERE 6371008.8 * sqrt(pow(w[1] - t * d[1], 2) + pow(w[2] - t * d[2], 2) + pow(w[3] - t * d[3], 2)) < 20),
shapes AS (SELECT id, k, unnest(list_concat([poly."outer"], coalesce(poly.inners, []))) AS ring FROM (SELECT id, unnest(polygons) AS poly, generate_subscripts(polygons, 1) AS k FROM (SELECT id, any_value(polygons) AS polygons FROM osm_areas WHERE id IS NOT NULL GROUP BY id))),
edges AS (SELECT id, k, ring[i].lat_e7::HUGEINT AS y1, ring[i].lng_e7::HUGEINT AS x1, ring[i % len(ring) + 1].lat_e7::HUGEINT AS y2, ring[i % len(ring) + 1].lng_e7::HUGEINT AS x2 FROM shapes, range(1, 2000) t(i) WHERE i <= len(ring)),
boxes AS (SELECT id, k, min(y1) AS y_low, max(y1) AS y_high, min(x1) AS x_low, max(x1) AS x_high FROM edges GROUP BY id, k),
maybe AS (SELECT house_id, lat_e7 AS y, lng_e7 AS x, id, k FROM h JOIN boxes ON lat_e7 BETWEEN y_low AND y_high AND lng_e7 BETWEEN x_low AND x_high),
crossed AS (SELECT house_id, y, x, id, k, count(*) AS n FROM maybe JOIN edges USING (id, k)
  WHERE (y1 > y) <> (y2 > y) AND CASE WHEN y2 > y1 THEN (x - x1) * (y2 - y1) < (y - y1) * (x2 - x1) ELSE (x - x1) * (y2 - y1) > (y - y1) * (x2 - x1) END GROUP BY ALL)
SELECT kind, a_id, b_id FROM near UNION ALL SELECT * FROM street UNION ALL SELECT DISTINCT 'inside', house_id, id FROM crossed WHERE n % 2 = 1
"""
SQL: dict[str, str] = {"p2_found": _P2}
