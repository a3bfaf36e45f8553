"""Queries of distances, areas and the reverse search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import RADIUS, haversine
from ..operators import enrich as E
from ..operators import forward as W
from ..operators import reverse as R
from ..operators.regions import containing_regions
from ..operators.streets import distance_bonus, spread_positions
from . import geography as G

CENTRE = (42.5, 2.5)


def _customers(s: SparkSession, d: str) -> DataFrame:
    return G.placed(s, d, "customer", "c_custkey")


def _away() -> F.Column:
    return haversine(F.lit(CENTRE[0]), F.lit(CENTRE[1]), F.col("lat_e7") / 1e7, F.col("lng_e7") / 1e7)


def haversine_distance(s: SparkSession, d: str) -> DataFrame:
    return _customers(s, d).select("c_custkey", F.round(_away(), 3).alias("metres"))


def distance_bias(s: SparkSession, d: str) -> DataFrame:
    return _customers(s, d).select("c_custkey", distance_bonus(_away(), F.lit(0.5)).alias("bonus"))


def bbox_filter(s: SparkSession, d: str) -> DataFrame:
    box = F.struct(F.lit(41.5).alias("min_lat"), F.lit(0.5).alias("min_lng"), F.lit(43.25).alias("max_lat"), F.lit(3.1).alias("max_lng"))
    return _customers(s, d).where(W.in_box(box, F.col("lat_e7"), F.col("lng_e7"))).select("c_custkey", "lat_e7", "lng_e7")


def area_lookup(s: SparkSession, d: str) -> DataFrame:
    return containing_regions(_customers(s, d), "c_custkey", G.areas(s, d), "area_id").select(F.col("a_id").alias("c_custkey"), F.col("b_id").alias("area_id"))


def _sets(s: SparkSession, d: str) -> DataFrame:
    """Customers with their ordered list of areas and the attributes that are read off it."""
    sets = E.area_sets(_customers(s, d), "c_custkey", G.areas(s, d))
    flat = sets.select("c_custkey", F.posexplode("areas").alias("i", "a")).select("c_custkey", "i", "a.area_id")
    full = flat.join(G.areas(s, d).select("area_id", "name", "admin_level", "timezone", "country_code"), "area_id")
    item = F.struct("i", "area_id", "name", "admin_level", "timezone", "country_code")
    return full.groupBy("c_custkey").agg(F.array_sort(F.collect_list(item)).alias("areas"))


def area_sets(s: SparkSession, d: str) -> DataFrame:
    sets = E.area_sets(_customers(s, d), "c_custkey", G.areas(s, d))
    return sets.groupBy(F.array_join(F.transform("areas", lambda a: a["area_id"].cast("string")), ",").alias("areas")).agg(F.count(F.lit(1)).alias("places"))


def point_in_polygon(s: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    cy, cx = ((F.lit(40) + n % 5) * 10_000_000 + 5_000_000), (F.floor(n / 5) * 10_000_000 + 5_000_000)
    p = lambda a, b: F.struct(a.cast("int").alias("lat_e7"), b.cast("int").alias("lng_e7"))
    r = 5_000_000
    ring = F.array(p(cy - r, cx), p(cy, cx + r), p(cy + r, cx), p(cy, cx - r))
    diamonds = G.table(s, d, "nation").select(n.cast("long").alias("id"), F.array(F.struct(ring.alias("outer"), F.array().cast("array<array<struct<lat_e7:int,lng_e7:int>>>").alias("inners"))).alias("polygons"))
    return containing_regions(_customers(s, d), "c_custkey", diamonds, "id").select(F.col("a_id").alias("c_custkey"), F.col("b_id").alias("n_nationkey"))


def city_area(s: SparkSession, d: str) -> DataFrame:
    return _sets(s, d).select("c_custkey", F.get("areas", E.city_index_col(F.col("areas")))["name"].alias("city"))


def zip_area(s: SparkSession, d: str) -> DataFrame:
    return _sets(s, d).select("c_custkey", F.get("areas", E.zip_index_col(F.col("areas")))["name"].alias("zip"))


def timezone_of_set(s: SparkSession, d: str) -> DataFrame:
    return _sets(s, d).select("c_custkey", E.timezone_col(F.col("areas")).alias("timezone"))


def country_code(s: SparkSession, d: str) -> DataFrame:
    return _sets(s, d).select("c_custkey", E.country_code_col(F.col("areas")).alias("country_code"))


def admin_level_label(s: SparkSession, d: str) -> DataFrame:
    return G.areas(s, d).select("area_id", E.level_label_col(F.col("admin_level")).alias("label"))


def stored_population(s: SparkSession, d: str) -> DataFrame:
    return _customers(s, d).select("c_custkey", E.stored_population_col(F.col("c_custkey") * 997 % 3000000).alias("population"))


def _points(s: SparkSession, d: str) -> DataFrame:
    return G.placed(s, d, "supplier", "s_suppkey", G.dense).select(F.col("s_suppkey").alias("point_id"), (F.col("lat_e7") / 1e7).alias("lat"), (F.col("lng_e7") / 1e7).alias("lng"))


def _entities(s: SparkSession, d: str, name: str, key: str) -> DataFrame:
    return G.placed(s, d, name, key, G.dense).select(F.col(key).alias("entity_id"), (F.col("lat_e7") / 1e7).alias("lat"), (F.col("lng_e7") / 1e7).alias("lng"))


def _scores(near: DataFrame) -> DataFrame:
    """Scores are rounded before the ids are taken apart, once for all entities of a place."""
    return near.select("point_id", "entity_ids", _rounded("score").alias("score")).select("point_id", F.explode("entity_ids").alias("entity_id"), "score")


def _rounded(c: str) -> F.Column:
    """To three digits, halves away from zero; round() of doubles goes through decimal texts, which takes longer than the distance."""
    return F.signum(c) * F.floor(F.abs(c) * 1000 + 0.5) / 1000


def reverse_places(s: SparkSession, d: str) -> DataFrame:
    return _scores(R.near_places(_points(s, d), _entities(s, d, "customer", "c_custkey")))


def reverse_houses(s: SparkSession, d: str) -> DataFrame:
    return _scores(R.near_places(_points(s, d), _entities(s, d, "part", "p_partkey")))


def reverse_streets(s: SparkSession, d: str) -> DataFrame:
    return _scores(R.near_streets(_points(s, d), G.segments(s, d)))


def reverse_topk(s: SparkSession, d: str) -> DataFrame:
    found = R.lookup(_points(s, d), _entities(s, d, "part", "p_partkey"), _entities(s, d, "customer", "c_custkey"), G.segments(s, d))
    return found.select("point_id", "rank", "kind", F.round("score", 3).alias("score"))


def street_position_clustering(s: SparkSession, d: str) -> DataFrame:
    p = G.placed(s, d, "part", "p_partkey", G.dense).select(F.col("p_name").alias("name"), F.col("p_partkey").alias("way_id"), "lat_e7", "lng_e7")
    return spread_positions(p)


def area_language(s: SparkSession, d: str) -> DataFrame:
    """The name in which the area of each customer is shown, with German before French before the default name."""
    k = F.col("c_custkey")
    name = lambda lang, test: F.when(test, F.struct(F.concat(F.lit(lang), F.lit(" "), "c_name").alias("name"), F.lit(lang).alias("lang")))
    names = F.array_compact(F.array(name("default", F.lit(True)), name("de", k % 2 == 0), name("fr", k % 3 == 0), name("it", k % 5 == 0)))
    matched = F.when(k % 7 == 0, F.lit("it")).when(k % 7 == 1, F.lit("default"))
    return _customers(s, d).select("c_custkey", W.shown_name_col(names, ("default", "fr", "de"), matched).alias("shown"))


def _items(s: SparkSession, d: str) -> DataFrame:
    """Orders as items of the search: customers of one residue ask, clerks' numbers are places, order states are lists of areas."""
    o = G.table(s, d, "orders")
    place = F.col("o_orderkey") % 3 == 0
    return o.select("o_orderkey", (F.col("o_custkey") % 40).alias("query_id"), F.when(place, "place").otherwise("street").alias("kind"), (F.col("o_custkey") % 7).alias("loc_id"), F.when(~place & (F.col("o_orderkey") % 5 == 0), F.col("o_orderkey") % 11).cast("long").alias("hn"), F.ascii("o_orderstatus").cast("long").alias("set_id"), F.round("o_totalprice", 2).cast("double").alias("score"))


def dup_marking(s: SparkSession, d: str) -> DataFrame:
    return W.ranked(_items(s, d), None, "o_orderkey").select("o_orderkey", "is_duplicate")


def final_topn(s: SparkSession, d: str) -> DataFrame:
    return W.ranked(_items(s, d), 15, "o_orderkey").select("query_id", "rank", "o_orderkey", "is_duplicate")


QUERIES = {f.__name__: f for f in (haversine_distance, distance_bias, bbox_filter, area_lookup, area_sets, point_in_polygon, city_area, zip_area, timezone_of_set, country_code, admin_level_label, stored_population, reverse_places, reverse_houses, reverse_streets, reverse_topk, street_position_clustering, area_language, dup_marking, final_topn)}

_HAV = lambda a, b, c, e: f"2 * {RADIUS} * asin(least(1.0, sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({e}) - radians({b})) / 2), 2))))"
_CUST = f"cust AS (SELECT c_custkey, {G.sql_wide('c_custkey', 0)} FROM customer)"
_AWAY = _HAV(str(CENTRE[0]), str(CENTRE[1]), "lat_e7 / 1e7", "lng_e7 / 1e7")
_IN = f"{_CUST}, {G.SQL_AREAS}, hit AS (SELECT c_custkey, a.* FROM cust JOIN areas a ON lat_e7 > s7 AND lat_e7 < n7 AND lng_e7 > w7 AND lng_e7 < e7)"
_DEG = f"degrees(500.0 / {RADIUS})"
_PTS = f"pts AS (SELECT s_suppkey AS point_id, lat_e7 / 1e7 AS lat, lng_e7 / 1e7 AS lng FROM (SELECT s_suppkey, {G.sql_dense('s_suppkey', 101)} FROM supplier))"
_ENT = lambda t, k: f"SELECT {k} AS entity_id, lat_e7 / 1e7 AS elat, lng_e7 / 1e7 AS elng FROM (SELECT {k}, {G.sql_dense(k, G.SALT[t])} FROM {t})"
_NEAR = lambda e: f"SELECT point_id, entity_id, {_HAV('lat', 'lng', 'elat', 'elng')} - 10 AS score FROM pts JOIN ({e}) ON abs(elat - lat) <= {_DEG} AND abs(elng - lng) <= {_DEG} / cos(radians(lat))"
_XYZ = lambda a, b: f"[{RADIUS} * cos(radians({a})) * cos(radians({b})), {RADIUS} * cos(radians({a})) * sin(radians({b})), {RADIUS} * sin(radians({a}))]"
_SEGS = (
    f"seg AS (SELECT p_partkey AS entity_id, {G.sql_dense('p_partkey', 2003)} FROM part), "
    "legs AS (SELECT entity_id, (lat_e7 - 20000) / 1e7 AS a1, (lng_e7 - 20000) / 1e7 AS o1, lat_e7 / 1e7 AS a2, lng_e7 / 1e7 AS o2, lat_e7, lng_e7 FROM seg UNION ALL SELECT entity_id, lat_e7 / 1e7, lng_e7 / 1e7, (lat_e7 + 20000) / 1e7, (lng_e7 - 20000) / 1e7, lat_e7, lng_e7 FROM seg), "
    f"near3 AS (SELECT point_id, entity_id, {_XYZ('lat', 'lng')} AS p, {_XYZ('a1', 'o1')} AS u, {_XYZ('a2', 'o2')} AS v FROM pts JOIN legs ON (lat_e7 - 20000) / 1e7 <= lat + {_DEG} AND (lat_e7 + 20000) / 1e7 >= lat - {_DEG} AND (lng_e7 - 20000) / 1e7 <= lng + {_DEG} / cos(radians(lat)) AND lng_e7 / 1e7 >= lng - {_DEG} / cos(radians(lat))), "
    "tt AS (SELECT *, greatest(0, least(1, ((p[1]-u[1])*(v[1]-u[1])+(p[2]-u[2])*(v[2]-u[2])+(p[3]-u[3])*(v[3]-u[3])) / ((v[1]-u[1])*(v[1]-u[1])+(v[2]-u[2])*(v[2]-u[2])+(v[3]-u[3])*(v[3]-u[3])))) AS t FROM near3), "
    "lines AS (SELECT point_id, entity_id, min(sqrt(pow(p[1]-u[1]-t*(v[1]-u[1]),2)+pow(p[2]-u[2]-t*(v[2]-u[2]),2)+pow(p[3]-u[3]-t*(v[3]-u[3]),2))) AS score FROM tt GROUP BY ALL)"
)
_DUP = (
    "items AS (SELECT o_orderkey, o_custkey % 40 AS query_id, CASE WHEN o_orderkey % 3 = 0 THEN 'place' ELSE 'street' END AS kind, o_custkey % 7 AS loc_id, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 = 0 THEN o_orderkey % 11 END AS hn, ascii(o_orderstatus) AS set_id, round(o_totalprice, 2)::DOUBLE AS score FROM orders), "
    "dup AS (SELECT a.*, EXISTS (SELECT 1 FROM items b WHERE b.query_id = a.query_id AND b.kind = a.kind AND b.loc_id = a.loc_id AND b.hn IS NOT DISTINCT FROM a.hn AND b.set_id = a.set_id AND (b.score, b.o_orderkey) < (a.score, a.o_orderkey)) AS is_duplicate FROM items a)"
)

#: Ways of a name come one after the other; each is kept if it is far enough from all kept before it.
_SPREAD = (
    f"WITH RECURSIVE w AS (SELECT p_name AS name, p_partkey AS way_id, lat_e7, lng_e7, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM (SELECT p_name, p_partkey, {G.sql_dense('p_partkey', 2003)} FROM part)), "
    "r AS (SELECT DISTINCT name, 0 AS n, []::STRUCT(way_id BIGINT, lat_e7 INT, lng_e7 INT)[] AS held FROM w UNION ALL SELECT r.name, r.n + 1, CASE WHEN len(list_filter(held, lambda k: "
    + _HAV("k.lat_e7 / 1e7", "k.lng_e7 / 1e7", "w.lat_e7 / 1e7", "w.lng_e7 / 1e7")
    + " < 1500)) = 0 THEN list_append(held, {'way_id': w.way_id::BIGINT, 'lat_e7': w.lat_e7::INT, 'lng_e7': w.lng_e7::INT}) ELSE held END FROM r JOIN w ON w.name = r.name AND w.rn = r.n + 1), "
    "last AS (SELECT name, arg_max(held, n) AS held FROM r GROUP BY name) "
    "SELECT name, (i - 1)::INT AS pos, held[i].way_id AS way_id, held[i].lat_e7 AS lat_e7, held[i].lng_e7 AS lng_e7 FROM last, range(1, 100000) t(i) WHERE i <= len(held)"
)

SQL = {
    "street_position_clustering": _SPREAD,
    "area_language": (
        "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 AND c_custkey % 5 = 0 THEN 'it' WHEN c_custkey % 7 = 1 THEN 'default' WHEN c_custkey % 2 = 0 THEN 'de' WHEN c_custkey % 3 = 0 THEN 'fr' ELSE 'default' END || ' ' || c_name AS shown FROM customer"
    ),
    "haversine_distance": f"WITH {_CUST} SELECT c_custkey, round({_AWAY}, 3) AS metres FROM cust",
    "distance_bias": f"WITH {_CUST}, m AS (SELECT c_custkey, {_AWAY} AS m FROM cust) SELECT c_custkey, 0.5 * CASE WHEN m < 2000 THEN 2.5 WHEN m < 10000 THEN 2 WHEN m < 100000 THEN 1 WHEN m < 1000000 THEN 0.5 ELSE 0 END::DOUBLE AS bonus FROM m",
    "bbox_filter": f"WITH {_CUST} SELECT * FROM cust WHERE lat_e7 BETWEEN 415000000 AND 432500000 AND lng_e7 BETWEEN 5000000 AND 31000000",
    "area_lookup": f"WITH {_IN} SELECT c_custkey, area_id FROM hit",
    "area_sets": f"WITH {_IN}, g AS (SELECT c_custkey, string_agg(area_id::VARCHAR, ',' ORDER BY admin_level, area_id) AS areas FROM hit GROUP BY 1) SELECT areas, count(*) AS places FROM g GROUP BY 1",
    "point_in_polygon": f"WITH {_CUST} SELECT c_custkey, n_nationkey::BIGINT AS n_nationkey FROM cust JOIN nation ON abs(lat_e7 - ((40 + n_nationkey % 5) * 10000000 + 5000000)) + abs(lng_e7 - ((n_nationkey // 5) * 10000000 + 5000000)) <= 5000000",
    "city_area": f"WITH {_IN} SELECT c_custkey, arg_min(name, CASE WHEN admin_level > 8 THEN 10 * (admin_level - 8) ELSE 8 - admin_level END) AS city FROM hit GROUP BY 1",
    "zip_area": f"WITH {_IN} SELECT c_custkey, name AS zip FROM hit WHERE admin_level = 12",
    "timezone_of_set": f"WITH {_IN} SELECT c_custkey, timezone FROM hit WHERE admin_level = 13",
    "country_code": f"WITH {_IN} SELECT c_custkey, country_code FROM hit WHERE admin_level = 2",
    "admin_level_label": f"WITH {G.SQL_AREAS} SELECT area_id, CASE WHEN admin_level = 2 THEN '2' WHEN admin_level = 4 THEN 'state' WHEN admin_level = 8 THEN 'town' ELSE '' END AS label FROM areas",
    "stored_population": "SELECT c_custkey, (c_custkey * 997 % 3000000) // 200 * 200 AS population FROM customer",
    "reverse_places": f"WITH {_PTS} SELECT point_id, entity_id, round(score, 3) AS score FROM ({_NEAR(_ENT('customer', 'c_custkey'))})",
    "reverse_houses": f"WITH {_PTS} SELECT point_id, entity_id, round(score, 3) AS score FROM ({_NEAR(_ENT('part', 'p_partkey'))})",
    "reverse_streets": f"WITH {_PTS}, {_SEGS} SELECT point_id, entity_id, round(score, 3) AS score FROM lines",
    "reverse_topk": (
        f"WITH {_PTS}, {_SEGS}, allhits AS (SELECT point_id, entity_id, score, 'place' AS kind FROM ({_NEAR(_ENT('customer', 'c_custkey'))}) UNION ALL SELECT point_id, entity_id, score, 'house' FROM ({_NEAR(_ENT('part', 'p_partkey'))}) UNION ALL SELECT point_id, entity_id, score, 'street' FROM lines) "
        "SELECT point_id, rank, kind, round(score, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY score, kind, entity_id)::INT AS rank FROM allhits) WHERE rank <= 10"
    ),
    "dup_marking": f"WITH {_DUP} SELECT o_orderkey, is_duplicate FROM dup",
    "final_topn": f"WITH {_DUP} SELECT query_id, rank, o_orderkey, is_duplicate FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY is_duplicate, round(score, 9), kind, loc_id, hn NULLS LAST, set_id, o_orderkey)::INT AS rank FROM dup) WHERE rank <= 15",
}
