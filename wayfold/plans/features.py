"""Queries of map features: filters, routing, names, places, areas, categories, addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import osm
from ..operators.address import address_col, fallback_col
from ..operators.rules import category
from ..sources.tables import table
from . import geography as G

#: Tags that customers stand for, by key modulo the length.
_TAGS = (
    ("public_transport", "stop"), ("amenity", "toilets"), ("amenity", "cafe"), ("natural", "tree"), ("highway", "bus_stop"), ("leisure", "playground"),
    ("building", "industrial"), ("name", "x"), ("traffic_sign", "y"), ("access", "false"), ("amenity", "taxi"),
)
_WAY_KEEPS = (2, 3, 4, 6, 7, 8)
_NODE_KEEPS = (2, 7)


def _tagged(s: SparkSession, d: str) -> DataFrame:
    maps = F.array(*[F.create_map(F.lit(k), F.lit(v)) for k, v in _TAGS])
    return table(s, d, "customer").select("c_custkey", F.get(maps, (F.col("c_custkey") % len(_TAGS)).cast("int")).alias("tags"))


def osm_way_filter(s: SparkSession, d: str) -> DataFrame:
    return _tagged(s, d).where(osm.way_allowed(F.col("tags"), F.array(F.lit(1)))).select("c_custkey")


def osm_node_filter(s: SparkSession, d: str) -> DataFrame:
    return _tagged(s, d).where(osm.node_allowed(F.col("tags"))).select("c_custkey")


def area_routing(s: SparkSession, d: str) -> DataFrame:
    return osm.area_rows(table(s, d, "osm_areas")).select("area_id", "sort", F.col("names")[0]["name"].alias("name"), "admin_level", "population", "timezone", "country_code")


def address_extract(s: SparkSession, d: str) -> DataFrame:
    h = table(s, d, "house_coordinates")
    tags = F.create_map(F.lit("addr:street"), F.when(F.col("house_id") % 3 != 0, F.col("street")), F.lit("addr:place"), F.col("street"), F.lit("addr:housenumber"), F.col("house_number"))
    return osm.addresses(h.select(F.col("house_id").alias("id"), "lat_e7", "lng_e7", tags.alias("tags"))).select("id", "street", "house_number")


def multi_name_explode(s: SparkSession, d: str) -> DataFrame:
    names = table(s, d, "osm_nodes").select("id", "version", F.posexplode(osm.names(F.col("tags"))).alias("pos", "n"))
    return names.select("id", "version", "pos", F.col("n.name").alias("name"), F.col("n.lang").alias("lang"))


def category_rules(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "osm_nodes").select("id", "version", category(F.col("tags")).alias("category"))


def place_extract(s: SparkSession, d: str) -> DataFrame:
    p = osm.places(table(s, d, "osm_nodes"))
    return p.select("osm_id", F.get("names", F.lit(0))["name"].alias("name"), "category", "population", "is_way")


def way_node_resolution(s: SparkSession, d: str) -> DataFrame:
    """Orders as ways whose nodes are the parts of their lines."""
    ways = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("nodes"))
    nodes = G.placed(s, d, "part", "p_partkey", G.dense).select(F.col("p_partkey").alias("id"), "lat_e7", "lng_e7")
    return osm.located_ways(ways, nodes).select("id", F.size("line").alias("corners"), F.get("line", F.lit(0))["lat_e7"].alias("first_lat"), F.array_max(F.transform("line", lambda p: p["lng_e7"])).alias("max_lng"))


def relation_prefilter(s: SparkSession, d: str) -> DataFrame:
    return osm.wanted_relations(table(s, d, "osm_areas")).select("id")


def format_address_fallback(s: SparkSession, d: str) -> DataFrame:
    hn = F.when(F.col("p_size") % 4 != 0, F.col("p_size").cast("string")).otherwise("")
    return table(s, d, "part").select("p_partkey", fallback_col(hn, F.col("p_name")).alias("address"))


def format_address(s: SparkSession, d: str) -> DataFrame:
    code = F.get(F.array(*[F.lit(c) for c in ("DE", "FR", "US", "GB", "HU", "XX")]), (F.col("p_partkey") % 6).cast("int"))
    a = F.struct(F.col("p_size").cast("string").alias("house_number"), F.col("p_name").alias("road"), F.col("p_brand").alias("city"), F.lit("12345").alias("postcode"), code.alias("country_code"))
    return table(s, d, "part").select("p_partkey", address_col(a).alias("address"))


QUERIES = {f.__name__: f for f in (osm_way_filter, osm_node_filter, area_routing, address_extract, multi_name_explode, category_rules, place_extract, way_node_resolution, relation_prefilter, format_address_fallback, format_address)}


def _t(k: str) -> str:
    return f"map_extract(tags, '{k}')[1]"


#: Of the keys that nodes have here, amenity, office and place decide, in this order.
_CASE = (
    f"CASE WHEN {_t('amenity')} IN ('restaurant', 'food_court') THEN 'restaurant_14' WHEN {_t('amenity')} IN ('cafe', 'fast_food', 'bar', 'pub', 'biergarten', 'library', 'theatre') THEN {_t('amenity')} || '_16' "
    f"WHEN {_t('amenity')} IN ('ice_cream', 'community_centre', 'vehicle_inspection') THEN {_t('amenity')} || '_14' WHEN {_t('amenity')} = 'driving_school' THEN 'shop_other_16' WHEN length({_t('office')}) > 0 THEN 'office_16' "
    f"WHEN {_t('place')} = 'city' THEN 'place_6' WHEN {_t('place')} IN ('town', 'village', 'hamlet', 'suburb', 'quarter', 'neighbourhood', 'locality', 'isolated_dwelling', 'farm', 'island', 'islet', 'square', 'country', 'state', 'region', 'province', 'district', 'county', "
    f"'subdistrict', 'municipality', 'borough', 'city_block', 'plot', 'allotments', 'continent', 'archipelago', 'polder', 'sea', 'ocean') THEN {_t('place')} ELSE 'none' END"
)


_POP = f"coalesce(try_cast(regexp_extract({_t('population')}, '^\\s*(\\d{{1,18}})', 1) AS BIGINT), 0) // 200 * 200"
_LEVEL = f"try_cast(trim({_t('admin_level')}) AS INT)"
SQL = {
    "osm_way_filter": f"SELECT c_custkey FROM customer WHERE c_custkey % {len(_TAGS)} IN {_WAY_KEEPS}",
    "osm_node_filter": f"SELECT c_custkey FROM customer WHERE c_custkey % {len(_TAGS)} IN {_NODE_KEEPS}",
    "area_routing": (
        f"WITH a AS (SELECT id, tags FROM osm_areas WHERE ({_t('timezone')} IS NOT NULL OR {_t('boundary')} IS NOT NULL) AND len(list_filter(polygons, lambda p: len(p.\"outer\") >= 3)) > 0), "
        f"z AS (SELECT *, {_t('timezone')} IS NOT NULL AND {_t('admin_level')} IS NULL AS zone FROM a) "
        f"SELECT id AS area_id, 'timezone' AS sort, {_t('timezone')} AS name, 13 AS admin_level, 0::BIGINT AS population, {_t('timezone')} AS timezone, NULL AS country_code FROM z WHERE zone "
        f"UNION ALL SELECT id, 'admin', string_split({_t('name')}, ';')[1], {_LEVEL}, coalesce(try_cast(replace(replace(regexp_extract({_t('population')}, '(\\d[\\d. ]*)', 1), '.', ''), ' ', '') AS BIGINT), 0) // 200 * 200, {_t('timezone')}, CASE WHEN len({_t('ISO3166-1')}) >= 2 THEN left({_t('ISO3166-1')}, 2) END FROM z WHERE NOT zone AND {_t('name')} IS NOT NULL AND coalesce({_t('boundary')}, 'administrative') = 'administrative' AND {_LEVEL} BETWEEN 2 AND 11 "
        f"UNION ALL SELECT id, 'postal', {_t('postal_code')}, 12, 0, NULL, NULL FROM z WHERE NOT zone AND {_t('postal_code')} IS NOT NULL"
    ),
    "address_extract": "SELECT house_id AS id, street, house_number FROM house_coordinates WHERE street IS NOT NULL AND house_number IS NOT NULL",
    "multi_name_explode": (
        "WITH v AS (SELECT id, version, list_concat(" + ", ".join(f"coalesce(string_split({_t(k)}, ';'), [])" for k in osm.NAME_TAGS) + ") AS ns FROM osm_nodes) "
        "SELECT id, version, (i - 1)::INT AS pos, ns[i] AS name, 'default' AS lang FROM v, range(1, 200) r(i) WHERE i <= len(ns)"
    ),
    "category_rules": f"SELECT id, version, {_CASE} AS category FROM osm_nodes",
    "place_extract": f"SELECT id AS osm_id, string_split({_t('name')}, ';')[1] AS name, {_CASE} AS category, {_POP} AS population, false AS is_way FROM osm_nodes WHERE {_t('name')} IS NOT NULL",
    "way_node_resolution": f"WITH p AS (SELECT p_partkey, {G.sql_dense('p_partkey', 2003)} FROM part) SELECT l_orderkey AS id, count(*)::INT AS corners, arg_min(lat_e7, (l_linenumber, l_partkey)) AS first_lat, max(lng_e7) AS max_lng FROM lineitem JOIN p ON l_partkey = p_partkey GROUP BY 1",
    "relation_prefilter": f"SELECT id FROM osm_areas WHERE {_t('timezone')} IS NOT NULL OR {_t('boundary')} IN ('postal_code', 'administrative') OR {_t('name')} IS NOT NULL OR {_t('addr:housenumber')} IS NOT NULL",
    "format_address_fallback": "SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN p_size || ' ' || p_name ELSE p_name END AS address FROM part",
    "format_address": (
        "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name || ' ' || p_size || ', 12345 ' || p_brand WHEN 1 THEN p_size || ' ' || p_name || ', 12345 ' || p_brand WHEN 2 THEN p_size || ' ' || p_name || ', ' || p_brand || ', 12345' "
        "WHEN 3 THEN p_size || ' ' || p_name || ', ' || p_brand || ', 12345' WHEN 4 THEN p_brand || ', ' || p_name || ' ' || p_size || ', 12345' ELSE p_size || ' ' || p_name END AS address FROM part"
    ),
}
