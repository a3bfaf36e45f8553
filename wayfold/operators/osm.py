"""Map features to tables: filters, routing, names, addresses, places, areas, and geometry from references.

Inputs are nodes (id, lat_e7, lng_e7, tags), ways (id, nodes, tags), relations (id, members, tags) and assembled areas
(id, from_way, polygons, tags). Everything is a projection or an equi-join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regions import double_area, tidy
from .rules import RULES, Rule, category

# Features that are never imported.
_BOTH = (("information", "board"), ("amenity", "toilets"), ("natural", "wood"), ("leisure", "playground"), ("access", "false"), ("amenity", "taxi"))
_BOTH_KEYS = ("public_transport", "electrified", "railway", "waterway", "tunnel")
_NODES = (("natural", "tree"), ("natural", "tree_stump"), ("emergency", "fire_hydrant"), ("building", "industrial"), ("amenity", "bicycle_rental"))
_NODE_KEYS = ("highway", "traffic_sign")
# Name tags in the order in which they count.
NAME_TAGS = ("name", "old_name", "alt_name", "short_name", "official_name")
NAME_PREFIXES = ("name:", "short_name:", "alt_name:", "official_name:")


def _none_of(tags: Column, pairs: tuple, keys: tuple) -> Column:
    out = F.lit(True)
    for k, v in pairs:
        out = out & ~F.coalesce(tags[k] == v, F.lit(False))
    for k in keys:
        out = out & ~F.coalesce(F.map_contains_key(tags, F.lit(k)), F.lit(False))
    return out


def way_allowed(tags: Column, nodes: Column) -> Column:
    return (F.coalesce(F.size(nodes), F.lit(0)) > 0) & _none_of(tags, _BOTH, _BOTH_KEYS)


def node_allowed(tags: Column) -> Column:
    return _none_of(tags, _BOTH + _NODES, _BOTH_KEYS + _NODE_KEYS)


def names(tags: Column) -> Column:
    """Names as array<struct<name, lang>>: the plain name tags in order, then those with a language; ';' divides names."""
    split = lambda v, lang: F.transform(F.split(v, ";"), lambda n: F.struct(n.alias("name"), lang.alias("lang")))
    none = F.array().cast("array<struct<name:string,lang:string>>")
    plain = [F.when(tags[t].isNotNull(), split(tags[t], F.lit("default"))).otherwise(none) for t in NAME_TAGS]
    entries = F.array_sort(F.map_entries(tags))
    def of_prefix(p: str) -> Column:
        found = F.filter(entries, lambda e: e["key"].startswith(p))
        return F.flatten(F.transform(found, lambda e: split(e["value"], F.substring(e["key"], F.lit(len(p) + 1), F.length(e["key"])))))

    prefixed = [of_prefix(p) for p in NAME_PREFIXES]
    return F.when(tags.isNotNull(), F.concat(*plain, *prefixed)).otherwise(none)


#: Sorts of map features, as they stand in the numbers below.
NODE, WAY, RELATION = range(3)


def feature_number(osm_id: Column, element: Column) -> Column:
    """One number for a feature; nodes, ways and relations with the same OSM id keep apart."""
    return osm_id.cast("long") * 4 + element


def osm_id_of(number: Column) -> Column:
    return F.call_function("shiftright", number, F.lit(2))


def element_of(number: Column) -> Column:
    return F.get(F.array(F.lit("node"), F.lit("way"), F.lit("relation")), number.bitwiseAND(3).cast("int"))


def addresses(rows: DataFrame) -> DataFrame:
    """(id, street, house_number, lat_e7, lng_e7): features with a number and a street, or else a named place."""
    t = F.col("tags")
    return rows.select("id", F.coalesce(t["addr:street"], t["addr:place"]).alias("street"), t["addr:housenumber"].alias("house_number"), "lat_e7", "lng_e7").where("house_number IS NOT NULL AND street IS NOT NULL")


def places(rows: DataFrame, is_way: bool = False, rules: list[Rule] = RULES) -> DataFrame:
    """(osm_id, names, category, population, is_way, lat_e7, lng_e7) of named features."""
    t = F.col("tags")
    population = F.coalesce(F.expr("try_cast(regexp_extract(tags['population'], '^\\\\s*(\\\\d{1,18})', 1) AS bigint)"), F.lit(0))
    return rows.where(t["name"].isNotNull()).select(F.col("id").alias("osm_id"), names(t).alias("names"), category(t, rules).alias("category"), (F.floor(population / 200) * 200).cast("long").alias("population"), F.lit(is_way).alias("is_way"), "lat_e7", "lng_e7")


def street_ways(ways: DataFrame) -> DataFrame:
    """(way_id, name, lat_e7, lng_e7, line) of ways with a highway tag and a name, placed at their first node."""
    t = F.col("tags")
    return ways.where(F.map_contains_key(t, F.lit("highway")) & t["name"].isNotNull()).select(F.col("id").alias("way_id"), t["name"].alias("name"), F.get("line", F.lit(0))["lat_e7"].alias("lat_e7"), F.get("line", F.lit(0))["lng_e7"].alias("lng_e7"), "line")


def located_ways(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways with ``line``, the places of their nodes in order; unknown nodes are passed over, ways without any dropped."""
    refs = ways.select("id", F.posexplode("nodes").alias("i", "ref"))
    spots = refs.join(nodes.select(F.col("id").alias("ref"), "lat_e7", "lng_e7"), "ref")
    lines = spots.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "lat_e7", "lng_e7"))), lambda p: F.struct(p["lat_e7"].alias("lat_e7"), p["lng_e7"].alias("lng_e7"))).alias("line"))
    return ways.join(lines, "id")


def wanted_relations(relations: DataFrame) -> DataFrame:
    """Relations that may become areas."""
    t = F.col("tags")
    return relations.where(t["timezone"].isNotNull() | t["boundary"].isin("postal_code", "administrative") | t["name"].isNotNull() | t["addr:housenumber"].isNotNull())


def area_rows(areas: DataFrame) -> DataFrame:
    """(area_id, from_way, sort, names, admin_level, population, timezone, country_code, polygons) of boundary areas.

    ``sort`` is admin, postal or timezone; one feature may be both admin and postal. Areas without an outline are dropped.
    """
    t = F.col("tags")
    level = F.expr("try_cast(trim(tags['admin_level']) AS int)")
    outline = F.exists("polygons", lambda p: F.size(p["outer"]) >= 3)
    zone = t["timezone"].isNotNull() & t["admin_level"].isNull()
    admin = ~zone & t["admin_level"].isNotNull() & t["name"].isNotNull() & (t["boundary"].isNull() | (t["boundary"] == "administrative")) & level.between(2, 11)
    postal = ~zone & t["postal_code"].isNotNull()
    only = lambda v: F.array(F.struct(v.alias("name"), F.lit("default").alias("lang")))
    pop = F.coalesce(F.expr("try_cast(regexp_replace(regexp_extract(tags['population'], '(\\\\d[\\\\d. ]*)', 1), '[. ]', '') AS bigint)"), F.lit(0))
    none = F.lit(None).cast("string")
    def kind(sort: str, test: Column, shown: Column, at: Column, people: Column, tz: Column, cc: Column) -> Column:
        return F.when(test, F.struct(F.lit(sort).alias("sort"), shown.alias("names"), at.cast("int").alias("admin_level"), people.cast("long").alias("population"), tz.alias("timezone"), cc.alias("country_code")))

    country = F.when(F.length(t["ISO3166-1"]) >= 2, F.substring(t["ISO3166-1"], 1, 2))
    sorts = F.array_compact(F.array(
        kind("timezone", zone, only(t["timezone"]), F.lit(13), F.lit(0), t["timezone"], none),
        kind("admin", admin, names(t), level, F.floor(pop / 200) * 200, t["timezone"], country),
        kind("postal", postal, only(t["postal_code"]), F.lit(12), F.lit(0), none, none),
    ))
    rows = areas.where((t["timezone"].isNotNull() | t["boundary"].isNotNull()) & F.coalesce(outline, F.lit(False)))
    way = F.col("from_way") if "from_way" in areas.columns else F.lit(False)
    out = rows.select(F.col("id").alias("area_id"), way.alias("from_way"), F.explode(sorts).alias("a"), "polygons")
    return out.select("area_id", "from_way", "a.*", "polygons")


def plain_area_features(areas: DataFrame) -> DataFrame:
    """Areas of relations that are no boundary, as features at the first corner of their first outer ring."""
    t = F.col("tags")
    first = F.get(F.get("polygons", F.lit(0))["outer"], F.lit(0))
    return areas.where(t["timezone"].isNull() & t["boundary"].isNull() & ~F.col("from_way")).select("id", first["lat_e7"].alias("lat_e7"), first["lng_e7"].alias("lng_e7"), "tags")


def stitched(lines: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Closed rings from pieces that meet at their ends; what does not close is left out.

    Every end that no other piece goes on from is pruned first, so a wrong way at a junction can't end in nothing. Walking
    on, a ring is closed off as soon as the walk comes to a place it has been at, so rings that touch come out apart.
    """
    pieces = {i: p for i, p in enumerate(lines) if len(p) > 1}
    ends: dict[tuple[int, int], set[int]] = {}
    for i, p in pieces.items():
        if p[0] != p[-1]:
            for e in (p[0], p[-1]):
                ends.setdefault(e, set()).add(i)
    loose = [e for e, at in ends.items() if len(at) == 1]
    while loose:
        e = loose.pop()
        for i in list(ends[e]):
            if len(ends[e]) > 1:
                break
            for other in (pieces[i][0], pieces[i][-1]):
                ends[other].discard(i)
                if len(ends[other]) == 1:
                    loose.append(other)
            del pieces[i]
    rings = [p for p in pieces.values() if p[0] == p[-1]]
    for i in sorted(pieces):
        at = pieces[i][0]
        while i in ends.get(at, ()):
            path: list[list[tuple[int, int]]] = []  # pieces walked, each in the direction of the walk
            been = {at: 0}
            while ends[at]:
                n = min(ends[at])
                path.append(pieces[n] if pieces[n][0] == at else pieces[n][::-1])
                for e in (pieces[n][0], pieces[n][-1]):
                    ends[e].discard(n)
                at = path[-1][-1]
                k = been.setdefault(at, len(path))
                if k < len(path):
                    ring = [q for part in path[k:] for q in part[:-1]]
                    rings.append([*ring, ring[0]])
                    for part in path[k:]:
                        been.pop(part[-1], None)
                    been[at] = k
                    del path[k:]
            at = pieces[i][0]
    return [r for r in rings if len(r) > 3]


def _within(ring: list[tuple[int, int]], p: tuple[int, int]) -> bool:
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > p[1]) != (y2 > p[1]) and p[0] < x1 + (p[1] - y1) * (x2 - x1) / (y2 - y1):
            odd = not odd
    return odd


def nested(rings: list[list[tuple[int, int]]]) -> list[tuple[list[tuple[int, int]], list[list[tuple[int, int]]]]]:
    """(outer ring, its holes): a ring inside an odd number of others is a hole of the smallest of them, whatever its role."""
    boxes = [(min(x for x, _ in r), min(y for _, y in r), max(x for x, _ in r), max(y for _, y in r)) for r in rings]
    sizes = [abs(double_area(r)) for r in rings]
    corners = [set(r) for r in rings]
    around: list[list[int]] = []
    for i, r in enumerate(rings):
        a = boxes[i]
        found = []
        for j, b in enumerate(boxes):
            if i != j and sizes[j] > sizes[i] and b[0] <= a[0] and b[1] <= a[1] and b[2] >= a[2] and b[3] >= a[3]:
                free = next((p for p in r if p not in corners[j]), None)  # a corner that both have says nothing
                if free is not None and _within(rings[j], free):
                    found.append(j)
        around.append(found)
    outer = {i: [] for i in range(len(rings)) if len(around[i]) % 2 == 0}
    for i, found in enumerate(around):
        if i not in outer:
            outer[min((j for j in found if j in outer), key=lambda j: sizes[j])].append(rings[i])
    return [(rings[i], holes) for i, holes in outer.items()]


POLYGONS = "array<struct<outer:array<struct<lat_e7:int,lng_e7:int>>,inners:array<array<struct<lat_e7:int,lng_e7:int>>>>>"


def assembled(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """(id, polygons, tags): rings stitched from the relation's ways (with ``line``), holes given to the smallest ring around them.

    Which rings are holes is seen from how they lie; roles are often missing or wrong.
    """
    parts = relations.select("id", F.posexplode("members").alias("i", "m")).where("m.type = 'way'").select("id", "i", "m.ref", "m.role")
    lined = parts.join(ways.select(F.col("id").alias("ref"), "line"), "ref")
    rings = lined.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "role", "line"))).alias("parts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for own in b["parts"]:
                lines = [[(q["lng_e7"], q["lat_e7"]) for q in p["line"]] for p in own]
                rings = [r for r in map(tidy, stitched(lines)) if r]
                shape = lambda r: [{"lat_e7": y, "lng_e7": x} for x, y in r]
                out.append([{"outer": shape(o), "inners": [shape(r) for r in h]} for o, h in nested(rings)])
            yield pd.DataFrame({"id": b["id"], "polygons": out})

    shapes = rings.mapInPandas(run, f"id long, polygons {POLYGONS}").where(F.size("polygons") > 0)
    return shapes.join(relations.select("id", "tags"), "id")


def closed_way_areas(ways: DataFrame) -> DataFrame:
    """(id, from_way, polygons, tags) of closed ways."""
    line = F.col("line")
    closed = (F.size(line) > 3) & (F.get(line, F.lit(0)) == F.try_element_at(line, F.lit(-1)))
    one = F.array(F.struct(line.alias("outer"), F.array().cast("array<array<struct<lat_e7:int,lng_e7:int>>>").alias("inners")))
    return ways.where(closed).select("id", F.lit(True).alias("from_way"), one.alias("polygons"), "tags")
