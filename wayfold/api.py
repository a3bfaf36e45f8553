"""One object for the whole search: build or open a database, then ask it in batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.lineage import kept
from .operators import enrich, osm
from .operators import forward as W
from .operators import index as I
from .operators import reverse as R
from .operators.address import TEMPLATES, address_col
from .operators.regions import triangles
from .operators.rules import RULES, Rule
from .operators.streets import spread_positions


def _with_osm_id(rows: DataFrame, number: Column) -> DataFrame:
    return rows.withColumn("osm_id", osm.osm_id_of(number)).withColumn("osm_type", osm.element_of(number))


@dataclass
class Geocoder:
    db: W.Database
    area_shapes: DataFrame  # area_id, admin_level, polygons
    area_triangles: DataFrame  # area, x1 .. y3: the shapes cut once
    lines: DataFrame  # entity_id (a street's number), line

    @classmethod
    def build(cls, nodes: DataFrame, ways: DataFrame, relations: DataFrame | None = None, areas: DataFrame | None = None, rules: list[Rule] = RULES) -> Geocoder:
        """From map features: nodes (id, lat_e7, lng_e7, tags), ways (id, nodes, tags) and relations or assembled areas."""
        lined = kept(osm.located_ways(ways, nodes))
        if areas is None:
            closed = osm.closed_way_areas(lined)
            areas = closed if relations is None else closed.unionByName(osm.assembled(osm.wanted_relations(relations), lined).withColumn("from_way", F.lit(False)).select("id", "from_way", "polygons", "tags"))
        attributes = kept(osm.area_rows(areas))
        shapes = attributes.select(F.xxhash64("area_id", "from_way", "sort").alias("area_id"), "admin_level", "polygons")
        about = attributes.select(F.xxhash64("area_id", "from_way", "sort").alias("area_id"), "names", "admin_level", "population", "timezone", "country_code")

        start = F.get("line", F.lit(0))
        features = lined.where(osm.way_allowed(F.col("tags"), F.col("nodes"))).withColumn("lat_e7", start["lat_e7"]).withColumn("lng_e7", start["lng_e7"])
        points = nodes.where(osm.node_allowed(F.col("tags")))
        shape = ["id", "lat_e7", "lng_e7", "tags"]
        outlines = osm.plain_area_features(areas)
        unpaved = features.where(~F.map_contains_key("tags", F.lit("highway")))
        sorts = ((points, osm.NODE), (unpaved, osm.WAY), (outlines, osm.RELATION))
        named = [osm.places(df, element != osm.NODE, rules).withColumn("place_id", osm.feature_number(F.col("osm_id"), F.lit(element))) for df, element in sorts]
        places = kept(named[0].unionByName(named[1]).unionByName(named[2]).dropDuplicates(["place_id"]))
        parts = [osm.addresses(df.select(shape)).withColumn("hn", osm.feature_number(F.col("id"), F.lit(element))) for df, element in ((points, osm.NODE), (features, osm.WAY), (outlines, osm.RELATION))]
        numbered = parts[0].unionByName(parts[1]).unionByName(parts[2]).dropDuplicates(["hn"])
        roads = osm.street_ways(features)
        names = roads.select("name").unionByName(numbered.select(F.col("street").alias("name")))
        streets = kept(I.numbered(names.distinct(), "name", "street_id"))
        spots = spread_positions(roads.select("name", "way_id", "lat_e7", "lng_e7")).join(streets, "name")
        houses = numbered.join(streets.withColumnRenamed("name", "street"), "street")

        shapes = kept(shapes)
        cut = kept(triangles(shapes, "area_id"))

        def within(df: DataFrame, key: Column) -> DataFrame:
            rows = kept(df.withColumn("_key", key))
            sets = enrich.area_sets(rows.select("_key", "lat_e7", "lng_e7"), "_key", shapes, cut)
            return rows.join(sets.select("_key", F.transform("areas", lambda a: a["area_id"]).alias("areas")), "_key").drop("_key")

        db = W.Database(
            within(places, F.col("place_id")).select("place_id", "names", "osm_id", "lat_e7", "lng_e7", "population", "category", "areas"),
            streets.select("street_id", "name"),
            within(spots, F.xxhash64("street_id", "pos")).select("street_id", "pos", "lat_e7", "lng_e7", "areas"),
            within(houses, F.col("hn")).select("street_id", "hn", F.col("house_number").alias("number"), "lat_e7", "lng_e7", "areas"),
            about,
        )
        lines = roads.join(streets, "name").select(F.col("street_id").alias("entity_id"), "line")
        return cls(db.stored(), shapes, cut, kept(lines))

    def write(self, folder: str) -> None:
        self.db.write(folder)
        self.area_shapes.write.mode("overwrite").parquet(f"{folder}/area_shapes")
        self.area_triangles.write.mode("overwrite").parquet(f"{folder}/area_triangles")
        self.lines.write.mode("overwrite").parquet(f"{folder}/lines")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Geocoder:
        return cls(W.Database.read(spark, folder), *[spark.read.parquet(f"{folder}/{t}") for t in ("area_shapes", "area_triangles")], spark.read.parquet(f"{folder}/lines"))

    def suggest(self, queries: DataFrame, n: int = 15, languages: tuple[str, ...] = ("default",), **options: object) -> DataFrame:
        """Ranked suggestions with city, post code, time zone, country, a description, and the OSM id of the place or house."""
        found = W.described(W.enriched(W.suggest(self.db, queries, n, languages, **options), self.db.areas, languages))
        return _with_osm_id(found, F.coalesce("hn", F.when(F.col("kind") == "place", F.col("loc_id"))))

    def explain_suggestions(self, queries: DataFrame, n: int = 15, **options: object) -> DataFrame:
        """Suggestions with every part of their scores."""
        return W.suggest(self.db, queries, n, **options)

    def reverse(self, points: DataFrame, n: int = 10, kinds: W.Kinds = W.Kinds.NONE, languages: tuple[str, ...] = ("default",)) -> DataFrame:
        """Nearest addresses, places and streets of points (point_id, lat, lng): where they are closest (on a street, the place
        of its line), name, number, areas, city, post code, time zone, country, description and OSM id."""
        degrees = lambda df, key: df.select(F.col(key).alias("entity_id"), (F.col("lat_e7") / 1e7).alias("lat"), (F.col("lng_e7") / 1e7).alias("lng"))
        every = kinds == W.Kinds.NONE
        address, place = every or bool(kinds & W.Kinds.ADDRESS), every or bool(kinds & (W.Kinds.PLACE | W.Kinds.EXTRA))
        places = self.db.places.where(W.allowed_col(F.lit(int(kinds)), F.lit("place"), F.col("category")))
        hits = R.lookup(points, degrees(self.db.houses, "hn") if address else None, degrees(places, "place_id") if place else None, self.lines if address else None, n)
        return _with_osm_id(R.described(hits, self.db, languages), F.when(F.col("kind") != "street", F.col("entity_id")))

    def areas(self, points: DataFrame) -> DataFrame:
        """Areas around points (point_id, lat, lng), broad ones first."""
        e7 = points.select("point_id", F.round(F.col("lat") * 1e7).cast("int").alias("lat_e7"), F.round(F.col("lng") * 1e7).cast("int").alias("lng_e7"))
        return enrich.area_sets(e7, "point_id", self.area_shapes, self.area_triangles)

    def formatted(self, suggestions: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
        """Suggestions with a one-line address of their street, number and country, by ``templates`` of countries
        (``sources.templates`` reads a public file of them)."""
        a = F.struct(F.col("house_number"), F.col("name").alias("road"), F.col("country_code"))
        return suggestions.withColumn("address", address_col(a, templates))

    def stats(self) -> DataFrame:
        return I.stats({"strings": self.db.strings, "streets": self.db.streets, "places": self.db.places, "areas": self.db.areas})

    def verify(self) -> DataFrame:
        """Postings whose location does not carry the string; empty if all is well."""
        named = self.db.places.select(F.explode("names.name").alias("value")).unionByName(self.db.streets.select(F.col("name").alias("value")))
        return I.broken_postings(self.db.locations, self.db.strings, named.distinct())
