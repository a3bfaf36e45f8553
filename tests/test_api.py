import pytest

from tests.test_sources import XML
from wayfold.api import Geocoder
from wayfold.sources import osm_xml
from wayfold.streaming.geocode import geocode_stream


def test_build_write_open_ask(spark, tmp_path):
    p = str(tmp_path / "m.osm")
    open(p, "w").write(XML)
    Geocoder.build(osm_xml.nodes(spark, p), osm_xml.ways(spark, p), osm_xml.relations(spark, p)).write(str(tmp_path / "db"))
    g = Geocoder.open(spark, str(tmp_path / "db"))
    q = spark.createDataFrame([(1, "Славейков 26"), (2, "Индже войвода"), (3, "x")], "query_id long, text string")
    top = {r.query_id: r for r in g.formatted(g.suggest(q, 1)).collect()}
    assert top[1].description == "ж.к. П. Р. Славейков бл. 26, Бургас" and top[1].address == "бл. 26 ж.к. П. Р. Славейков"
    assert top[2].name == "Индже войвода" and top[2].city == "Бургас" and 3 not in top
    pts = spark.createDataFrame([(1, 42.5101, 27.4101), (2, 0.0, 0.0)], "point_id long, lat double, lng double")
    # the street is over a kilometre away, but its bounding box meets that of the point
    assert [(r.kind, r.rank) for r in g.reverse(pts).orderBy("rank").collect()] == [("place", 1), ("street", 2)]
    assert {r.point_id: len(r.areas) for r in g.areas(pts).collect()} == {1: 1, 2: 0}
    assert {r.part: r.n for r in g.stats().collect()}["areas"] == 1 and g.verify().count() == 0

    q.write.parquet(str(tmp_path / "asked"))
    stream = spark.readStream.schema("query_id long, text string").parquet(str(tmp_path / "asked"))
    geocode_stream(stream, g.db, str(tmp_path / "out"), str(tmp_path / "state"), n=1).awaitTermination(120)
    assert {r.query_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1, 2}


def test_features_keep_apart(spark):
    """Way 7 and relation 7, ids over 31 bits, and a house with the id 65535."""
    tags = "map<string,string>"
    big = 12_000_000_000
    nodes = [(i, 500000000 + dy * 10000, 80000000 + dx * 10000, {}) for i, (dy, dx) in enumerate(((0, 0), (0, 9), (9, 9), (9, 0)), 1)]
    nodes += [(65535, 500001000, 80001000, {"addr:street": "Main", "addr:housenumber": "12"}), (big, 500002000, 80001000, {"addr:street": "Main", "addr:housenumber": "14"}), (7, 500003000, 80003000, {"name": "Node"})]
    ways = [(7, [1, 2, 3, 4, 1], {"name": "Seven Park", "leisure": "park"}), (8, [1, 2], {"highway": "road", "name": "Main"})]
    relations = [(7, [{"type": "way", "ref": 7, "role": "outer"}], {"name": "Seven Site", "type": "multipolygon"})]
    g = Geocoder.build(
        spark.createDataFrame(nodes, f"id long, lat_e7 int, lng_e7 int, tags {tags}"), spark.createDataFrame(ways, f"id long, nodes array<long>, tags {tags}"),
        spark.createDataFrame(relations, f"id long, members array<struct<type:string,ref:long,role:string>>, tags {tags}"),
    )
    assert g.db.places.count() == 3
    q = spark.createDataFrame([(1, "Seven Park"), (2, "Seven Site"), (3, "Main 12"), (4, "Main 14")], "query_id long, text string")
    top = {r.query_id: r for r in g.suggest(q, 1).collect()}
    assert {k: (r.name, r.osm_id, r.osm_type) for k, r in top.items()} == {1: ("Seven Park", 7, "way"), 2: ("Seven Site", 7, "relation"), 3: ("Main", 65535, "node"), 4: ("Main", big, "node")}
    # a number counts whatever the id is: 5 for the house, 2.5 for the number itself
    assert top[3].score == top[4].score and top[3].house_number == "12"
    pts = spark.createDataFrame([(1, 50.00011, 8.00011)], "point_id long, lat double, lng double")
    near = {r.kind: r for r in g.reverse(pts).where("rank <= 5").orderBy("rank").collect()}
    assert near["street"].name == "Main" and near["street"].lat == pytest.approx(50.0, abs=1e-6) and near["street"].lng == pytest.approx(8.00011, abs=1e-6)
    assert near["house"].name == "Main" and near["house"].osm_type == "node"
