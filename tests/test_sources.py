import pytest
import struct
import zlib

from pyspark.sql import functions as F

from wayfold.operators import osm
from wayfold.operators.address import format_address
from wayfold.operators.rules import RULES, category, without_shadowed
from wayfold.sources import osm_xml, wiki
from wayfold.sources.osm_pbf import PbfSource

XML = """<?xml version="1.0"?><osm>
<node id="1" lat="42.5" lon="27.4"/><node id="2" lat="42.5" lon="27.5"/><node id="3" lat="42.6" lon="27.5"/><node id="4" lat="42.6" lon="27.4"/>
<node id="9" lat="42.51" lon="27.41"><tag k="place" v="village"/><tag k="name" v="Индже войвода"/><tag k="name:en" v="Indzhe;Voyvoda"/></node>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="residential"/><tag k="name" v="Главна"/></way>
<way id="11"><nd ref="3"/><nd ref="4"/><nd ref="1"/></way>
<way id="12"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="1"/><tag k="building" v="yes"/><tag k="addr:place" v="ж.к. П. Р. Славейков"/><tag k="addr:housenumber" v="бл. 26"/></way>
<relation id="20"><member type="way" ref="10" role="outer"/><member type="way" ref="11" role="outer"/><tag k="boundary" v="administrative"/><tag k="admin_level" v="8"/><tag k="name" v="Бургас"/></relation>
</osm>"""


def test_xml_to_areas(spark, tmp_path):
    p = str(tmp_path / "m.osm")
    open(p, "w").write(XML)
    nodes, ways, relations = osm_xml.nodes(spark, p), osm_xml.ways(spark, p), osm_xml.relations(spark, p)
    assert {(r.id, r.lat_e7) for r in nodes.collect()} == {(1, 425000000), (2, 425000000), (3, 426000000), (4, 426000000), (9, 425100000)}
    lined = osm.located_ways(ways, nodes)
    areas = osm.assembled(osm.wanted_relations(relations), lined).collect()
    assert len(areas) == 1 and len(areas[0].polygons[0].outer) == 4
    rows = osm.area_rows(osm.assembled(relations, lined)).collect()
    assert [(r.area_id, r.sort, r.admin_level, r.names[0].name) for r in rows] == [(20, "admin", 8, "Бургас")]
    place = osm.places(nodes.where(osm.node_allowed(F.col("tags")))).collect()[0]
    assert place.category == "village" and [(n.name, n.lang) for n in place.names] == [("Индже войвода", "default"), ("Indzhe", "en"), ("Voyvoda", "en")]
    flat = lined.where(osm.way_allowed(F.col("tags"), F.col("nodes"))).withColumn("lat_e7", F.col("line")[0]["lat_e7"]).withColumn("lng_e7", F.col("line")[0]["lng_e7"])
    a = osm.addresses(flat).collect()
    assert [(x.street, x.house_number) for x in a] == [("ж.к. П. Р. Славейков", "бл. 26")]
    assert [(w.way_id, w.name) for w in osm.street_ways(lined).collect()] == [(10, "Главна")]
    assert [r.id for r in osm.closed_way_areas(lined).collect()] == [12]


def _v(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def _f(n, v):
    return _v(n << 3) + _v(v) if isinstance(v, int) else _v(n << 3 | 2) + _v(len(v)) + v


def _z(n):
    return (n << 1) ^ (n >> 63) if n >= 0 else ((-n) << 1) - 1


def test_pbf(spark, tmp_path):
    texts = [b"", b"name", "Ö".encode(), b"highway", b"outer"]
    table = b"".join(_f(1, t) for t in texts)
    dense = _f(1, _v(_z(5)) + _v(_z(2))) + _f(8, _v(_z(425000000)) + _v(_z(-1000))) + _f(9, _v(_z(274000000)) + _v(_z(1000))) + _f(10, _v(1) + _v(2) + _v(0) + _v(0))
    way = _f(1, 10) + _f(2, _v(3)) + _f(3, _v(2)) + _f(8, _v(_z(5)) + _v(_z(2)))
    relation = _f(1, 20) + _f(8, _v(4)) + _f(9, _v(_z(10))) + _f(10, _v(1))
    block = _f(1, table) + _f(2, _f(2, dense)) + _f(2, _f(3, way)) + _f(2, _f(4, relation))
    blob = _f(2, len(block)) + _f(3, zlib.compress(block))
    out = b""
    for kind, body in ((b"OSMHeader", _f(1, b"")), (b"OSMData", blob)):
        head = _f(1, kind) + _f(3, len(body))
        out += struct.pack(">I", len(head)) + head + body
    p = tmp_path / "m.osm.pbf"
    p.write_bytes(out)
    spark.dataSource.register(PbfSource)
    read = lambda k: spark.read.format("osm_pbf").option("kind", k).load(str(p)).collect()
    assert [(r.id, r.lat_e7, r.lng_e7, r.tags) for r in read("node")] == [(5, 425000000, 274000000, {"name": "Ö"}), (7, 424999000, 274001000, {})]
    assert [(r.id, r.nodes, r.tags) for r in read("way")] == [(10, [5, 7], {"highway": "Ö"})]
    assert [(r.id, [tuple(m) for m in r.members]) for r in read("relation")] == [(20, [("way", 10, "outer")])]


def test_rules(spark):
    cases = [({"place": "city", "capital": "yes"}, "place_6"), ({"capital": "4", "place": "town"}, "place_capital_8"), ({"shop": "dairy"}, "dairy"), ({"shop": "x"}, "shop_other_16"), ({"entrance": "a", "access": "no"}, "rectdiag"), ({}, "none"), (None, "none"), ({"office": ""}, "none")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, tags map<string,string>")
    assert [r.c for r in df.select("i", category(F.col("tags")).alias("c")).orderBy("i").collect()] == [c for _, c in cases]
    assert "city" not in [n for _, n in without_shadowed(RULES)]
    given = [((("a", "1"),), "x"), ((("a", "1"), ("b", "2")), "y"), ((("c", "1"), ("c", "2")), "z"), ((("d", "*"),), "u"), ((("d", "5"),), "w")]
    assert without_shadowed(given) == [((("a", "1"),), "x"), ((("d", "*"),), "u")]


HTML = """<table class="wikitable"><tr><th>a</th></tr>
<tr><td><a class="mw-file-description" href="/wiki/File:Cafe-16.svg"><img src="/images/thumb/a/ab/Cafe-16.svg/20px-Cafe-16.svg.png" srcset="/images/thumb/a/ab/Cafe-16.svg/40px-Cafe-16.svg.png 2x"></a></td><td>Cafe</td><td><code>amenity=cafe</code> / <code>shop=coffee</code> + <code>x=*</code></td></tr>
<tr><td></td><td>Two words</td><td><span><code>a=b</code></span><br><code>c=d</code></td></tr></table>
<table class="wikitable taginfo-taglist"><tr><th>k</th></tr><tr><td>place</td><td>town</td><td></td><td>A town</td></tr><tr><td>place</td><td>town</td></tr><tr><td>x</td><td>y</td></tr></table>"""


def test_wiki(spark):
    c = wiki.categories(HTML)
    assert [(x["icon"], x["combinations"]) for x in c] == [("Cafe-16", [["amenity=cafe"], ["shop=coffee", "x=*"]]), ("", [["a=b"], ["c=d"]])]
    assert wiki.rules(c)[1] == ((("shop", "coffee"), ("x", "*")), "cafe_16") and wiki.rules(c)[2][1] == "two_words"
    assert [p["icon"] for p in wiki.place_types(HTML)] == ["town"]
    assert wiki.icons(HTML, "https://w.org/wiki/X") == {"cafe_16.svg": "https://w.org/images/a/ab/Cafe-16.svg"}
    pages = spark.createDataFrame([(1, HTML), (2, "<p>none"), (3, None)], "page_id long, html string")
    assert wiki.icon_table(pages, "https://w.org").count() == 1 and wiki.rule_table(pages).count() == 4


def test_addresses():
    fr = dict(house_number="17", road="Rue du Médecin-Colonel Calbairac", neighbourhood="Lafourguette", suburb="Toulouse Ouest", postcode="31000", city="Toulouse", county="Toulouse", state="Midi-Pyrénées", country="France", country_code="FR")
    assert format_address(fr) == "17 Rue du Médecin-Colonel Calbairac, 31000 Toulouse, France"
    for c in ("US", "HU", "XX", None):
        assert format_address({"house_number": "", "road": "Test", "country_code": c}) == "Test"
    assert format_address({}) == ""


def test_rings():
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    a, b = square(0, 0, 10), square(10, 10, 5)  # touch in one corner
    cut = lambda r, n: [r[i : i + n + 1] for i in range(0, len(r) - 1, n)]
    tail = [[(10, 10), (20, 3)], [(20, 3), (21, 3)]]  # leads nowhere
    rings = osm.stitched(tail + cut(a, 1) + cut(b, 2)[::-1] + [square(2, 2, 3)])
    assert sorted(map(sorted, map(set, rings))) == sorted(map(sorted, map(set, (a, b, square(2, 2, 3)))))
    # three junctions with four ends each
    chain = [square(i * 10, i * 10, 10) for i in range(4)]
    rings = osm.stitched([p for r in chain for p in cut(r, 1)])
    assert sorted(map(sorted, map(set, rings))) == sorted(map(sorted, map(set, chain)))
    assert osm.stitched([[(0, 0), (1, 1)], [(1, 1), (2, 0)], [(5, 5)]]) == [] and osm.stitched([]) == []
    found = osm.nested([square(0, 0, 100)[:-1], square(10, 10, 50)[:-1], square(20, 20, 10)[:-1], square(200, 0, 5)[:-1], square(0, 0, 7)[:-1]])
    assert [(o[0], o[2][0] - o[0][0], len(h)) for o, h in found] == [((0, 0), 100, 2), ((20, 20), 10, 0), ((200, 0), 5, 0)]


def test_template_file(tmp_path):
    pytest.importorskip("yaml")
    from wayfold.sources.templates import read_templates

    p = tmp_path / "countries.yaml"
    p.write_text("generic1: &generic1 |\n    {{{road}}} {{{house_number}}}\n    {{{postcode}}} {{#first}} {{{city}}} || {{{county}}} {{/first}}\nplain: text\nDE:\n    address_template: *generic1\nNO:\n    address_template: *generic1\nXY:\n    use_country: DE\n")
    templates = read_templates(str(p))
    assert set(templates) == {"DE", "NO"}
    assert format_address({"road": "Ring", "house_number": "7", "postcode": "1", "county": "K", "country_code": "NO"}, templates) == "Ring 7, 1 K"
    assert format_address({"road": "Ring", "house_number": "7", "country_code": "XY"}, templates) == "7 Ring"
