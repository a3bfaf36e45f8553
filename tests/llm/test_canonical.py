from wayfold.llm.canonical import map_to_list

LIST = ["bakery_window", "rowing_club", "salt_cave", "salt_bin", "siren_tower", "tea_house", "record_library", "tool_library"]
CASES = {
    "bakery window": "bakery_window", "BAKERY - WINDOW": "bakery_window", "window, bakery": "bakery_window", "bakery_wind.": "bakery_window",
    "ｒｏｗｉｎｇ_ｃｌｕｂ": "rowing_club", "rwoing clul": "rowing_club", "rowing_club (closed)": "rowing_club", "amenity=tea house": "tea_house",
    "salt_caae": "salt_cave", "siren_ttowei": "siren_tower", "record_libr.": "record_library", "Sirentower": "siren_tower",
    "aquarium": None, "x": None, "???": None, "": None, "bipepuzus": None,
}


def test_map(spark):
    values = spark.createDataFrame([(v, 1) for v in CASES] * 2 + [(None, 1)], "value string, entry int")
    reference = spark.createDataFrame([(v, "a") for v in LIST] + [(LIST[0], "b"), (None, "c")], "value string, typed string")
    got = {r.typed: r.entry for r in map_to_list(values, reference).collect()}
    assert got == CASES


def test_empty(spark):
    values = spark.createDataFrame([("a",)], "value string")
    assert [r.entry for r in map_to_list(values, values.limit(0)).collect()] == [None]
    assert map_to_list(values.limit(0), values).count() == 0
    long = spark.createDataFrame([("ab " * 20000,)], "value string")
    assert map_to_list(long, values).count() == 1


def test_large_lists_are_joined_by_shuffle(spark, monkeypatch):
    from wayfold.llm import canonical

    values = spark.createDataFrame([(v,) for v in ("libary", "tea hosue", "zzz", None, "library")], "value string")
    listed = spark.createDataFrame([("library",), ("tea_house",), ("bakery",), (None,)], "value string")
    small = set(map(tuple, canonical.map_to_list(values, listed).collect()))
    monkeypatch.setattr(canonical, "BROADCAST_ENTRIES", 0)
    assert set(map(tuple, canonical.map_to_list(values, listed).collect())) == small
    assert {(r[0], r[1]) for r in small} == {("libary", "library"), ("tea hosue", "tea_house"), ("zzz", None), ("library", "library")}
