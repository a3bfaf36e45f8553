from wayfold.operators.multi_value import explode_values

CASES = [
    ('"Ladiloke; Plachojani"|Café X', ["Ladiloke; Plachojani", "Café X"]),
    ('"A ""B"" C"; D', ['A "B" C', "D"]),
    ("“Weinstube H”|«G; W»|Atelier 1,5", ["Weinstube H", "G; W", "Atelier 1,5"]),
    ("A/B; C / D, E", ["A/B", "C", "D", "E"]),
    (" ;A;  ;B; ", ["A", "B"]),
    ("A|A", ["A", "A"]),
    ("A • ;B¦C\nD", ["A", "B", "C", "D"]),
    ('Inn "Zum; Hirsch" Nord; X', ['Inn "Zum; Hirsch" Nord', "X"]),
    ('5" pipe; other', ['5" pipe', "other"]),
    ('""', []),
    ("", []),
    (";;", []),
    ("Stodabiher's; D'Or", ["Stodabiher's", "D'Or"]),
]


def test_split(spark):
    df = spark.createDataFrame([(i, v, "clash") for i, (v, _) in enumerate(CASES)] + [(999, None, None)], "id long, name string, value string")
    got = {}
    for r in explode_values(df, ["id"], ["name"]).collect():
        got.setdefault(r.id, []).append((r.pos, r.value))
    for i, (_, want) in enumerate(CASES):
        assert [v for _, v in sorted(got.get(i, []))] == want, CASES[i]
        assert [p for p, _ in sorted(got.get(i, []))] == list(range(1, len(want) + 1))
    assert 999 not in got


def test_at_least_and_empty(spark):
    df = spark.createDataFrame([(1, "A; B", "C")], "id long, name string, alt_name string")
    assert {(r.tag, r.value) for r in explode_values(df, ["id"], ["name", "alt_name"], at_least=2).collect()} == {("name", "A"), ("name", "B")}
    assert explode_values(df.limit(0), ["id"], ["name"]).count() == 0


def test_long_field(spark):
    df = spark.createDataFrame([(1, ";".join(f'"n{i}, x"' for i in range(20000)))], "id long, name string")
    assert explode_values(df, ["id"], ["name"]).count() == 20000
