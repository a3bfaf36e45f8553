from wayfold.llm.script_forms import look_alikes, printed_form


def test_forms():
    same = [
        ("Café Kora", "Café Kora", "Саfé Kοra", "Café K​ora", "Ｃａｆé　Kora"),
        ("Office 3-5", "Oﬃce 3‑5", "Office 3－5 "),
        ("Парк", "Пaрк"),
        ("HOP", "НОР"),
    ]
    for group in same:
        assert len({printed_form(x) for x in group}) == 1, group
    for a, b in [("Kora", "Кorаk"), ("kora", "кora"), ("Cafe", "Café"), ("Kora", "kora"), ("I1", "l1"), ("Müller", "Muller"), ("A/B", "A-B")]:
        assert printed_form(a) != printed_form(b), (a, b)
    assert printed_form(None) is None and printed_form("") == ""


def test_pairs(spark):
    rows = [("name", 1, "Café"), ("name", 2, "Café"), ("name", 3, "Café"), ("alt_name", 4, "Café"), ("name", 5, None), ("name", 6, ""), ("name", 2, "Café"), ("name", 7, "Cafe")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "tag string, id long, value string, form string")
    got = {tuple(r) for r in look_alikes(df, "tag", "id", "value").collect()}
    assert got == {("name", 1, 2), ("name", 2, 3)}
    assert look_alikes(df.limit(0), "tag", "id", "value").count() == 0


def test_further_scripts_and_numerals():
    from wayfold.llm.script_forms import printed_form

    assert printed_form("ᏴᎪᏞᏞ") == "BALL" and printed_form("Ꮋоtеl") == "Hotel" and printed_form("Οmega") == "Omega"
    assert printed_form("Hеinrich Ⅷ") == "Heinrich VIII" and printed_form("Ĳssel") == "IJssel"
    assert printed_form("հօuse") == printed_form("hоuse") == "house" and printed_form("Hause") != printed_form("House")
