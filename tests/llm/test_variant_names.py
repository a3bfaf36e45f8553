import math
import random
from itertools import combinations, permutations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wayfold.llm import variant_names
from wayfold.llm.variant_names import assigned, edits, links, name_words, similarity


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_edits():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9))) for _ in range(400)]
    a, b = words[:200], words[200:]
    assert edits(a, b).tolist() == [osa(x, y) for x, y in zip(a, b)]
    assert edits([], []).tolist() == []


ROWS = [
    (1, "vet", "X", ["Nechikajek Elisabeth Vet Clinic", "Fugebesim Forum"]), (2, "vet", "X", ["Vet Clinic Dr. Lisa Nechikajek"]), (3, "vet", None, ["NECHIAKJEK, E."]),
    (4, "vet", "X", ["Nechikajek, William"]), (5, "lawyer", "X", ["Nechikajek, Elisabeth"]), (6, "vet", "Y", ["Elisabeth Nechikajek"]),
    (10, "surveyor", "Z", ["Lakrasteper & Driklomuril Survey Co. GmbH"]), (11, "surveyor", "Z", ["DRIKLOMURIL-LAKRASTPER SURVEY COMPANY"]), (12, "surveyor", None, ["Lakrasteper u. Driklomuril", None]),
    (13, "surveyor", "Z", ["Dr U. Lakrasteper"]), (20, "tax", None, ["Fugebesim Forum"]), (21, "tax", None, ["Fugebesim Forum"]), (22, "tax", None, []), (23, "tax", None, None),
    (30, "tax", "Q", ["Mödodroklu, Käthe"]), (31, "tax", "Q", ["Katharina Moedodroklu, Tax Adv."]), (33, "tax", "Q", ["Tax Advisory K. Mödodroklu"]), (34, "tax", "W", ["Tax Adv. U. Janomischus"]), (35, "tax", None, ["Ursulinu Janomischus"]), (None, "tax", "Q", ["Katharina Moedodroklu"]), (32, None, "Q", ["Katharina Moedodroklu"]),
]


def test_links(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "id long, office string, city string, names array<string>, n int")
    got = {tuple(r) for r in links(df, "office", "id", "city", "names").collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (3, 6), (10, 11), (10, 12), (11, 12), (30, 31), (30, 33), (31, 33), (34, 35)}
    assert links(df.limit(0), "office", "id", "city", "names").count() == 0


def test_frequent_surname_loses_no_pair(spark):
    """A surname held by a third of all names: the links are those of all pairs compared."""
    rnd = random.Random(4)
    word = lambda k: "".join(rnd.choice("bcdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(k))
    given = [word(4) for _ in range(70)]
    whole = [(w, "schmidt") for w in given] + [(rnd.choice(given), word(5)) for _ in range(140)]
    whole += [("anastasia", "schmidt"), ("a", "schmidt"), ("alexander", "schmidt"), ("allexander", "schmidt"), ("alexandre", "schmdit"), ("a", "schmid"), (given[0][0], "schmidt"), (given[1][:-1], "schmitt")]
    whole += [("alexander", word(5)) for _ in range(75)]
    df = spark.createDataFrame([(i, "vet", "X", [" ".join(w)]) for i, w in enumerate(whole)], "id long, office string, city string, names array<string>")
    got = {tuple(r) for r in links(df, "office", "id", "city", "names").collect()}

    words = [sorted(w) for w in whole]
    held: dict[str, int] = {}
    for w in {tuple(w) for w in words}:
        for v in set(w):
            held[v] = held.get(v, 0) + 1
    total = len({tuple(w) for w in words})
    assert held["schmidt"] > total / 4 and held["alexander"] > held["schmidt"]
    weight = {v: math.log1p(total / n) for v, n in held.items()}
    want = set()
    for j in range(len(words)):
        for i in range(j):
            cost = {(p, q): osa(p, q) for p in words[i] for q in words[j]}
            d, score, least = similarity(words[i], words[j], weight, cost)
            if d <= 4 and score >= 0.7 and least >= 0.5:
                want.add((i, j))
    assert (210, 211) in want and (212, 213) in want
    assert got == want


MORE = [
    ("Anna Maria Schmidt", "Anna Schmidt", True), ("Karl-Heinz Mueller", "Karlheinz Mueller", True), ("Enginering Bureau Lena Holzapfel", "Engineering Bureau Lena Holzapfel", True),
    ("Adler Berger Conradi Drechsler Eschenbach", "Adler Berger Conradi Drechsler Eschenbahc", True), ("Anna M. Lindner", "Anna Lindner", True),
    ("Peter Vogelsang", "Vogelsang", False), ("Gustav Wilhelm Tannert", "Gustav Erich Tannert", False), ("Otto Paul Emil Zander", "Otto Zander", True),
    ("Donau" * 12 + " Kessler", "Donau" * 11 + "Donua Kessler", True),
]


def test_unequal_numbers_of_words(spark):
    rows = [(10 * i + k, "tax", f"C{i}", [n]) for i, (a, b, _) in enumerate(MORE) for k, n in enumerate((a, b))]
    df = spark.createDataFrame(rows, "id long, office string, city string, names array<string>")
    got = {tuple(r) for r in links(df, "office", "id", "city", "names").collect()}
    assert got == {(10 * i, 10 * i + 1) for i, (*_, same) in enumerate(MORE) if same}


def test_assignment():
    rnd = random.Random(7)
    for _ in range(200):
        n = rnd.randint(1, 5)
        cost = [[rnd.randint(0, 9) for _ in range(n + 1)] for _ in range(n)]
        got = assigned(cost)
        assert len(set(got)) == n
        assert sum(cost[i][j] for i, j in enumerate(got)) == min(sum(cost[i][j] for i, j in enumerate(o)) for o in permutations(range(n + 1), n))


def misspelt(rnd, w, many):
    """``w`` with so many slips, none in the first letter."""
    for _ in range(many):
        i, c = rnd.randint(1, max(1, len(w) - 2)), rnd.choice("bdfgklmnprst")
        w = rnd.choice((w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]))
    return w


def test_links_are_those_of_all_pairs(spark):
    """Slips in every word, initials, unequal numbers of words, words written as one, single words: nothing is lost for want of a candidate."""
    rnd = random.Random(12)
    word = lambda start, k: rnd.choice(start) + "".join(rnd.choice("aeiou") + rnd.choice("bdfgklmnprst") for _ in range(k))
    given, family = [*(word("aeiou", rnd.randint(1, 4)) for _ in range(6)), "johann", "peter"], [word("bdfgklmnprst", rnd.randint(2, 5)) for _ in range(10)]
    texts = []
    for _ in range(420):
        a, b, c = rnd.choice(given), rnd.choice(given), rnd.choice(family)
        words = rnd.choice(([a, c], [a, c], [a, c], [a[0] if a[0] in "aeiou" else a, c], [a, b, c], [a + b, c], [c], [a + c], [f"{'hans' if a == 'johann' else a}{b}", c], [a, b]))
        texts.append(" ".join(misspelt(rnd, w, rnd.choice((0, 0, 0, 1, 1, 2))) if len(w) > 3 else w for w in words))
    places = [rnd.choice((None, "X", "Y")) for _ in texts]
    df = spark.createDataFrame([(i, "vet", p, [t]) for i, (t, p) in enumerate(zip(texts, places))], "id long, office string, city string, names array<string>")
    got = {tuple(r) for r in links(df, "office", "id", "city", "names").collect()}

    words = [list(r[0]) for r in df.orderBy("id").select(name_words(F.col("names")[0])).collect()]
    distinct = {tuple(w) for w in words}
    held: dict[str, int] = {}
    for w in distinct:
        for v in set(w):
            held[v] = held.get(v, 0) + 1
    weight = {v: math.log1p(len(distinct) / n) for v, n in held.items()}
    pairs = list(combinations(range(len(words)), 2))
    side = lambda k: [words[p[k]] for p in pairs]
    table = pd.DataFrame({"na": [i for i, _ in pairs], "nb": [j for _, j in pairs], "a": side(0), "b": side(1), "wa": [[weight[v] for v in w] for w in side(0)], "wb": [[weight[v] for v in w] for w in side(1)]})
    want = set()
    for r in next(variant_names._verified(iter([table]))).itertuples():
        p, q = places[r.na], places[r.nb]
        if r.score >= 0.7 and r.least >= 0.5 and r.edits <= (3 if p is None or q is None else 4 if p == q else -1):
            want.add((r.na, r.nb))
    assert len(want) > 400 and sum(len(words[i]) != len(words[j]) for i, j in want) > 20
    assert got == want


def test_keys_and_letters_lose_no_pair():
    rnd = random.Random(3)
    far = 0
    for _ in range(20_000):
        w = "".join(rnd.choice("abcdefgx1") for _ in range(rnd.randint(2, 13)))
        v = w
        for _ in range(rnd.randint(0, 4)):
            i = rnd.randint(0, len(v))
            v = rnd.choice((v[:i] + rnd.choice("abcdefgx1") + v[i + 1 :], v[:i] + v[i + 1 :], v[:i] + rnd.choice("abcdefgx1") + v[i:], v[:i] + v[i : i + 2][::-1] + v[i + 2 :]))
        d = int(edits([w], [v])[0])
        x, y = (np.array([variant_names.letter_bits(t)]).view(np.uint64) for t in (w, v))
        assert max(np.bitwise_count(x & ~y)[0], np.bitwise_count(y & ~x)[0]) <= d
        if d <= 1 and len(v) > 1:
            assert variant_names.word_keys(w) & variant_names.word_keys(v)
        if d <= 3:
            far += d == 3
            assert variant_names.half_keys(w) & variant_names.half_keys(v)
        if d <= 2 and len(v) > 3:
            i = rnd.randint(2, len(v) - 2)
            assert any(variant_names.word_keys(t) & variant_names.piece_keys(w) for t in (v[:i], v[i:]))
    assert far > 1000


def test_candidates_stay_few(spark):
    """Names that are not alike draw no candidates, however often their given name occurs or their trigrams meet."""
    rnd = random.Random(5)
    given = ["valentina", "wilhelmina", "theodora", "ottokar", "konstantin"]
    family = {"".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(5)) for _ in range(5000)}
    rows = [(i, "vet", None if i % 8 == 0 else f"P{i % 40}", [f"{given[i % 5]} {w}"]) for i, w in enumerate(sorted(family))]
    df = spark.createDataFrame(rows, "id long, office string, city string, names array<string>")
    spelt = df.select(F.col("office").alias("g"), F.col("id").alias("n"), name_words(F.col("names")[0]).alias("words"), F.col("city").isNull().alias("unplaced"), F.array_compact(F.array("city")).alias("places"))
    # 625 names with an unknown place against 5,000 are 3 million pairs, and these words are made of few letters
    assert variant_names.candidates(spelt, 4.0, 3.0).count() < 100_000


def test_large_blocks_in_tiles(spark, monkeypatch):
    """Blocks cut into tiles, or each looked at alone, give the same pairs."""
    rnd = random.Random(6)
    rows = [(i, "vet", rnd.choice((None, "X")), [f"{misspelt(rnd, 'valentina', rnd.randint(0, 1))} {misspelt(rnd, rnd.choice(('holzapfel', 'breitenbach')), rnd.randint(0, 3))}"]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, office string, city string, names array<string>")
    ones = {tuple(r) for r in links(df, "office", "id", "city", "names").collect()}
    monkeypatch.setattr(variant_names, "_TILE", 400)
    assert {tuple(r) for r in links(df, "office", "id", "city", "names").collect()} == ones and len(ones) > 100


def test_two_by_two():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(2, 6)))
    table = pd.DataFrame([(i, -i, [word(), word()], [word(), word()]) for i in range(500)], columns=["na", "nb", "a", "b"])
    weight = {w: rnd.random() * 5 for x in (*table["a"], *table["b"]) for w in x}
    table = table.assign(wa=[[weight[w] for w in x] for x in table["a"]], wb=[[weight[w] for w in x] for x in table["b"]])
    got = next(variant_names._verified(iter([table])))
    for r, g in zip(table.itertuples(), got.itertuples()):
        want = similarity(r.a, r.b, weight, {(p, q): osa(p, q) for p in r.a for q in r.b})
        assert np.allclose((g.edits, g.score, g.least), want)
