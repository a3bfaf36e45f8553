import random

import pytest
from pyspark.sql import functions as F

from wayfold.functions import similarity as S
from wayfold.functions import text as X

ODD = ["", " ", "Straße", "Landwehrstraße 12", "ж.к. П. Р. Славейков", "groß-umstadt", "a  b", "12A", "(x) y;z", "hbf", "Éé ü", "𝒳 9a", "-", "a" * 300, None, "Darmstadt, ZOB/Zweifalltorweg - 3"]


def test_goldens():
    assert X.normalize("Landwehrstraße") == "landwehrstrasse" and X.normalize("Й") == "и" and X.normalize("ł") == "ł"
    assert [g.decode() for g in X.byte_ngrams("landwehrstrasse", 3)] == "lan and ndw dwe weh ehr hrs rst str tra ras ass sse".split()
    assert [g.decode() for g in X.byte_ngrams("landwehrstrasse", 2)] == "la an nd dw we eh hr rs st tr ra as ss se".split()
    for b in (b"\xd0\xb8", b"\xd0\xbd", b"la"):
        assert X.decompress_bigram(X.compress_bigram(b)) == b
    assert X.compress_bigram(b"\xd0\xb8") != X.compress_bigram(b"\xd0\xbd")
    assert X.mask_text(X.numeric_mask(["abc", "98", "9a", "0aa"])) == "01100000"
    assert X.mask_text(X.numeric_mask(["hauptstr", "12"])) == "01000000"
    assert [(X.mask_text(b, 2), s) for b, s in X.sorted_phrases(["hauptstr", "12"])] == [("11", "hauptstrasse 12"), ("10", "hauptstrasse"), ("11", "hauptstr 12"), ("10", "hauptstr"), ("01", "12")]
    assert [(X.mask_text(b, 2), s) for b, s in X.sorted_phrases(["darmstadt", "hbf"])] == [("11", "darmstadthauptbahnhof"), ("11", "darmstadt hbf"), ("01", "hauptbahnhof"), ("10", "darmstadt"), ("01", "hbf")]
    assert len(X.sorted_phrases(["hauptbahnhof", "darmstadt", "abc"])) == 9 and len(X.sorted_phrases(list("abcdefgh"))) == 26
    assert X.query_tokens("- groß-umstadt") == ["", "gross umstadt"] and X.dataset_tokens("a-b,c") == ["a", "b", "c"]
    assert X.guess_text("Darmstadt Hbf") == "darmstadt hbfhauptbahnhof"


@pytest.mark.parametrize(
    "f,a,b,want",
    [(S.token_score, "darmstadt", "darmstadt", -8.75), (S.token_score, "darmstadt", "dar", 0.0), (S.token_score, "hauptstrasse", "hauptstrasse 12", 0.75), (S.name_score, "Berliner Allee", "allee", -3.75), (S.name_score, "Darmstadt,ZOB Zweifalltorweg", "darmstadt", -5.0), (S.name_score, "", "a", None), (S.name_score, "abc", "xyz", None)],
)
def test_scores(f, a, b, want):
    assert f(a, b) == want


def test_distance_bounds():
    rnd = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 12))).encode() for _ in range(2))
        d = S.subsequence_distance(a, b)
        assert 0 <= d <= len(a) + len(b) and S.subsequence_distance(a, a) == 0
    assert S.subsequence_distance(b"", b"abc") == 3 and S.subsequence_distance(b"abcd", b"abdc") >= 1


def test_columns_equal_functions(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(ODD)], "i int, s string")
    df, n = df.withColumn("norm", X.normalize_col(F.col("s"))), F.col("norm")
    cols = {
        "erased": X.erase_fillers_col(F.col("s")), "q": X.query_tokens_col(F.col("s"), n), "d": X.dataset_tokens_col(n), "syn": X.synonym_col(n),
        "b2": X.byte_ngrams_col(n, 2), "b3": X.byte_ngrams_col(n, 3), "slug": X.slug_col(F.col("s")), "stored": X.stored_bigrams_col(n),
    }
    rows = df.select("i", "s", "norm", *[c.alias(k) for k, c in cols.items()]).withColumn("mask", X.numeric_mask_col(F.col("q"))).withColumn("g", X.guess_text_col(F.col("norm"), F.col("q")))
    for r in rows.collect():
        if r.s is None:
            assert all(r[k] is None for k in cols if k != "stored"), r
            continue
        m = X.normalize(r.s)
        assert (r.norm, r.erased, r.q, r.d, r.syn) == (m, X.erase_fillers(r.s), X.query_tokens(r.s), X.dataset_tokens(m), X.synonym(m)), r.s
        assert r.b2 == [g.hex().upper() for g in X.byte_ngrams(m, 2)] and r.b3 == [g.hex().upper() for g in X.byte_ngrams(m, 3)]
        assert r.mask == X.numeric_mask(r.q) and r.g == X.guess_text(r.s) and r.slug == X.slug(r.s)
        assert r.stored == (255 if not m else min(255, len(m.encode()) - 1))


def test_spans(spark):
    df = spark.createDataFrame([("ab  ü c",), ("",), (None,)], "s string")
    got = [None if r.x is None else [tuple(t) for t in r.x] for r in df.select(X.token_spans_col(F.col("s")).alias("x")).collect()]
    assert got == [[(0, 2), (4, 2), (7, 1)], [], None]
