import random

from pyspark.sql import functions as F

from wayfold.llm import tokens
from wayfold.llm.packing import BestFit, pack


def naive(sizes, capacity, most):
    open_, n, out = [], 0, []
    for s in sizes:
        fit = [b for b in open_ if b[0] >= s]
        if fit:
            b = min(fit, key=lambda b: b[0])
        else:
            if len(open_) >= most:
                open_.remove(min(open_, key=lambda b: b[0]))
            b = [capacity, n]
            n += 1
            open_.append(b)
        b[0] -= s
        if not b[0]:
            open_.remove(b)
        out.append(b[1])
    return out


def test_best_fit_fills_like_naive():
    rnd = random.Random(5)
    sizes = [rnd.randint(1, 100) for _ in range(3000)]
    b = BestFit(100, 8)
    got = [b.put(s) for s in sizes]
    fill = {}
    for c, s in zip(got, sizes):
        fill[c] = fill.get(c, 0) + s
    assert max(fill.values()) <= 100
    assert abs(b.made - len(set(naive(sizes, 100, 8)))) <= 3


def test_pack(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.randint(1, 400), "c") for i in range(2000)] + [(5000, 2048 * 2 + 7, "c"), (5001, 0, "c"), (5002, None, "c"), (None, 5, "c"), (7, 300, "c")]
    out = pack(spark.createDataFrame(rows, "id long, n long, fill string"), "id", "n", 1000, parts=3).toPandas()
    want = sum(-(-n // 1000) for i, n, _ in rows if i is not None and n)
    assert len(out) == want
    assert out["size"].sum() == sum(n for i, n, _ in rows if i is not None and n)
    sums = out.groupby(["part", "container"])["size"].sum()
    assert sums.max() <= 1000 and (out.groupby(["part", "container"])["fill"].first() == sums).all()
    big = out[out.item == 5000].sort_values("piece")
    assert big["size"].tolist() == [1000, 1000, 1000, 1000, 103] and big["start"].tolist() == [0, 1000, 2000, 3000, 4000]
    assert sums.mean() > 950
    again = pack(spark.createDataFrame(rows, "id long, n long, fill string").repartition(7), "id", "n", 1000, parts=3, look_ahead=1).toPandas()
    assert again["size"].sum() == out["size"].sum() and again.groupby(["part", "container"])["size"].sum().max() <= 1000
    assert pack(spark.createDataFrame([], "id long, n long"), "id", "n", 10, parts=2).count() == 0


def test_tokens(spark):
    texts = ["", "Hello world, 17 marks.", None, "über ﬁ 𝒳\n\n x", "word " * 60000, "a" * 150000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.n for r in df.select(tokens.n_tokens(F.col("t")).alias("n")).collect()]
    e = tokens._encoding(f"{tokens.FOLDER}/{tokens.FILE}")
    assert got[:5] == [None if t is None else len(e.encode_ordinary(t)) for t in texts[:5]] and got[5] > 0
