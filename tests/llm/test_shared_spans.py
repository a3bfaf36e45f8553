import random

import pytest

from wayfold.llm.shared_spans import shared_shares, shared_spans


def brute(rows, span):
    seen = {}
    for d, t in rows:
        for i in range(len(t or "") - span + 1):
            seen.setdefault(t[i : i + span], set()).add(d)
    out = set()
    for d, t in rows:
        mark = [False] * len(t or "")
        runs = []
        for i in range(len(mark) - span + 1):
            if len(seen[t[i : i + span]]) > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + span
                else:
                    runs.append([i, i + span])
        out |= {(d, a, b) for a, b in runs}
    return out


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé𝒳 ") for _ in range(rnd.randint(20, 90)))
    stock = [word() for _ in range(8)]
    rows = []
    for i in range(60):
        rows.append((i, "".join(rnd.choice(stock)[rnd.randint(0, 5) :] if rnd.random() < 0.5 else word() for _ in range(rnd.randint(1, 7)))))
    head = word() + word()
    rows += [(100 + i, word()[: rnd.randint(0, 9)] + head + word()) for i in range(30)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, ""), (203, None), (204, "a" * 300), (205, "a" * 280 + "b"), (206, "ab" * 200), (207, "x" * 39)]
    return rows


@pytest.mark.parametrize("seed,hot", [(1, 4000), (2, 3)])
def test_against_brute_force(spark, seed, hot):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id long, text string, doc long").repartition(5)
    got = {tuple(r) for r in shared_spans(df, span=40, k=13, hot=hot).collect()}
    assert got == brute(rows, 40)


def test_shares(spark):
    df = spark.createDataFrame([(1, "a" * 50 + "bc"), (2, "a" * 45 + "x"), (3, ""), (4, None), (None, "a" * 50)], "doc_id long, text string")
    got = {r.doc_id: r.share for r in shared_shares(df, shared_spans(df, span=40, k=13)).collect() if r.doc_id}
    assert got == {1: 50 / 52, 2: 45 / 46, 3: None, 4: None}
    assert shared_spans(df.limit(0)).count() == 0
