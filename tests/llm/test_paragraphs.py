import random

from wayfold.llm.paragraphs import components, paragraph_classes


def shingles(p):
    w = p.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_classes_against_brute_force(spark):
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.randint(30, 120))] for _ in range(60)]
    pars = []
    for _ in range(500):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice((0, 0, 1, 1, 2, 4))):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        pars.append(" ".join(w))
    pars += ["short one", "short  one", "short two", "", "   "]
    docs = [(i, "\n".join(pars[i * 5 : i * 5 + 5]), 1) for i in range(101)] + [(None, "x y", 1), (500, None, 1), (501, "", 1)]
    got = {(r.doc_id, r.par_no): r for r in paragraph_classes(spark.createDataFrame(docs, "doc_id long, text string, n long")).collect()}
    real = {(i // 5, i % 5): shingles(p) for i, p in enumerate(pars) if p.strip()}
    assert set(got) == set(real)
    root = {k: k for k in real}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(real)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(real[a] & real[b])
            if both >= 0.8 * (len(real[a]) + len(real[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = {k: find(k) for k in keys}
    same = sum((got[k].class_doc, got[k].class_par) == want[k] for k in keys)
    assert same >= 0.995 * len(keys)
    # no link without similarity: each class lies in a true one
    assert all(want[r.class_doc, r.class_par] == want[k] for k, r in got.items())
    assert all(r.removed == ((r.class_doc, r.class_par) != k) for k, r in got.items())
    assert got[100, 0].n == 2 and not got[100, 2].removed


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 3), (5, 5)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 150: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(spark):
    assert paragraph_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
