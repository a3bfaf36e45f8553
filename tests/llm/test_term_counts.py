from collections import Counter

import pyarrow as pa

from wayfold.llm import term_counts as module
from wayfold.llm.term_counts import marked, term_counts


def test_counts_with_recursion(spark):
    delivered = [f"t{i % 500}" for i in range(4000)] + ["hot"] * 3000 + ["", None, "only old"]
    current = [f"t{i}" for i in range(500)] + ["hot"] * 900 + [""]
    d = spark.createDataFrame([(t, 1) for t in delivered], "term string, records int").repartition(4)
    c = spark.createDataFrame([(t,) for t in current], "term string").repartition(3)
    want_o, want_r = Counter(t for t in delivered if t is not None), Counter(current)
    for most in (60, 4000, 10**9):
        got = {r.term: (r.occurrences, r.records) for r in term_counts(d, c, most=most).collect()}
        assert got == {t: (want_o[t], want_r[t]) for t in want_o}
    marks = {r.term: r.mark for r in marked(term_counts(d, c), 1000).collect()}
    assert marks["hot"] == "common" and marks["t1"] == "rare" and marks["only old"] == "rare"


def test_empty(spark):
    e = spark.createDataFrame([], "term string")
    assert term_counts(e, e).count() == 0


def test_out_of_core(monkeypatch):
    """A partition of some 70 MB of distinct long terms, within 40 MB of memory."""
    monkeypatch.setattr(module, "MEMORY", "40MB")
    batches = [pa.RecordBatch.from_pydict({"leaf": pa.array([0] * 5000, pa.int32()), "term": [f"{i:06d}" + "x" * 690 for i in range(a, a + 5000)], "occurrences": [1] * 5000, "records": [2] * 5000}) for a in [*range(0, 100_000, 5000), 0]]
    got = pa.Table.from_batches(list(module._aggregate(iter(batches))))
    assert got.num_rows == 100_000 and sum(got.column("occurrences").to_pylist()) == 105_000
