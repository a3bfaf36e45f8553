import numpy as np
from pyspark.sql import functions as F

from wayfold.llm.mixing import mix, split_counts


def test_tree_is_exact():
    counts = np.array([1000, 3, 0, 77])
    out = split_counts(counts, 13, np.random.default_rng(1))
    assert (out.sum(0) == counts).all() and out.sum(1).max() - out.sum(1).min() <= 2 and (out >= 0).all()


def test_mix(spark):
    rows = [(i, "a", 50 + i % 7, "c") for i in range(3000)] + [(10000 + i, "b", 40, "c") for i in range(200)] + [(20000 + i, "d", 90, "c") for i in range(9)]
    rows += [(30000, None, 5, "c"), (30001, "z", 5, "c"), (30002, "a", None, "c"), (None, "a", 7, "c"), (30003, "a", 0, "c")]
    sizes = spark.createDataFrame(rows, "id long, source string, size long, copy string").repartition(3)
    weights = spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 3), ("d", 0.1, 4), ("e", 0.2, 2)], "source string, target_share double, max_repeats int")
    m = mix(sizes, weights, total=100_000, shard_size=10_000)
    got = m.records.toPandas()
    assert got.groupby(["source", "id"]).size().groupby("source").max().to_dict() == {"a": 1, "b": 3, "d": 4}
    assert not got.duplicated(["id", "copy"]).any()
    r = {x.source: x for x in m.report.collect()}
    assert abs(r["a"].actual - 50_000) <= 60 and abs(r["b"].actual - 20_000) <= 40
    assert r["d"].actual == 4 * 9 * 90 and r["e"].actual == 0 and r["e"].available == 0
    assert abs(sum(x.actual_share for x in r.values()) - 1) < 1e-9
    assert got.groupby("source")["size"].sum().to_dict() == {s: r[s].actual for s in "abd"}
    assert got.groupby("shard")["pos"].agg(lambda p: sorted(p) == list(range(1, len(p) + 1))).all()
    again = mix(sizes.repartition(7), weights, total=100_000, shard_size=10_000).records.toPandas()
    assert set(map(tuple, got.values)) == set(map(tuple, again.values))


def test_empty(spark):
    none = spark.createDataFrame([], "id long, source string, size long")
    weights = spark.createDataFrame([("a", 0.5, 1), (None, 0.5, 1), ("a", None, None)], "source string, target_share double, max_repeats int")
    m = mix(none, weights)
    assert m.records.count() == 0 and [(x.source, x.actual, x.actual_share) for x in m.report.collect()] == [("a", 0, 0.0)]
    assert mix(none, weights.limit(0)).report.count() == 0


def test_many_shards_are_even_and_mixed(spark):
    """More shards than groups: every shard gets its part of the size, and of each source."""
    rows = [(i, "ab"[i % 3 == 0], 10) for i in range(30_000)]
    m = mix(spark.createDataFrame(rows, "id long, source string, size long"), spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 1)], "source string, target_share double, max_repeats int"), shard_size=4_000, groups=6)
    shards = {r.shard: (r.n, r.b) for r in m.records.groupBy("shard").agg(F.sum("size").alias("n"), F.sum(F.when(F.col("source") == "b", F.col("size"))).alias("b")).collect()}
    report = {r.source: r for r in m.report.collect()}
    assert len(shards) == 60 and set(shards) == set(range(60))
    assert report["a"].actual == 150_000 and report["b"].actual == 90_000
    mean = sum(n for n, _ in shards.values()) / 60
    assert all(0.5 * mean < n < 1.6 * mean and 0.1 < b / n < 0.75 for n, b in shards.values())
    assert m.records.select("id", "copy").distinct().count() == m.records.count()
