"""String dictionary, byte-bigram index, candidate strings of a query, posting lists, checks and counts.

Numbers are given by order of value, so they are the same on every run. The dictionary is numbered without a global
window: values are range-partitioned, counted per partition, and numbered from each partition's offset.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..functions.lineage import kept

#: Candidate strings of one query that are scored.
MOST_CANDIDATES = 6000


def numbered(values: DataFrame, column: str, name: str) -> DataFrame:
    """Rows with consecutive numbers from 0 in the order of ``column``, which must be distinct."""
    spark = values.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = kept(values.repartitionByRange(parts, column).withColumn("_p", F.spark_partition_id()))
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("_p", (F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("_o"))  # one row per partition
    at = F.row_number().over(Window.partitionBy("_p").orderBy(column)) - 1
    return placed.join(F.broadcast(offsets), "_p").withColumn(name, (F.col("_o") + at).cast("long")).drop("_p", "_o")


def strings(values: DataFrame) -> DataFrame:
    """(string_id, value, norm, n_bigrams) of every distinct non-null ``value``."""
    norm = values.where(F.col("value").isNotNull()).select("value").distinct().withColumn("norm", X.normalize_col(F.col("value")))
    return numbered(norm, "value", "string_id").select("string_id", "value", "norm", X.stored_bigrams_col(F.col("norm")).alias("n_bigrams"))


def bigram_index(dictionary: DataFrame) -> DataFrame:
    """(bigram, string_id), each pair once; repeats fall away inside the row, so nothing is shuffled."""
    grams = F.transform(F.array_distinct(X.byte_ngrams_col(F.col("norm"), 2)), X.compress_bigram_col)
    return dictionary.select(F.explode(grams).alias("bigram"), "string_id")


def asked_bigrams(queries: DataFrame) -> DataFrame:
    """(query_id, n_in, bigram) of the queries' texts (query_id, text): at most 128 bigrams a query."""
    norm = X.normalize_col(F.col("text"))
    q = queries.select("query_id", norm.alias("norm"), X.query_tokens_col(F.col("text"), norm).alias("tokens"))
    grams = X.split_bigrams_col(X.guess_text_col(F.col("norm"), F.col("tokens")))
    return q.select("query_id", F.size(grams).alias("n_in"), F.explode(F.array_distinct(grams)).alias("bigram"))


def match_counts(asked: DataFrame, index: DataFrame) -> DataFrame:
    """Shared bigrams of each query and string.

    Both sides are lists taken apart, which the planner believes to be as small as the rows they come from, so neither is
    left to be broadcast.
    """
    return index.hint("merge").join(asked.hint("merge"), "bigram").groupBy("query_id", "n_in", "string_id").agg(F.count(F.lit(1)).alias("matches"))


#: Strings and queries that meet in one task.
PART, BLOCK = 16_384, 512


def _shared(strings: pa.Table, queries: pa.Table, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query numbers, string numbers, shared bigrams) of the pairs that may be candidates, by adding up postings in an array."""
    norms = [v.encode() for v in strings.column("norm").to_pylist()]
    stored = strings.column("n_bigrams").to_numpy().astype(np.int64)
    size = np.array([len(v) for v in norms])
    text = np.frombuffer(b"".join(norms), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(norms)), size)
    whole = np.flatnonzero((owner[1:] == owner[:-1]) & (text[1:] != 32) & (text[:-1] != 32)) if len(text) else np.zeros(0, np.int64)
    pairs = np.unique((text[whole] | text[whole + 1] << 8) << 32 | owner[whole]) if len(whole) else np.zeros(0, np.int64)
    gram, holder = pairs >> 32, pairs & 0xFFFFFFFF
    for at, (n_in, asked) in enumerate(zip(queries.column("n_in").to_pylist(), queries.column("grams").to_pylist(), strict=True)):
        grams = np.array(asked, np.int64)
        low, high = np.searchsorted(gram, grams), np.searchsorted(gram, grams, "right")
        shared = np.bincount(np.concatenate([holder[a:b] for a, b in zip(low, high, strict=True)]), minlength=len(norms)) if len(grams) else np.zeros(len(norms), np.int64)
        met = np.flatnonzero(shared >= S.least_matches(n_in))
        cosine = shared[met] * shared[met] / (stored[met] * n_in)
        near = cosine >= S.MIN_COSINE
        met, cosine = met[near], cosine[near]
        if most is not None and len(met) > most:  # strings come by number, so of equal ones the first stay
            met = met[np.sort(np.argsort(-cosine, kind="stable")[:most])]
        yield np.full(len(met), at), met, shared[met]


def _met(most: int | None):
    def run(strings: pa.Table, queries: pa.Table) -> pa.Table:
        strings = strings.sort_by("string_id")
        found = list(_shared(strings, queries, most)) if len(strings) and len(queries) else []
        q, d, n = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
        return pa.table({"query_id": queries.column("query_id").take(pa.array(q)), "n_in": queries.column("n_in").take(pa.array(q)), "string_id": strings.column("string_id").take(pa.array(d)), "value": strings.column("value").take(pa.array(d)), "n_bigrams": strings.column("n_bigrams").take(pa.array(d)), "matches": pa.array(n, pa.int64())})

    return run


def candidates(queries: DataFrame, dictionary: DataFrame, index: DataFrame | None = None, most: int | None = MOST_CANDIDATES) -> DataFrame:
    """(query_id, string_id, value, cosine, rank): the ``most`` strings of best cosine, or all. Queries under 3 bytes have none.

    Queries come in blocks and strings in parts; each block meets each part in a task, where shared bigrams are counted by
    adding up the postings of the part. A join of bigrams would make a row for every bigram that two texts share, which for
    texts of one form ("Customer#...") is many times the number of pairs.
    """
    asked = asked_bigrams(queries.where(F.octet_length("text") >= 3)).groupBy("query_id", "n_in").agg(F.collect_list("bigram").alias("grams"))
    asked = kept(asked)
    parts, blocks = (max(1, math.ceil(df.count() / size)) for df, size in ((dictionary, PART), (asked, BLOCK)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = dictionary.select("string_id", "value", "norm", "n_bigrams").withColumn("part", F.pmod(F.xxhash64("string_id"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))
    right = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
    met = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_met(most), "query_id long, n_in int, string_id long, value string, n_bigrams int, matches long")
    close = met.withColumn("cosine", S.cosine_col(F.col("matches"), F.col("n_bigrams"), F.col("n_in")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "string_id"))
    ranked = close.withColumn("rank", rank)
    return (ranked if most is None else ranked.where(F.col("rank") <= most)).select("query_id", "string_id", "value", "cosine", "rank")


def postings(dictionary: DataFrame, located: DataFrame) -> DataFrame:
    """String numbers in place of ``value`` for rows that carry a located name."""
    return located.join(dictionary.select("value", "string_id"), "value").drop("value")


def broken_postings(posting: DataFrame, dictionary: DataFrame, named: DataFrame) -> DataFrame:
    """Postings whose string none of the named rows has; there should be none."""
    return posting.join(dictionary.select("string_id", "value"), "string_id").join(named.select("value"), "value", "left_anti").select("string_id", "loc_type")


def stats(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out
