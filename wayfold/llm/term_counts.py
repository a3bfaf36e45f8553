"""How often every distinct term occurs and in how many records, with marks for terms too rare or too common.

Method: recursive radix partitioning. Counts are pre-aggregated where the rows are, so that a term that a third of all rows
hold travels as one row per task. The pre-aggregated rows are written to disk once and cut into partitions by the upper bits
of the term's hash. A partition of more than ``most`` bytes is cut again by the next bits, and so on. Each partition, now
of a known size, is aggregated out of core by DuckDB: within a memory limit, and beyond it in the task's local folder of
Spark, should a partition that can't be cut further (rows of one hash) not fit. The driver sees partition sizes only.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import kept

#: Bits of one cut.
BITS = 6
#: Bytes of a partition, terms and counts; as a table of DuckDB they take up a few times as much.
MOST = 64 << 20
#: Bytes of a row besides its term.
ROW = 40
MEMORY = "400MB"


def _leaves(rows: DataFrame, most: int) -> list[tuple[int, int]]:
    """Partitions as (level, upper bits), found by adding up bytes and cutting what is too large. Equal hashes stay together.

    There is about one for every ``most`` bytes of pre-aggregated rows: a few hundred thousand for tens of terabytes.
    """
    done, level = [], 0
    asked = rows
    while True:
        prefix = F.shiftrightunsigned("h", 64 - BITS * (level + 1))
        sizes = {r.p: r.n for r in asked.groupBy(prefix.alias("p")).agg(F.sum(F.octet_length("term") + ROW).alias("n")).collect()}
        last = BITS * (level + 2) > 63
        done += [(level, p) for p, n in sizes.items() if n <= most or last]
        large = [] if last else [(p,) for p, n in sizes.items() if n > most]
        if not large:
            return done
        asked = rows.withColumn("_p", prefix).join(F.broadcast(rows.sparkSession.createDataFrame(large, "_p long")), "_p")
        level += 1


def _aggregate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    # the folders that Spark itself spills to on this executor
    local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
    with tempfile.TemporaryDirectory(prefix="terms", dir=local) as spill, duckdb.connect(config={"memory_limit": MEMORY, "threads": 1, "temp_directory": spill, "autoinstall_known_extensions": "false"}) as c:
        c.execute("CREATE TABLE part (leaf INTEGER, term VARCHAR, occurrences HUGEINT, records HUGEINT)")
        at = None

        def result() -> Iterator[pa.RecordBatch]:
            q = c.sql("SELECT term, sum(occurrences)::BIGINT AS occurrences, sum(records)::BIGINT AS records FROM part GROUP BY term")
            yield from q.to_arrow_reader(10_000)
            c.execute("TRUNCATE part")

        for b in batches:
            leaf = b.column(0).to_numpy(zero_copy_only=False)
            start = 0
            while start < len(leaf):  # rows come sorted by partition
                if at is not None and leaf[start] != at:
                    yield from result()
                at = leaf[start]
                end = start + int((leaf[start:] == at).argmin()) if leaf[-1] != at else len(leaf)
                batch = pa.Table.from_batches([b.slice(start, end - start)])  # noqa: F841
                c.execute("INSERT INTO part SELECT * FROM batch")
                start = end
        if at is not None:
            yield from result()


def term_counts(delivered: DataFrame, current: DataFrame, most: int = MOST) -> DataFrame:
    """(term, occurrences, records): rows of ``delivered`` with the term and rows of ``current`` with it, both having ``term``.

    Null terms are left out, the empty term is one. ``current`` has one row per record and term.
    """
    both = delivered.select("term", F.lit(1).alias("o"), F.lit(0).alias("r")).unionByName(current.select("term", F.lit(0).alias("o"), F.lit(1).alias("r")))
    rows = both.where(F.col("term").isNotNull())
    # partial counts per task, cut by hash: the first aggregation's map side does the work, its result is what goes to disk
    salted = rows.groupBy("term", F.pmod(F.spark_partition_id(), F.lit(8)).alias("salt")).agg(F.sum("o").alias("occurrences"), F.sum("r").alias("records"))
    spilled = kept(salted.select(F.xxhash64("term").alias("h"), "term", "occurrences", "records"))
    leaves = _leaves(spilled, most)
    return _collected(spilled, leaves)


def _collected(spilled: DataFrame, leaves: list[tuple[int, int]]) -> DataFrame:
    spark = spilled.sparkSession
    if not leaves:
        return spark.createDataFrame([], "term string, occurrences long, records long")
    parts = []
    for level in sorted({level for level, _ in leaves}):
        numbered = {p: i for i, (at, p) in enumerate(leaves) if at == level}
        prefix = F.shiftrightunsigned("h", 64 - BITS * (level + 1))
        table = spark.createDataFrame(sorted(numbered.items()), "p long, leaf int")  # one row per partition
        parts.append(spilled.withColumn("p", prefix).join(F.broadcast(table), "p").select("leaf", "term", "occurrences", "records"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    tasks = min(len(leaves), int(spark.conf.get("spark.sql.shuffle.partitions")) * 4)
    placed = rows.repartition(tasks, "leaf").sortWithinPartitions("leaf")
    return placed.mapInArrow(_aggregate, "term string, occurrences long, records long")


def marked(counts: DataFrame, records: int, rare_below: int = 3, common_part: int = 20) -> DataFrame:
    """``counts`` with ``mark``: 'rare' below so many records, 'common' in more than one of ``common_part`` records, else null."""
    return counts.withColumn("mark", F.when(F.col("records") < rare_below, "rare").when(F.col("records") * common_part > records, "common"))
