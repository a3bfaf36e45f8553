"""Records of several sources combined to target weights.

Every source gets a quota of the total size, limited by how often its records may be repeated; nothing makes up for a source
that falls short, so the others keep their proportions. The records of a source are dealt into blocks by a hash. A quota is
then a number of whole rounds over all blocks, a number of whole blocks of one more round, and a part of one block.

Blocks are the units of mixing: a splitting tree halves the set of output shards again and again and draws, by the
multivariate hypergeometric distribution, how many blocks of each source go to either side, so every shard's counts are
exact and sum up. Each source's blocks, permuted, are drawn without overlap by the shards; within a shard the records are
shuffled. The tree is split in two: the driver goes down to at most GROUPS groups of shards, handling counts of at most
BLOCKS blocks for each source and round; each group's part of the tree is then grown in a task, over blocks cut further, so
that a shard has some SHARE blocks to choose from however many shards there are. Records never leave the executors, and no
step sorts or gathers a whole source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import kept

BLOCKS = 4096
#: Records of a block, where a source has fewer than BLOCKS times as many.
BLOCK_RECORDS = 16
#: Groups of shards that the driver deals blocks to, and blocks of a shard below.
GROUPS, SHARE = 1024, 32


def split_counts(counts: np.ndarray, shards: int, rng: np.random.Generator, edges: np.ndarray | None = None) -> np.ndarray:
    """(shards, sources) numbers of blocks: each shard gets its even part of all, sources as drawn.

    ``edges`` (shards + 1 numbers) gives shards parts of different weight.
    """
    at = np.arange(shards + 1) if edges is None else edges
    out = np.zeros((shards, len(counts)), np.int64)
    todo = [(0, shards, np.asarray(counts, np.int64))]
    while todo:
        a, b, have = todo.pop()
        if b - a == 1:
            out[a] = have
            continue
        m = (a + b) // 2
        total = int(have.sum())
        left = total * int(at[m] - at[a]) // int(at[b] - at[a])
        # marginals draw for any counts; few sources, so the cost is that of a few draws
        drawn = rng.multivariate_hypergeometric(have, left, method="marginals") if total else have
        todo += [(a, m, drawn), (m, b, have - drawn)]
    return out


def _dealt(names: list[str], units: dict[str, int], shards: int, rng: np.random.Generator, edges: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The shard of each unit of each source."""
    each = split_counts(np.array([units[s] for s in names], np.int64), shards, rng, edges)
    out = {}
    for i, s in enumerate(names):
        out[s] = np.empty(units[s], np.int64)
        out[s][rng.permutation(units[s])] = np.repeat(np.arange(shards), each[:, i])
    return out


def _grown(bounds: np.ndarray, seed: int, share: int):
    """The part of the tree below a group: its units, cut into so many pieces that every shard gets ``share``, dealt to its shards."""

    def run(units: pd.DataFrame) -> pd.DataFrame:
        u = units.sort_values(["source", "block", "copy"], ignore_index=True)
        first, last = int(bounds[u["grp"].iloc[0]]), int(bounds[u["grp"].iloc[0] + 1])
        pieces = 1 if last - first < 2 else math.ceil(share * (last - first) / len(u))
        cut = u.loc[u.index.repeat(pieces)].reset_index(drop=True)
        cut["pieces"], cut["piece"] = pieces, np.tile(np.arange(pieces), len(u))
        names = sorted(set(cut["source"]))
        shard = _dealt(names, {s: int((cut["source"] == s).sum()) for s in names}, last - first, np.random.default_rng((seed, first)))
        cut["shard"] = np.concatenate([shard[s] for s in names]) + first  # rows are sorted by source
        return cut[["source", "block", "copy", "limit", "pieces", "piece", "shard"]]

    return run


@dataclass
class Mix:
    records: DataFrame
    report: DataFrame


def mix(sizes: DataFrame, weights: DataFrame, total: int | None = None, shard_size: int = 4_000_000, seed: int = 17, groups: int = GROUPS, share: int = SHARE) -> Mix:
    """Mix records (id, source, size) to weights (source, target_share, max_repeats).

    ``records``: (shard, pos, id, copy, source, size), ``copy`` from 1 to max_repeats. ``report``: one row per listed source
    with target_share, max_repeats, available, quota and actual size, actual_share, and records used. ``total`` is the size
    aimed at; by default all that the listed sources hold. Records with null source, null id, no size, or a source that is
    not listed take no part. A listed source without records has an actual size of 0. A source listed twice counts with its
    larger values; a null or negative share or repeat counts as 0.
    """
    spark = sizes.sparkSession
    listed = weights.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("cap"))
    plan = {r.source: (max(0.0, r.share), max(0, r.cap)) for r in listed.collect()}  # one row per source: does not grow
    rows = sizes.select(F.col("id").cast("long").alias("id"), "source", F.col("size").cast("long").alias("size")).where((F.col("size") > 0) & F.col("id").isNotNull())
    rows = kept(rows.join(F.broadcast(listed.select("source")), "source"))

    have = {r.source: (r.n, r.s) for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).collect()}
    names = sorted(have)
    aim = sum(s for _, s in have.values()) if total is None else total
    blocks = {s: min(BLOCKS, max(1, have[s][0] // BLOCK_RECORDS)) for s in names}
    block_count = F.create_map(*[F.lit(x) for s in names for x in (s, blocks[s])]) if names else F.create_map()
    mixed = rows.withColumn("h", F.xxhash64("id", F.lit(seed)))
    block = F.pmod("h", F.coalesce(F.try_element_at(block_count, F.col("source")), F.lit(1)) if names else F.lit(1))
    mixed = mixed.withColumn("block", block.cast("int"))
    block_sizes: dict[tuple[str, int], int] = {(r.source, r.block): r.s for r in mixed.groupBy("source", "block").agg(F.sum("size").alias("s")).collect()}

    quotas = {s: min(plan[s][0] * aim, plan[s][1] * have[s][1]) for s in names}
    units: dict[str, list[tuple[int, int, int]]] = {}  # (block, copy, limit), limit -1 for a whole block
    for s in names:
        rounds = int(quotas[s] // have[s][1])
        left = round(quotas[s] - rounds * have[s][1])
        own = [b for b in range(blocks[s]) if (s, b) in block_sizes]
        units[s] = [(b, c + 1, -1) for c in range(rounds) for b in own]
        for b in own:
            if left <= 0:
                break
            size = block_sizes[s, b]
            units[s].append((b, rounds + 1, -1 if size <= left else left))
            left -= size

    n_shards = max(1, math.ceil(sum(quotas.values()) / shard_size))
    n_groups = min(groups, n_shards)
    bounds = np.arange(n_groups + 1) * n_shards // n_groups
    rng = np.random.default_rng(seed)
    group = _dealt(names, {s: len(units[s]) for s in names}, n_groups, rng, bounds) if names else {}
    table = spark.createDataFrame([(s, *u, int(g)) for s in names for u, g in zip(units[s], group[s], strict=True)], "source string, block int, copy int, limit long, grp int")
    pieces = table.groupBy("grp").applyInPandas(_grown(bounds, seed, share), "source string, block int, copy int, limit long, pieces int, piece int, shard long")
    pieces = kept(pieces)
    wanted = pieces.select("source", "block", "copy", "limit", "pieces").distinct()

    # only the one cut block of each source needs an order within; half a record over or under is the closest cut
    cut = [(s, b, left) for s in names for b, _, left in units[s] if left >= 0]
    if cut:
        edge = mixed.join(F.broadcast(spark.createDataFrame(cut, "source string, block int, most long")), ["source", "block"])
        before = F.sum("size").over(Window.partitionBy("source", "block").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
        edge = edge.withColumn("before", before).where(F.col("before") + F.col("size") / 2 <= F.col("most")).drop("before", "most")
        whole = wanted.where("limit < 0")
        picked = mixed.join(whole, ["source", "block"]).unionByName(edge.join(wanted.where("limit >= 0"), ["source", "block"]))
    else:
        picked = mixed.join(wanted, ["source", "block"])
    picked = picked.withColumn("piece", F.pmod(F.xxhash64("h", F.lit(seed + 2)), F.col("pieces")).cast("int"))
    picked = picked.join(pieces.select("source", "block", "copy", "piece", "shard"), ["source", "block", "copy", "piece"])
    at = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("id", "copy", F.lit(seed + 1)), "id", "copy", "source", "size"))
    records = picked.select("shard", at.alias("pos"), "id", "copy", "source", "size")

    used = picked.groupBy("source").agg(F.sum("size").alias("actual"), F.count(F.lit(1)).alias("used"))
    facts = spark.createDataFrame([(s, plan[s][0], plan[s][1], int(have.get(s, (0, 0))[1]), int(round(quotas.get(s, 0)))) for s in sorted(plan)], "source string, target_share double, max_repeats int, available long, quota long")
    report = facts.join(used, "source", "left").select("source", "target_share", "max_repeats", "available", "quota", F.coalesce("actual", F.lit(0)).alias("actual"), F.coalesce("used", F.lit(0)).alias("used"))
    everything = F.sum("actual").over(Window.partitionBy())  # one row per listed source
    report = report.withColumn("actual_share", F.when(everything > 0, F.col("actual") / everything).otherwise(0.0))
    return Mix(records, report)
