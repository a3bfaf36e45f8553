"""Items of varying length put into containers of fixed capacity.

Method: bounded-space online best fit. At any time a fixed number of containers is open, listed by their free space with a
bitset over the sizes that occur, so the tightest container that still takes an item is found in a few word operations. An
item goes there; if none takes it a container is opened, and if too many are open the fullest closes first.

Items are looked at in runs of fixed length, in the order of their ids, and within a run the large ones come first, so that
small ones fill the gaps; what is held at a time stays bounded.

The items are dealt into parts by a hash of their id and each part is packed by itself, so the result does not
depend on how the input is stored. A part has at least some ten thousand containers' worth of items, which
makes the half-filled containers at its end negligible; the number of parts follows the total size. Items over the capacity
are split first, into full pieces and a rest; nothing else is split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class BestFit:
    """Open containers by free space. ``put`` returns the container of an item; closed ones appear in ``closed``."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.bits = 0  # bit f: an open container has f units free
        self.by_free: dict[int, list[int]] = {}
        self.open = self.made = 0

    def put(self, size: int) -> int:
        at = self.bits >> size
        if at:
            free = size + (at & -at).bit_length() - 1
            box = self._take(free)
        else:
            if self.open >= self.most_open:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest
            free, box = self.capacity, self.made
            self.made += 1
        if free > size:
            self.by_free.setdefault(free - size, []).append(box)
            self.bits |= 1 << (free - size)
            self.open += 1
        return box

    def _take(self, free: int) -> int:
        boxes = self.by_free[free]
        box = boxes.pop()
        if not boxes:
            self.bits &= ~(1 << free)
        self.open -= 1
        return box


def pieces(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """Rows (item, piece, start, size): one per item, or for an item over the capacity one per full piece and the rest.

    Items without a size or with none to place (null, 0 or less) are left out.
    """
    rows = items.select(F.col(key).cast("long").alias("item"), F.col(size).cast("long").alias("n")).where((F.col("n") > 0) & F.col("item").isNotNull())
    cut = rows.select("item", "n", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {capacity}"))).alias("piece"))
    start = F.col("piece") * capacity
    return cut.select("item", F.col("piece").cast("int").alias("piece"), start.alias("start"), F.least(F.lit(capacity), F.col("n") - start).alias("size"))


def pack(items: DataFrame, key: str, size: str, capacity: int, parts: int, most_open: int = 256, look_ahead: int = 1000) -> DataFrame:
    """Container of every item or piece: (item, piece, start, size, part, container, fill).

    ``fill`` is the sum of the sizes in the container, at most the capacity. A repeated key is an item of its own each time;
    ties are broken by the size. An empty table gives an empty result.
    """
    assert capacity > 0 and parts > 0 and most_open > 0 and look_ahead > 0
    dealt = pieces(items, key, size, capacity).withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int"))
    ordered = dealt.repartition(parts, "part").sortWithinPartitions("part", "item", "piece", "size")

    names = ["item", "piece", "start", "size", "part"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, boxes, held = None, None, []

        def settle() -> Iterator[pd.DataFrame]:
            held.sort(key=lambda r: -r[3])  # stable: equal sizes stay in the order of the ids
            if held:
                at = [boxes.put(r[3]) for r in held]
                yield pd.DataFrame(held, columns=names).assign(container=at)
                held.clear()

        for b in batches:
            for row in zip(*(b[c].tolist() for c in names), strict=True):
                if row[4] != part:
                    yield from settle()
                    part, boxes = row[4], BestFit(capacity, most_open)
                held.append(row)
                if len(held) >= look_ahead:
                    yield from settle()
        yield from settle()

    placed = ordered.mapInPandas(run, "item long, piece int, start long, size long, part int, container long")
    fills = placed.groupBy("part", "container").agg(F.collect_list(F.struct("item", "piece", "start", "size")).alias("in"), F.sum("size").alias("fill"))
    return fills.select("part", "container", "fill", F.inline("in")).select("item", "piece", "start", "size", "part", "container", "fill")


def parts_for(total: int, capacity: int, containers: int = 20_000) -> int:
    """Number of parts so that each fills about ``containers`` containers."""
    return max(1, round(total / capacity / containers))
