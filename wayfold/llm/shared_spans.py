"""Long exact spans shared between records.

A character is shared if it lies in a window of ``span`` characters that occurs verbatim in another record. The method is
MinHash banding tuned for full recall: the "paragraphs" are all windows of ``span`` characters, the signature of a window is
the smallest hash of its k-grams (one band of one row), and equal windows therefore always collide. In a text,
neighbouring windows have the same smallest k-gram, so a text has only few of them (*anchors*), each owning a run of window
starts. Collisions are then verified on the windows themselves:

1. Each text gives its anchors, with a hash of the whole stretch that the anchor's windows cover. Anchors meet by hash.
2. Where a whole stretch recurs in another record, all its windows are shared. This settles the inside of long copies.
3. What is left are anchors whose stretch differs from that of the other records: the ends of copies, and chance hits. Their
   stretches are cut out of the texts and compared window by window within the group of the anchor.
4. Shared windows are merged to maximal runs per record.

Copies never make pairs: a group yields, for each record, only which of its own windows recur. Groups that many records
share are thinned where they arise: within a batch of texts a stretch that recurs is settled on the spot, and one row goes
on to the group for all. Groups with more than HOT stretches at step 3 are not gathered but compared by window hash with a
partially aggregated join, each window under its anchor. Windows are taken for equal if their anchor and the window as a
whole have the same hash of 64 bits each, so by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

U = np.uint64
#: Stretches of one anchor that are compared in one task; larger groups are compared by shuffled window hashes.
HOT = 4000
#: Code points handled at once by the array code.
CHUNK = 1 << 20

LONE, HEAD, HEAD_OF_OPEN, SETTLED, OPEN = range(5)

_FACTOR, _LOW = 0x9E3779B97F4A7C55, (1 << 24) - 1
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd factor modulo 2^64 and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 1))
        for i, f in enumerate((_FACTOR, pow(_FACTOR, -1, 1 << 64))):
            steps = np.full(size, f, U)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=U)
    return _powers


class _Hashed:
    """Hashes of all stretches of a sequence of code points, the same wherever a stretch stands."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = n = len(codes)
        h = codes.astype(U)
        h += U(0x51ED27)
        h *= U(0xFF51AFD7ED558CCD)
        h ^= h >> U(33)
        h *= U(0xC4CEB9FE1A85EC53)
        h *= _power_tables(n + 1)[0][:n]
        self.sums = np.zeros(n + 1, U)
        np.cumsum(h, out=self.sums[1:])

    @staticmethod
    def _scramble(z: np.ndarray) -> np.ndarray:
        z ^= z >> U(31)
        z *= U(0xBF58476D1CE4E5B9)
        z ^= z >> U(29)
        z *= U(0x94D049BB133111EB)
        z ^= z >> U(32)
        return z

    def all(self, size: int) -> np.ndarray:
        m = self.n - size + 1
        return self._scramble((self.sums[size:] - self.sums[:m]) * _powers[1][:m])

    def some(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._scramble((self.sums[end] - self.sums[start]) * _powers[1][start])


def _last_minimum(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the minimum of each ``w`` neighbouring hashes (their upper 40 bits), the last of equal ones."""
    n = len(h)
    m = h | U(_LOW)
    m -= np.arange(n, dtype=U) & U(_LOW)
    have = 1
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    size = n - w + 1
    if have < w:
        m = np.minimum(m[:size], m[w - have : w - have + size])
    at = np.arange(size, dtype=U)
    place = U(_LOW) - (m & U(_LOW))
    return (at + ((place - at) & U(_LOW))).astype(np.int64)


def _anchors(docs: list[int], texts: list[str], span: int, k: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, hash of the owned stretch, record, place) of every anchor; place packs position and owned range."""
    h = _Hashed("".join(texts))
    ends = np.cumsum([len(t) for t in texts])
    which = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    grams = h.all(k)
    at = _last_minimum(grams, span - k + 1)
    inside = which[: len(at)] == which[span - 1 :]
    start = np.flatnonzero(inside)
    at = at[start]
    cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (which[start[1:]] != which[start[:-1]]))))
    first, place = start[cut], at[cut]
    last = start[np.concatenate((cut[1:] - 1, [len(at) - 1]))]
    ctx = h.some(first, last + span)
    ctx = h._scramble(ctx + ((place - first) * 65536 + (place - last)).astype(U) * U(_FACTOR))
    w = which[first]
    base = np.concatenate(([0], ends[:-1]))[w]
    return grams[place].astype(np.int64), ctx.astype(np.int64), np.asarray(docs, np.int64)[w], (place - base) << 32 | (place - first) << 16 | (place - last)


def _chunks(docs: list[int], texts: list[str | None], span: int) -> Iterator[tuple[list[int], list[str]]]:
    ds, ts, size = [], [], 0
    for d, t in zip(docs, texts, strict=True):
        if d is None or t is None or len(t) < span:
            continue
        if ts and size + len(t) > CHUNK:
            yield ds, ts
            ds, ts, size = [], [], 0
        ds.append(d)
        ts.append(t)
        size += len(t)
    if ts:
        yield ds, ts


_ANCHOR = pa.schema([("part", pa.int64()), ("ctx", pa.int64()), ("kind", pa.int32()), ("doc", pa.int64()), ("last", pa.int64()), ("at", pa.int64())])


def _anchor_rows(span: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [_anchors(ds, ts, span, k) for ds, ts in _chunks(b.column(0).to_pylist(), b.column(1).to_pylist(), span)]
            if not parts:
                continue
            key, ctx, doc, at = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((doc, ctx, key))
            key, ctx, doc, at = key[order], ctx[order], doc[order], at[order]
            new_key = np.concatenate(([True], key[1:] != key[:-1]))
            new_ctx = new_key | np.concatenate(([True], ctx[1:] != ctx[:-1]))

            def spread(new: np.ndarray, doc: np.ndarray = doc) -> tuple[np.ndarray, ...]:
                head = np.flatnonzero(new)
                size = np.diff(np.concatenate((head, [len(new)])))
                low, high = np.minimum.reduceat(doc, head), np.maximum.reduceat(doc, head)
                return head, high, np.repeat(low != high, size), np.repeat(high, size)

            head, high, whole, _ = spread(new_ctx)
            key_head, key_high, met, _ = spread(new_key)
            # kinds: a stretch alone under its anchor waits for the group; one that recurs here is settled; one whose anchor
            # has other records here is open; heads stand in the group for what this batch has
            lone, settled, opened = ~met, whole, met & ~whole
            heads = head[whole[head]]
            with_open = np.repeat(np.logical_or.reduceat(opened, key_head), np.diff(np.concatenate((key_head, [len(key)]))))
            # a head for anchors that have only open stretches
            bare = key_head[met[key_head] & ~np.logical_or.reduceat(whole, key_head)]
            bare_high = key_high[np.searchsorted(key_head, bare)]
            pick = np.concatenate((np.flatnonzero(lone), heads, bare, np.flatnonzero(settled), np.flatnonzero(opened)))
            kind = np.repeat(np.array((LONE, HEAD, HEAD, SETTLED, OPEN), np.int32), (lone.sum(), len(heads), len(bare), settled.sum(), opened.sum()))
            kind[lone.sum() : lone.sum() + len(heads)][with_open[heads]] = HEAD_OF_OPEN
            last = doc[pick]
            last[lone.sum() : lone.sum() + len(heads) + len(bare)] = np.concatenate((high[np.searchsorted(head, heads)], bare_high))
            ctxs = ctx[pick]
            ctxs[kind == SETTLED] = 0
            ctxs[kind == OPEN] = key[pick][kind == OPEN]  # stands under its record, so its anchor goes here
            # a bare head must not make its own stretch look recurrent: it gets a stretch of no one
            ctxs[lone.sum() + len(heads) : lone.sum() + len(heads) + len(bare)] = 1
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.where(kind < SETTLED, key[pick], doc[pick]), ctxs, kind, doc[pick], last, at[pick])], schema=_ANCHOR)

    return run


_SLICE = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("text", pa.string())])
_WINDOW = pa.schema([("key", pa.int64()), ("hash", pa.int64()), ("doc", pa.int64()), ("last", pa.int64()), ("start", pa.int64())])
_RUN = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _slices(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc, text, items in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for i in items:
                    at = i["at"]
                    place, first, last = at >> 32, at >> 16 & 65535, at & 65535
                    rows.append((i["key"], doc, i["last"], place - first, text[place - first : place - last + span]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SLICE, strict=True)], schema=_SLICE)

    return run


def _window_hashes(texts: list[str], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each window of each text, the text it is of, and its start therein."""
    size = np.array([len(t) for t in texts])
    many = size - span + 1
    which = np.repeat(np.arange(len(texts)), many)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    start = np.repeat(np.cumsum(size) - size, many) + offset
    return _Hashed("".join(texts)).some(start, start + span), which, offset


def _compare(key_rows: pa.Table, span: int) -> pa.RecordBatch:
    """Runs of windows that recur in another record, of the rows of whole groups."""
    doc, last, start = (key_rows.column(c).to_numpy() for c in ("doc", "last", "start"))
    h, which, offset = _window_hashes(key_rows.column("text").to_pylist(), span)
    order = np.argsort(h)
    hs, w = h[order], which[order]
    head = np.flatnonzero(np.concatenate(([True], hs[1:] != hs[:-1])))
    shared = np.zeros(len(h), bool)
    shared[order] = np.repeat(np.minimum.reduceat(np.minimum(doc, last)[w], head) != np.maximum.reduceat(np.maximum(doc, last)[w], head), np.diff(np.concatenate((head, [len(h)]))))
    i = np.flatnonzero(shared)
    if not len(i):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, schema=_RUN)
    new = np.concatenate(([True], (np.diff(i) != 1) | (which[i[1:]] != which[i[:-1]])))
    a = i[new]
    z = i[np.concatenate((new[1:], [True]))]
    return pa.RecordBatch.from_arrays([pa.array(doc[which[a]]), pa.array(start[which[a]] + offset[a]), pa.array(start[which[z]] + offset[z] + span)], schema=_RUN)


def _compared(span: int):
    """Rows come sorted by key; the last group of a batch waits for the next. Groups have at most HOT rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            key = t.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield _compare(t.slice(0, cut), span)
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield _compare(rest, span)

    return run


def _windows(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, HOT):
                t = b.slice(i, HOT)
                if t.num_rows:
                    h, which, offset = _window_hashes(t.column(4).to_pylist(), span)
                    key, doc, last, start = (t.column(c).to_numpy()[which] for c in range(4))
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(h.astype(np.int64)), pa.array(doc), pa.array(last), pa.array(start + offset)], schema=_WINDOW)

    return run


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {dict(int64='long', int32='int', string='string')[str(f.type)]}" for f in schema)


def shared_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = 200, k: int = 64, hot: int = HOT) -> DataFrame:
    """Maximal runs of characters that stand in stretches of ``span`` or more which other records have verbatim.

    Columns: ``key``, ``start_pos`` (from 0), ``end_pos`` (exclusive), in code points. Records with null key, null text or
    fewer than ``span`` characters have none. Repeats within one record do not count, nor do rows that repeat a key. Texts
    are used whole. ``k`` must be below ``span``; it only sets the cost. An empty table gives an empty result.
    """
    assert 0 < k < span < 65536
    base = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= span))
    rows = base.mapInArrow(_anchor_rows(span, k), _ddl(_ANCHOR)).repartition("part")
    by_ctx, by_part = Window.partitionBy("part", "ctx"), Window.partitionBy("part")
    marked = (
        rows.withColumn("c0", F.min("doc").over(by_ctx)).withColumn("c1", F.max("last").over(by_ctx))
        .withColumn("k0", F.min("doc").over(by_part)).withColumn("k1", F.max("last").over(by_part))
        .withColumn("x0", F.min("ctx").over(by_part)).withColumn("x1", F.max("ctx").over(by_part))
    )
    place, before, behind = F.shiftright("at", 32), F.shiftright("at", 16).bitwiseAND(65535), F.col("at").bitwiseAND(65535)
    recurs = (F.col("kind") == SETTLED) | ((F.col("kind") == LONE) & (F.col("c0") < F.col("c1")))
    settled = marked.where(recurs).select("doc", (place - before).alias("start"), (place - behind + span).alias("end"))
    # heads go on wherever there may be an open stretch to hold against them; the stretch of a settled lone row is held by one row
    lone_open = (F.col("kind") == LONE) & (F.col("k0") < F.col("k1")) & (F.col("x0") < F.col("x1"))
    spoken = ((F.col("kind") == HEAD) & (F.col("ctx") != 1) & (F.col("x0") < F.col("x1"))) | (F.col("kind") == HEAD_OF_OPEN)
    first = F.row_number().over(Window.partitionBy("part", "ctx").orderBy("kind", "doc", "at")) == 1
    numbered = marked.where(lone_open | spoken | (F.col("kind") == OPEN)).withColumn("first", first)
    asked = numbered.where((F.col("kind") == OPEN) | (F.col("c0") == F.col("c1")) | F.col("first"))
    # a stretch that several records have is held once; "last" names another record that has it
    other = F.when(F.col("doc") == F.col("c1"), F.col("c0")).otherwise(F.col("c1"))
    key_of = F.when(F.col("kind") == OPEN, F.col("ctx")).otherwise(F.col("part"))
    asked = asked.select(key_of.alias("key"), "doc", F.when(F.col("kind") == OPEN, F.col("doc")).otherwise(other).alias("last"), "at")
    crowded = asked.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("key")

    def cut(wanted: DataFrame) -> DataFrame:
        items = wanted.groupBy("doc").agg(F.collect_list(F.struct("key", "last", "at")).alias("items"))
        return base.join(items.hint("shuffle_hash"), "doc").select("doc", "text", "items").mapInArrow(_slices(span), _ddl(_SLICE))

    quiet = cut(asked.join(crowded, "key", "left_anti")).repartition("key").sortWithinPartitions("key").mapInArrow(_compared(span), _ddl(_RUN))
    windows = cut(asked.join(crowded, "key", "left_semi")).mapInArrow(_windows(span), _ddl(_WINDOW))
    met = windows.groupBy("key", "hash").agg(F.min(F.least("doc", "last")).alias("d0"), F.max(F.greatest("doc", "last")).alias("d1")).where("d0 < d1").select("key", "hash")
    loud = windows.join(met, ["key", "hash"]).select("doc", "start", (F.col("start") + span).alias("end"))
    return merged_runs(settled.unionByName(quiet).unionByName(loud)).select(F.col("doc").alias(key), F.col("start").cast("int").alias("start_pos"), F.col("end").cast("int").alias("end_pos"))


def merged_runs(runs: DataFrame) -> DataFrame:
    """Runs (doc, start, end) of each record merged where they overlap or touch."""
    order = Window.partitionBy("doc").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = runs.withColumn("new", F.when(reach >= F.col("start"), 0).otherwise(1))
    numbered = numbered.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def shared_shares(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per record: characters, shared characters and their share (null for an empty or null text)."""
    sums = spans.groupBy(key).agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared_chars"))
    size = F.length(text)
    return docs.select(key, size.alias("n_chars")).join(sums, key, "left").select(key, "n_chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.when(F.col("n_chars") > 0, F.coalesce("shared_chars", F.lit(0)) / F.col("n_chars")).alias("share"))
