"""Near-duplicate paragraphs of records: MinHash banding, exact Jaccard similarity, removals by components.

Paragraphs are lines of text; exact copies are collapsed first, so however many there are, they take part once. A
paragraph is the set of its runs of five words (one that is shorter is a single run). Its MinHash signature is cut into
bands tuned for high recall, and paragraphs that share a band meet in a bucket. A bucket of more than CROWDED members is cut
by longer bands, several for each member, which again lose next to nothing of what is similar but part what is not (texts of
one form, with a run or two in common). Paragraphs of up to three runs are similar only to equal sets.

A bucket never makes all its pairs. Its members are held against one of them, the leader; those that are similar are linked
to it, and the others form the bucket anew, with another leader, a few times. That joins nearly all of a bucket into
classes. Where a bucket still holds several classes, members of different classes are held against each other, so no link
of two paragraphs in one bucket is lost. Links are verified on the whole sets. Classes are the connected components of the
links, found by large and small stars; in each class all but the first paragraph are marked for removal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import kept
from .shared_spans import _chunks, _Hashed

WORDS = 5
#: At a similarity of 0.8 the chance to share no band is 0.003.
BANDS, ROWS = 8, 3
#: Members up to which a bucket stays whole, and the longer bands for those of larger ones.
CROWDED, LONGER = 32, 8
#: Leaders a bucket has one after the other before its classes are held against each other.
ROUNDS = 3
U = np.uint64

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], U)


def _scrambled(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


def _runs(hashes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of five words, its paragraph) of paragraphs given by the hashes of their words."""
    padded = np.maximum(size, WORDS)
    at = np.cumsum(padded) - padded
    words = np.zeros(int(padded.sum()), U)
    offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    words[np.repeat(at, size) + offset] = hashes[np.repeat(start, size) + offset]
    many = padded - WORDS + 1
    which = np.repeat(np.arange(len(size)), many)
    first = np.repeat(at, many) + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    with np.errstate(over="ignore"):
        return _scrambled(sum(words[first + k] * _MIX[k] for k in range(WORDS))), which


#: Characters that part words; a line break parts paragraphs.
_BLANKS = np.array([9, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 10], np.uint32)
_SIGNED = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("doc", pa.int64()), ("par_no", pa.int32()), ("runs", pa.list_(pa.int32())), ("keys", pa.list_(pa.int64())), ("longer", pa.list_(pa.int64()))])


def _paragraphs(docs: list[int], texts: list[str]) -> tuple[np.ndarray, ...]:
    """(record, number in the record, hashes of the words, first word, number of words) of the paragraphs with a word."""
    whole = "\n".join(texts)
    h = _Hashed(whole)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = np.isin(codes, _BLANKS)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    breaks = np.cumsum(codes == 10)
    line = breaks[start] if len(start) else np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    which = np.searchsorted(begins, start[first], "right") - 1
    before = np.concatenate(([0], breaks))[begins[which]]
    return np.asarray(docs, np.int64)[which], line[first] - before, h.some(start, end), first, np.diff(np.append(first, len(line)))


def _signed(every: bool):
    """Identity of each paragraph, and with ``every`` its set of runs and the keys of its buckets."""
    seeds = np.random.default_rng(9).integers(1, 1 << 63, (2, (BANDS + LONGER) * ROWS), dtype=np.uint64) | U(1)
    as_lists = lambda values, ends: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values))

    def signed(docs: list[int], texts: list[str]) -> pa.RecordBatch | None:
        doc, number, words, start, size = _paragraphs(docs, texts)
        if not len(doc):
            return None
        with np.errstate(over="ignore"):
            place = (np.arange(len(words)) - np.repeat(start, size)).astype(U)
            i, j = (np.add.reduceat(_scrambled(words * _MIX[k] + place * _MIX[k + 1]), start) for k in (0, 2))
        columns = [pa.array(i.view(np.int64)), pa.array(j.view(np.int64)), pa.array(doc), pa.array(number.astype(np.int32))]
        if not every:
            return pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(_SIGNED)[:4]))
        runs, which = _runs(words, start, size)
        # each run once
        order = np.lexsort((runs, which))
        runs, which = runs[order], which[order]
        new = np.concatenate(([True], (runs[1:] != runs[:-1]) | (which[1:] != which[:-1])))
        runs, which = runs[new], which[new]
        head = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
        with np.errstate(over="ignore"):
            least = [np.minimum.reduceat(_scrambled(runs * a + c), head) for a, c in seeds.T]
            bands = [_scrambled(sum(least[b * ROWS + r] * _MIX[r] for r in range(ROWS)) + U(b)) for b in range(BANDS + LONGER)]
            full = _scrambled(np.add.reduceat(_scrambled(runs), head))
        few = np.diff(np.append(head, len(runs))) <= 3
        keys = np.stack(bands[:BANDS], 1)
        keys[few, 0] = full[few]
        many = np.where(few, 1, BANDS)
        keys = keys[np.arange(BANDS) < many[:, None]].view(np.int64)
        longer = np.stack(bands[BANDS:], 1).view(np.int64).reshape(-1)
        columns += [as_lists((runs >> U(32)).astype(np.uint32).view(np.int32), np.append(head[1:], len(runs))), as_lists(keys, np.cumsum(many)), as_lists(longer, np.arange(1, len(doc) + 1) * LONGER)]
        return pa.RecordBatch.from_arrays(columns, schema=_SIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docs, texts in _chunks(b.column(0).to_pylist(), b.column(1).to_pylist(), 1):
                out = signed(docs, texts)
                if out is not None:
                    yield out

    return run


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (id, lead) with ``near``: whether the sets' Jaccard similarity is at least ``least``."""
    full = pairs.join(sets.select("id", F.col("runs").alias("ra")), "id").join(sets.select(F.col("id").alias("lead"), F.col("runs").alias("rb")), "lead")
    both = F.size(F.array_intersect("ra", "rb"))
    # sets of too different sizes need no comparison
    short, long = F.least(F.size("ra"), F.size("rb")), F.greatest(F.size("ra"), F.size("rb"))
    near = F.when(short < least * long, F.lit(False)).otherwise(both >= least * (short + long - both))
    return full.select("id", "lead", near.alias("near"))


def buckets(sets: DataFrame) -> DataFrame:
    """(key, id) of the buckets with two members or more of paragraphs (id, keys, longer)."""
    member = sets.select(F.explode("keys").alias("key"), "id").distinct()
    size = member.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = kept(member.join(size, "key"))
    crowded = met.where(F.col("n") > CROWDED).select("key", "id").join(sets.select("id", "longer"), "id").select("key", "id", F.explode("longer").alias("more"))
    cut = crowded.select(F.xxhash64("key", "more").alias("key"), "id").distinct()
    return met.where(F.col("n") <= CROWDED).select("key", "id").unionByName(cut)


def links(sets: DataFrame, met: DataFrame, least: float = 0.8, rounds: int = ROUNDS) -> DataFrame:
    """Links (a, b) of paragraphs (id, runs) that are similar to a leader of one of their buckets (key, id)."""
    rest, found = met, sets.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    for _ in range(rounds):
        leaders = rest.groupBy("key").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "lead")
        held = kept(rest.join(leaders, "key").where("id <> lead"))
        judged = kept(_similar(held.select("id", "lead").distinct(), sets, least))
        found = found.unionByName(judged.where("near").select(F.col("id").alias("a"), F.col("lead").alias("b")))
        rest = held.join(judged.where("NOT near").select("id", "lead"), ["id", "lead"]).select("key", "id")
    return found


def bridges(sets: DataFrame, met: DataFrame, roots: DataFrame, least: float = 0.8) -> DataFrame:
    """Links (a, b) between paragraphs that share a bucket (key, id) but not yet a class (id, root)."""
    member = met.join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    mixed = member.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    rest = kept(member.join(mixed, "key"))
    other = rest.select("key", F.col("id").alias("lead"), F.col("root").alias("root2"))
    pairs = rest.join(other, "key").where("root < root2").select("id", "lead").distinct()
    return _similar(pairs, sets, least).where("near").select(F.col("id").alias("a"), F.col("lead").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of the ends of edges (a, b); the root is the least id of the component and is listed too."""

    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        hung = both.join(least, "a")
        out = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    e = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        e = kept(stars(stars(e, True), False))
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == now:
            return e.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()
        mark = now


def paragraph_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """One row per paragraph: (key, par_no, class_doc, class_par, n, removed).

    ``class_doc`` and ``class_par`` name the first paragraph of its class, ``n`` is the size of the class, copies included,
    and ``removed`` is true for all but the first. Paragraphs are numbered from 0; blank ones, null keys and null texts are
    left out, rows that repeat a key count once each. Paragraphs are equal if their words are, by 128 bits of hash. Other
    columns are ignored. An empty table gives an empty result.
    """
    base = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    rows = base.mapInArrow(_signed(False), "i long, j long, doc long, par_no int")
    heads = rows.groupBy("i", "j").agg(F.min(F.struct("doc", "par_no")).alias("first"), F.count(F.lit(1)).alias("n"))
    each = kept(heads.withColumn("id", F.monotonically_increasing_id()))
    # sets are kept only where a paragraph stands first; texts are read again and never shuffled. Rows that repeat a text
    # give equal sets of one id, which change nothing
    signed = base.mapInArrow(_signed(True), "i long, j long, doc long, par_no int, runs array<int>, keys array<long>, longer array<long>")
    ids = each.select("i", "j", F.col("first.doc").alias("doc"), F.col("first.par_no").alias("par_no"), "id")
    sets = kept(signed.join(ids, ["i", "j", "doc", "par_no"]).select("id", "runs", "keys", "longer"))
    met = kept(buckets(sets))
    roots = kept(components(links(sets, met, least)))
    roots = components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(bridges(sets, met, roots, least)))
    member = each.select("id", "i", "j", "first", "n").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    classes = member.groupBy("root").agg(F.min("first").alias("head"), F.sum("n").alias("n"))
    named = member.select("i", "j", "root").join(classes, "root").select("i", "j", "head", "n")
    out = rows.join(named, ["i", "j"])
    return out.select(F.col("doc").alias(key), "par_no", F.col("head.doc").alias("class_doc"), F.col("head.par_no").alias("class_par"), "n", ((F.col("doc") != F.col("head.doc")) | (F.col("par_no") != F.col("head.par_no"))).alias("removed"))
