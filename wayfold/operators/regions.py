"""Regions that contain points: ear clipping, a bounding-volume hierarchy, exact tests, one row per point and region.

Polygons with holes are cut into triangles once. A bounding-volume hierarchy over the triangles (first split by size, so
that a few large ones do not blow up the boxes of many small ones, then at the median of the longer side) is built on the
driver from at most TREE_SAMPLE boxes. It gives every triangle a leaf; the leaves' boxes are then taken over all triangles.
Points go down the tree in arrays. If all triangles are at most LOCAL_TRIANGLES, they travel with the tree and are tested
there without a shuffle; otherwise points and triangles meet by leaf in a join. Tests are exact in 64-bit integers, and
triangles are closed, so a point on an inner diagonal is found at least once; the region is reported once. A point on a
region's border counts as inside.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import kept

Point = tuple[int, int]

#: Points that go down the tree together; 24 bytes each.
POINTS_AT_ONCE = 100_000
TREE_SAMPLE = 200_000
LEAF = 8
#: 48 bytes each: the broadcast is at most 48 MB.
LOCAL_TRIANGLES = 1_000_000


def _cross(o: Point, a: Point, b: Point) -> int:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def double_area(ring: list[Point]) -> int:
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))


def tidy(ring: list[Point | None]) -> list[Point]:
    """Corners without nulls, repeats of the previous corner, a repeated first corner, and spikes."""
    out: list[Point] = []
    for p in ring:
        if p is None or p[0] is None or p[1] is None:
            continue
        if not out or out[-1] != p:
            out.append(p)
        if len(out) >= 3 and out[-3] == out[-1]:
            del out[-2:]
    while len(out) > 1 and out[0] == out[-1]:
        out.pop()
    return out if len(out) >= 3 and double_area(out) else []


def _sides(ox, oy, ax, ay, bx, by) -> np.ndarray:  # noqa: ANN001
    """1, 0 or -1 as b lies left of, on or right of the way from o over a. Products stay below 2^63, their difference may not."""
    left, right = (ax - ox) * (by - oy), (ay - oy) * (bx - ox)
    return (left > right).astype(np.int8) - (left < right)


def _blocked(a: Point, b: Point, edges: np.ndarray) -> bool:
    """Whether an edge (x1, y1, x2, y2) is in the way of the bridge a-b: they meet elsewhere than at a shared end."""
    (ax, ay), (bx, by) = a, b
    edges = edges[(np.minimum(edges[:, 0], edges[:, 2]) <= max(ax, bx)) & (np.maximum(edges[:, 0], edges[:, 2]) >= min(ax, bx))]
    cx, cy, dx, dy = edges.T
    low_x, high_x, low_y, high_y = min(ax, bx), max(ax, bx), min(ay, by), max(ay, by)
    is_end = lambda x, y: (x == ax) & (y == ay) | (x == bx) & (y == by)
    on_bridge = lambda side, x, y: (side == 0) & (low_x <= x) & (x <= high_x) & (low_y <= y) & (y <= high_y)
    on_edge = lambda side, x, y: (side == 0) & (np.minimum(cx, dx) <= x) & (x <= np.maximum(cx, dx)) & (np.minimum(cy, dy) <= y) & (y <= np.maximum(cy, dy))
    c_end, d_end = is_end(cx, cy), is_end(dx, dy)
    c, d = _sides(ax, ay, bx, by, cx, cy), _sides(ax, ay, bx, by, dx, dy)
    e, f = _sides(cx, cy, dx, dy, ax, ay), _sides(cx, cy, dx, dy, bx, by)
    crossing = (c * d < 0) & (e * f < 0) | on_bridge(c, cx, cy) | on_bridge(d, dx, dy) | on_edge(e, ax, ay) | on_edge(f, bx, by)
    # an edge that shares an end is only in the way if its other end lies on the bridge
    along = c_end & ~d_end & on_bridge(d, dx, dy) | d_end & ~c_end & on_bridge(c, cx, cy)
    return bool(np.where(c_end | d_end, along, crossing).any())


def _edges(ring: list[Point]) -> np.ndarray:
    r = np.array(ring, np.int64)
    return np.hstack((r, np.roll(r, -1, 0)))


def bridged(outer: list[Point], holes: list[list[Point]]) -> list[Point]:
    """One ring (counter-clockwise) in which each hole hangs on a pair of coinciding edges."""
    ring = outer if double_area(outer) > 0 else outer[::-1]
    waiting = sorted((h if double_area(h) < 0 else h[::-1] for h in holes), key=lambda h: max(h), reverse=True)
    edges = np.vstack([_edges(r) for r in (ring, *waiting)]) if waiting else None
    for hole in waiting:
        j = max(range(len(hole)), key=lambda i: hole[i])
        m = hole[j]
        corners = np.array(ring, np.float64) - m
        by_distance = np.argsort((corners * corners).sum(1), kind="stable").tolist()

        def opens(i: int, ring: list[Point] = ring, m: Point = m) -> bool:
            """Whether the bridge leaves corner i into the inside, which matters where corners coincide."""
            p, a, b = ring[i], ring[i - 1], ring[(i + 1) % len(ring)]
            if _cross(a, p, b) >= 0:
                return _cross(a, p, m) >= 0 and _cross(p, b, m) >= 0
            return not (_cross(a, p, m) < 0 and _cross(p, b, m) < 0)

        at = next((i for i in by_distance if opens(i) and not _blocked(m, ring[i], edges)), by_distance[0])
        edges = np.vstack((edges, [[*m, *ring[at]]]))
        ring = ring[: at + 1] + hole[j:] + hole[: j + 1] + ring[at:]
    return ring


class _Ring:
    """A ring under clipping: neighbours as a linked list, and the corners that can be in the way of an ear, ordered by x.

    A corner that is no ear waits for the corner found in its way; it is looked at again when that one is gone or one of its
    own neighbours is. So the whole ring is never searched again, and only corners between an ear's least and greatest x are.
    """

    def __init__(self, ring: list[Point]):
        self.ring, n = ring, len(ring)
        self.before, self.after = [n - 1, *range(n - 1)], [*range(1, n), 0]
        self.here = [True] * n
        self.left = n
        self.turn = [_cross(ring[i - 1], ring[i], ring[(i + 1) % n]) for i in range(n)]
        x = np.array([p[0] for p in ring], np.int64)
        self.order = np.argsort(x, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        self.xs, self.ys = x[self.order], np.array([p[1] for p in ring], np.int64)[self.order]
        # only a corner that does not bend to the left can lie in an ear; bends may become such only where a ring crosses itself
        self.blunt = np.array([t < 0 for t in self.turn], bool)[self.order]
        # two ways of being in the way: touching the ear's edge counts (0), or only lying inside (1)
        self.waiting: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        self.todo: tuple[deque, deque] = (deque(range(n)), deque())

    def in_the_way(self, i: int, inside_only: bool) -> int:
        """A corner in the way of the ear at corner i, or -1."""
        a, b, c = self.ring[self.before[i]], self.ring[i], self.ring[self.after[i]]
        low = int(np.searchsorted(self.xs, min(a[0], b[0], c[0])))
        high = int(np.searchsorted(self.xs, max(a[0], b[0], c[0]), "right"))
        near = low + np.flatnonzero(self.blunt[low:high])
        x, y = self.xs[near], self.ys[near]
        near = near[(y >= min(a[1], b[1], c[1])) & (y <= max(a[1], b[1], c[1]))]
        if not len(near):
            return -1
        x, y = self.xs[near], self.ys[near]
        least = 1 if inside_only else 0
        ok = np.ones(len(near), bool)
        for (px, py), (qx, qy) in ((a, b), (b, c), (c, a)):
            ok &= (_sides(px, py, qx, qy, x, y) >= least) & ~((x == px) & (y == py))
        found = near[ok]
        return int(self.order[found[0]]) if len(found) else -1

    def freed(self, i: int) -> None:
        for level in (0, 1):
            self.todo[level].extend(self.waiting[level].pop(i, ()))

    def cut(self, i: int) -> None:
        """Take corner i out; neighbours that become straight go too."""
        go = [i]
        while go and self.left > 2:
            i = go.pop()
            if not self.here[i]:
                continue
            self.here[i] = False
            self.left -= 1
            a, c = self.before[i], self.after[i]
            self.after[a], self.before[c] = c, a
            self.blunt[self.place[i]] = False
            self.freed(i)
            for j in (a, c):
                t = _cross(self.ring[self.before[j]], self.ring[j], self.ring[self.after[j]])
                self.turn[j] = t
                blunt = t < 0
                if self.blunt[self.place[j]] and not blunt:
                    self.freed(j)
                self.blunt[self.place[j]] = blunt
                if t == 0:
                    go.append(j)
                else:
                    self.todo[0].append(j)

    def ears(self) -> Iterator[tuple[Point, Point, Point]]:
        for i in range(len(self.ring)):
            if self.here[i] and self.turn[i] == 0 and self.left > 2:
                self.cut(i)
        seek = 0
        while self.left > 2:
            level = 0 if self.todo[0] else 1
            if self.todo[level]:
                i = self.todo[level].popleft()
                if not self.here[i] or self.turn[i] <= 0:
                    continue
                wall = self.in_the_way(i, bool(level))
                if wall >= 0:
                    self.waiting[level].setdefault(wall, []).append(i)
                    if not level:
                        self.todo[1].append(i)
                    continue
            else:  # a ring that crosses itself: any corner that bends to the left, if there is one
                seen = 0
                while seen < len(self.ring) and not (self.here[seek] and self.turn[seek] > 0):
                    seek, seen = (seek + 1) % len(self.ring), seen + 1
                i = seek
                if not self.here[i]:
                    i = next(k for k in range(len(self.ring)) if self.here[k])
            if self.turn[i] > 0:
                yield self.ring[self.before[i]], self.ring[i], self.ring[self.after[i]]
            self.cut(i)


def ear_clip(ring: list[Point]) -> list[tuple[Point, Point, Point]]:
    """Triangles of a counter-clockwise ring. A ring that crosses itself is clipped at corners that bend to the left."""
    return list(_Ring(ring).ears()) if len(ring) > 2 else []


def triangulate(outer: list[Point | None], inners: list[list[Point | None]] | None = None) -> list[tuple[Point, Point, Point]]:
    ring = tidy(outer)
    if not ring:
        return []
    return ear_clip(bridged(ring, [h for h in map(tidy, inners or []) if h]))


_CORNERS = ["x1", "y1", "x2", "y2", "x3", "y3"]


def triangles(areas: DataFrame, key: str) -> DataFrame:
    """(area, x1, y1 .. x3, y3) for every polygon of ``polygons``, counter-clockwise, in e7 units, x being the longitude.

    Repeated rows count once. Areas without key, polygons without an outer ring, and rings without an extent give nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xy = lambda ring: [None if p is None else (p["lng_e7"], p["lat_e7"]) for p in (ring if ring is not None else [])]
        for b in batches:
            rows = []
            for area, polygons in zip(b["area"], b["polygons"], strict=True):
                for p in polygons if polygons is not None else []:
                    if p is not None:
                        inners = [xy(r) for r in (p["inners"] if p["inners"] is not None else [])]
                        rows += [(area, *t[0], *t[1], *t[2]) for t in triangulate(xy(p["outer"]), inners)]
            yield pd.DataFrame(rows, columns=["area", *_CORNERS]).astype("int64")

    rows = areas.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("area"), "polygons").distinct()
    return rows.mapInPandas(run, "area long, " + ", ".join(f"{c} long" for c in _CORNERS))


@dataclass
class Tree:
    """Splits and boxes of a bounding-volume hierarchy, as arrays over nodes; node 0 is the root."""

    axis: np.ndarray  # 0: size class, 1: x, 2: y, -1: leaf
    bound: np.ndarray  # left if the value is below
    left: np.ndarray  # child; right is left + 1
    box: np.ndarray  # (nodes, 4): least x, least y, greatest x, greatest y

    def leaf_of(self, boxes: np.ndarray) -> np.ndarray:
        value = _split_values(boxes)
        at = np.zeros(len(boxes), np.int64)
        while True:
            inner = np.flatnonzero(self.axis[at] >= 0)
            if not len(inner):
                return at
            n = at[inner]
            at[inner] = self.left[n] + (value[inner, self.axis[n]] >= self.bound[n])

    def with_boxes(self, leaves: dict[int, tuple]) -> Tree:
        box = np.tile(np.array([2**40, 2**40, -(2**40), -(2**40)], np.int64), (len(self.axis), 1))
        for i in range(len(self.axis) - 1, -1, -1):  # children come after their parent
            if self.axis[i] < 0:
                box[i] = leaves.get(i, box[i])
            else:
                a, b = box[self.left[i]], box[self.left[i] + 1]
                box[i] = (*np.minimum(a[:2], b[:2]), *np.maximum(a[2:], b[2:]))
        return Tree(self.axis, self.bound, self.left, box)

    def visits(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, numbers of the points in its box)."""
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            b = self.box[node]
            px, py = x[at], y[at]
            at = at[(px >= b[0]) & (px <= b[2]) & (py >= b[1]) & (py <= b[3])]
            if len(at):
                if self.axis[node] < 0:
                    yield node, at
                else:
                    todo += [(self.left[node], at), (self.left[node] + 1, at)]


def _split_values(boxes: np.ndarray) -> np.ndarray:
    extent = np.maximum(boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1])
    return np.stack((np.floor(np.log2(extent + 1) / 2).astype(np.int64), boxes[:, 0] + boxes[:, 2], boxes[:, 1] + boxes[:, 3]), 1)


def build_tree(boxes: np.ndarray, leaf: int = LEAF) -> Tree:
    value = _split_values(boxes)
    axis, bound, left = [-1], [0], [0]
    todo = [(0, np.arange(len(boxes)))]
    while todo:
        node, at = todo.pop()
        if len(at) <= leaf:
            continue
        v = value[at]
        spread = v.max(0) - v.min(0)
        ax = 0 if spread[0] else 1 + int(spread[2] > spread[1])
        if not spread[ax]:
            continue
        cut = int(np.median(v[:, ax])) if ax else int((v[:, 0].min() + v[:, 0].max() + 1) // 2)
        if cut <= v[:, ax].min():
            cut = int(v[:, ax].min()) + 1
        low = v[:, ax] < cut
        axis[node], bound[node], left[node] = ax, cut, len(axis)
        axis += [-1, -1]
        bound += [0, 0]
        left += [0, 0]
        todo += [(left[node], at[low]), (left[node] + 1, at[~low])]
    return Tree(np.array(axis), np.array(bound, np.int64), np.array(left, np.int64), np.zeros((len(axis), 4), np.int64))


def _inside(t: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(points, triangles): whether a point is in a closed counter-clockwise triangle. Products stay below 2^63."""
    x, y = x[:, None], y[:, None]
    ok = np.ones((len(x), len(t)), bool)
    for a, b in ((0, 2), (2, 4), (4, 0)):
        ax, ay, bx, by = t[:, a], t[:, a + 1], t[:, b], t[:, b + 1]
        ok &= (bx - ax) * (y - ay) >= (by - ay) * (x - ax)
    return ok


def _joined(batches: Iterator[pd.DataFrame], rows: int = POINTS_AT_ONCE) -> Iterator[pd.DataFrame]:
    """Batches put together to about ``rows`` rows: each goes down the whole tree, which costs the same for few points."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= rows:
            yield pd.concat(held)
            held, n = [], 0
    if held:
        yield pd.concat(held)


def _box() -> list[Column]:
    return [F.least("x1", "x2", "x3"), F.least("y1", "y2", "y3"), F.greatest("x1", "x2", "x3"), F.greatest("y1", "y2", "y3")]


def containing_regions(points: DataFrame, key: str, areas: DataFrame, area_key: str, local: int = LOCAL_TRIANGLES, sample: int = TREE_SAMPLE, leaf: int = LEAF, cut: DataFrame | None = None) -> DataFrame:
    """Pairs (a_id, b_id) of a point's key and the key of each area that contains it, each pair once.

    Points need lat_e7 and lng_e7; points without key or coordinates are in no area. Borders are straight in the plane of
    longitude and latitude, holes are respected, areas may overlap. ``cut`` are the triangles of the areas, if they are there.
    """
    spark = points.sparkSession
    tri = kept(triangles(areas, area_key)) if cut is None else cut
    n = tri.count()
    boxed = tri.select(*[c.alias(b) for c, b in zip(_box(), ("a", "b", "c", "d"), strict=True)])
    if n > sample:  # of all triangles an even share; only where the splits fall depends on it
        boxed = boxed.where(F.pmod(F.xxhash64("a", "b", "c", "d"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    boxes = boxed.toPandas().to_numpy(np.int64).reshape(-1, 4)
    tree = build_tree(boxes, leaf)
    shape = spark.sparkContext.broadcast(tree)

    def to_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = b[_CORNERS].to_numpy(np.int64)
            box = np.stack((c[:, ::2].min(1), c[:, 1::2].min(1), c[:, ::2].max(1), c[:, 1::2].max(1)), 1)
            yield b.assign(leaf=shape.value.leaf_of(box))

    placed = tri.mapInPandas(to_leaves, "area long, " + ", ".join(f"{c} long" for c in _CORNERS) + ", leaf long")
    p = points.where(F.col("lat_e7").isNotNull() & F.col("lng_e7").isNotNull() & F.col(key).isNotNull())
    p = p.select(F.col(key).cast("long").alias("k"), F.col("lng_e7").cast("long").alias("x"), F.col("lat_e7").cast("long").alias("y")).distinct()

    if n <= local:
        all_of = placed.toPandas().sort_values("leaf", kind="stable")  # at most LOCAL_TRIANGLES
        corners, area, at = all_of[_CORNERS].to_numpy(np.int64), all_of["area"].to_numpy(np.int64), all_of["leaf"].to_numpy(np.int64)
        found, first = np.unique(at, return_index=True)
        ends = dict(zip(found.tolist(), zip(first.tolist(), np.append(first, len(at))[1:].tolist(), strict=True), strict=True))
        leaf_boxes = {i: (corners[a:b, ::2].min(), corners[a:b, 1::2].min(), corners[a:b, ::2].max(), corners[a:b, 1::2].max()) for i, (a, b) in ends.items()}
        sent = spark.sparkContext.broadcast((tree.with_boxes(leaf_boxes), corners, area, ends))

        def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            t, corners, area, ends = sent.value
            for b in _joined(batches):
                k, x, y = (b[c].to_numpy(np.int64) for c in ("k", "x", "y"))
                ks, rs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for node, at in t.visits(x, y):
                    a, z = ends[node]
                    i, j = np.nonzero(_inside(corners[a:z], x[at], y[at]))
                    ks.append(k[at[i]])
                    rs.append(area[a + j])
                yield pd.DataFrame({"a_id": np.concatenate(ks), "b_id": np.concatenate(rs)}).drop_duplicates()

        return p.mapInPandas(test, "a_id long, b_id long").distinct()

    placed = kept(placed)
    limits = placed.groupBy("leaf").agg(*[f(c) for f, c in zip((F.min, F.min, F.max, F.max), _box(), strict=True)]).collect()  # one row per leaf
    routes = spark.sparkContext.broadcast(tree.with_boxes({r[0]: tuple(r[1:]) for r in limits}))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, y = b["x"].to_numpy(np.int64), b["y"].to_numpy(np.int64)
            for node, at in routes.value.visits(x, y):
                yield b.iloc[at].assign(leaf=node)

    hits = p.mapInPandas(route, "k long, x long, y long, leaf long").hint("merge").join(placed.hint("merge"), "leaf")
    side = lambda a, b: (F.col(f"x{b}") - F.col(f"x{a}")) * (F.col("y") - F.col(f"y{a}")) >= (F.col(f"y{b}") - F.col(f"y{a}")) * (F.col("x") - F.col(f"x{a}"))
    return hits.where(side(1, 2) & side(2, 3) & side(3, 1)).select(F.col("k").alias("a_id"), F.col("area").alias("b_id")).distinct()
