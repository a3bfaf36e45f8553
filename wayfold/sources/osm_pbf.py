"""Map extracts in the public PBF format as a Spark data source.

    spark.dataSource.register(PbfSource)
    spark.read.format("osm_pbf").option("kind", "node").load(path)

A file is a row of compressed blocks, each of which stands alone. The driver only walks over the block headers and hands out
ranges of blocks; the tasks read and decode them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from glob import glob

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_SCHEMAS = {
    "node": "id long, lat_e7 int, lng_e7 int, tags map<string,string>",
    "way": "id long, nodes array<long>, tags map<string,string>",
    "relation": "id long, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>",
}
#: Bytes of blocks that one task gets.
SPLIT = 32 << 20


def _varint(b: bytes, i: int) -> tuple[int, int]:
    v = shift = 0
    while True:
        c = b[i]
        i += 1
        v |= (c & 127) << shift
        if c < 128:
            return v, i
        shift += 7


def _zigzag(v: int) -> int:
    return v >> 1 ^ -(v & 1)


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message; lengths give bytes, everything else whole numbers."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            v, i = int.from_bytes(b[i : i + n], "little"), i + n
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield key >> 3, v


def packed(b: bytes, signed: bool = False) -> list[int]:
    out, i = [], 0
    while i < len(b):
        v, i = _varint(b, i)
        out.append(_zigzag(v) if signed else v)
    return out


def _running(values: list[int]) -> list[int]:
    out, total = [], 0
    for v in values:
        total += v
        out.append(total)
    return out


def block_rows(block: bytes, kind: str) -> Iterator[tuple]:
    """Rows of one primitive block."""
    parts: dict[int, list] = {}
    for n, v in fields(block):
        parts.setdefault(n, []).append(v)
    texts = [v.decode("utf-8", "replace") for n, v in fields(parts[1][0]) if n == 1]
    scale = parts.get(17, [100])[0]
    lat0, lng0 = (v - (1 << 64) if v >> 63 else v for v in (parts.get(19, [0])[0], parts.get(20, [0])[0]))
    e7 = lambda zero, v: round((zero + scale * v) / 100)
    pairs = lambda ks, vs: {texts[k]: texts[v] for k, v in zip(ks, vs)}  # noqa: E731, B905
    for group in parts.get(2, []):
        for n, v in fields(group):
            if n == 1 and kind == "node":
                f = dict(fields(v))
                yield _zigzag(f[1]), e7(lat0, _zigzag(f[8])), e7(lng0, _zigzag(f[9])), pairs(packed(f.get(2, b"")), packed(f.get(3, b"")))
            elif n == 2 and kind == "node":
                f = dict(fields(v))
                ids, lats, lngs = (_running(packed(f[k], True)) for k in (1, 8, 9))
                kv, i = packed(f.get(10, b"")), 0
                for d, a, b in zip(ids, lats, lngs, strict=True):
                    tags = {}
                    while i < len(kv) and kv[i]:
                        tags[texts[kv[i]]] = texts[kv[i + 1]]
                        i += 2
                    i += 1
                    yield d, e7(lat0, a), e7(lng0, b), tags
            elif n == 3 and kind == "way":
                f = dict(fields(v))
                yield f[1], _running(packed(f.get(8, b""), True)), pairs(packed(f.get(2, b"")), packed(f.get(3, b"")))
            elif n == 4 and kind == "relation":
                f = dict(fields(v))
                roles, refs, types = packed(f.get(8, b"")), _running(packed(f.get(9, b""), True)), packed(f.get(10, b""))
                members = [{"type": ("node", "way", "relation")[t], "ref": r, "role": texts[s]} for t, r, s in zip(types, refs, roles, strict=True)]
                yield f[1], members, pairs(packed(f.get(2, b"")), packed(f.get(3, b"")))


def blocks(path: str) -> Iterator[tuple[int, int]]:
    """(offset, size) of the data blobs of a file, from their headers."""
    with open(path, "rb") as f:
        while head := f.read(4):
            (size,) = struct.unpack(">I", head)
            h = dict(fields(f.read(size)))
            if h[1] == b"OSMData":
                yield f.tell(), h[3]
            f.seek(h[3], 1)


def inflated(blob: bytes) -> bytes:
    f = dict(fields(blob))
    if 1 in f:
        return f[1]
    if 3 in f:
        return zlib.decompress(f[3])
    raise ValueError("blob is neither plain nor zlib")


class Blobs(InputPartition):
    def __init__(self, path: str, ranges: list[tuple[int, int]]):
        self.path, self.ranges = path, ranges


class PbfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.kind = options.get("kind", "node")
        self.paths = sorted(glob(options["path"].removeprefix("file://")))
        if not self.paths:
            raise FileNotFoundError(options["path"])

    def partitions(self) -> list[InputPartition]:
        out = []
        for p in self.paths:
            part, size = [], 0
            for at, n in blocks(p):
                if part and size + n > SPLIT:
                    out.append(Blobs(p, part))
                    part, size = [], 0
                part.append((at, n))
                size += n
            if part:
                out.append(Blobs(p, part))
        return out or [Blobs(self.paths[0], [])]

    def read(self, partition: Blobs) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            for at, n in partition.ranges:
                f.seek(at)
                yield from block_rows(inflated(f.read(n)), self.kind)


class PbfSource(DataSource):
    """Options: path (files all executors can read), kind (node, way or relation)."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return _SCHEMAS[self.options.get("kind", "node")]

    def reader(self, schema) -> PbfReader:  # noqa: ANN001
        return PbfReader(self.options)
