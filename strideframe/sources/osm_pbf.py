"""A Spark data source for OpenStreetMap extracts (``.osm.pbf``), by the public format description.

``spark.read.format("osm_pbf").load(path)`` gives osm_type (N, W, R), osm_id,
tags, lat, lon (nodes), refs (ways) and members (relations).  The driver reads
blob headers only; blobs are decoded by tasks.  ``kinds`` limits the elements,
e.g. ``option("kinds", "W")``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strideframe.config import check_extract_name

SCHEMA = "osm_type string, osm_id long, tags map<string,string>, lat double, lon double, refs array<long>, members array<struct<type:string,ref:long,role:string>>"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _message(data: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else (8 if kind == 1 else 4, at)
            value, at = data[at : at + size], at + size
        out.setdefault(key >> 3, []).append(value)
    return out


def _packed(parts: list, signed: bool = False) -> list[int]:
    out = []
    for part in parts:
        if isinstance(part, int):
            out.append(part)
            continue
        at = 0
        while at < len(part):
            n, at = _varint(part, at)
            out.append(n)
    return [(n >> 1) ^ -(n & 1) for n in out] if signed else out


def _sums(values: list[int]) -> list[int]:
    total, out = 0, []
    for v in values:
        total += v
        out.append(total)
    return out


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def decode_blob(blob: bytes) -> bytes:
    parts = _message(blob)
    if 1 in parts:
        return parts[1][0]
    if 3 in parts:
        return zlib.decompress(parts[3][0])
    raise ValueError("a blob is neither plain nor zlib")


def decode_block(data: bytes, kinds: str = "NWR") -> Iterator[tuple]:
    """The rows of one primitive block."""
    block = _message(data)
    words = [w.decode() for w in _message(block[1][0]).get(1, [])]
    grain = block.get(17, [100])[0]
    lat0, lon0 = (_signed(block.get(k, [0])[0]) for k in (19, 20))
    place = lambda offset, v: (offset + grain * v) / 1e9

    def tags(m: dict) -> dict:
        return {words[k]: words[v] for k, v in zip(_packed(m.get(2, [])), _packed(m.get(3, [])), strict=True)}

    for group in map(_message, block.get(2, [])):
        if "N" in kinds:
            for node in map(_message, group.get(1, [])):
                ident, lat, lon = (_packed([node[k][0]], True)[0] for k in (1, 8, 9))
                yield "N", ident, tags(node), place(lat0, lat), place(lon0, lon), None, None
            for dense in map(_message, group.get(2, [])):
                ids, lats, lons = (_sums(_packed(dense.get(k, []), True)) for k in (1, 8, 9))
                own = iter(_packed(dense.get(10, [])))
                for ident, lat, lon in zip(ids, lats, lons, strict=True):
                    found = {}
                    while key := next(own, 0):
                        found[words[key]] = words[next(own)]
                    yield "N", ident, found, place(lat0, lat), place(lon0, lon), None, None
        if "W" in kinds:
            for way in map(_message, group.get(3, [])):
                yield "W", way[1][0], tags(way), None, None, _sums(_packed(way.get(8, []), True)), None
        if "R" in kinds:
            for relation in map(_message, group.get(4, [])):
                roles, refs, types = _packed(relation.get(8, [])), _sums(_packed(relation.get(9, []), True)), _packed(relation.get(10, []))
                yield "R", relation[1][0], tags(relation), None, None, None, [("NWR"[t], r, words[w]) for t, r, w in zip(types, refs, roles, strict=True)]


def blobs(path: str) -> Iterator[tuple[str, int, int]]:
    """Kind, offset and size of each blob, from the headers."""
    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with store.open_input_file(name) as f:
        while head := f.read(4):
            header = _message(f.read(struct.unpack(">I", head)[0]))
            size = header[3][0]
            yield header[1][0].decode(), f.tell(), size
            f.seek(f.tell() + size)


class _Blobs(InputPartition):
    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = spans


class _Reader(DataSourceReader):
    def __init__(self, path: str, kinds: str, per_task: int):
        self.path, self.kinds, self.per_task = path, kinds, per_task

    def partitions(self) -> list[_Blobs]:
        spans = [(at, size) for kind, at, size in blobs(self.path) if kind == "OSMData"]
        return [_Blobs(spans[i : i + self.per_task]) for i in range(0, len(spans), self.per_task)] or [_Blobs([])]

    def read(self, partition: _Blobs) -> Iterator[tuple]:
        store, name = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        with store.open_input_file(name) as f:
            for at, size in partition.spans:
                f.seek(at)
                yield from decode_block(decode_blob(f.read(size)), self.kinds)


class OsmPbf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        path = self.options["path"]
        check_extract_name(path)
        return _Reader(path, self.options.get("kinds", "NWR"), int(self.options.get("blobsPerTask", 8)))


def register(spark) -> None:
    spark.dataSource.register(OsmPbf)
