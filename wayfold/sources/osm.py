"""Map extracts (OSM PBF) as two DataFrames: nodes and ways, in file order.

The file format is public: length-prefixed blobs, each a block of protocol buffer fields, plain or packed by zlib, lzma or zstd.  Blobs do not depend on
each other: a light pass over each file gives its blobs as rows, these are spread over the cluster and decoded in
tasks.  Files are read by Spark as binary files, so any store that Spark reads will do; a file has at most
2 GB, which regional extracts keep.
"""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "id long, lat double, lon double, tags map<string,string>, seq struct<path:string,at:long>"
WAYS = "id long, refs array<long>, tags map<string,string>, seq struct<path:string,at:long>"
_TAGS = pa.map_(pa.string(), pa.string())


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message; length-delimited values as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"field kind {kind}")
        yield key >> 3, value


def packed(data: bytes, signed: bool = False) -> np.ndarray:
    """A packed list of integers (zigzag-coded if ``signed``)."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    parts = (raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    value = np.add.reduceat(parts, starts)
    if signed:
        return (value >> np.uint64(1)).astype(np.int64) ^ -(value & np.uint64(1)).astype(np.int64)
    return value.astype(np.int64)


def block_rows(block: bytes) -> tuple[list[tuple], list[tuple]]:
    """(nodes, ways) of a primitive block: (id, lat, lon, tags) and (id, refs, tags)."""
    strings: list[str] = []
    groups, grain, lat0, lon0 = [], 100, 0, 0
    for n, v in fields(block):
        if n == 1:
            strings = [s.decode("utf-8", "replace") for _, s in fields(v)]
        elif n == 2:
            groups.append(v)
        elif n == 17:
            grain = v
        elif n == 19:
            lat0 = v - (1 << 64) if v >> 63 else v
        elif n == 20:
            lon0 = v - (1 << 64) if v >> 63 else v
    nodes, ways = [], []
    for group in groups:
        for n, v in fields(group):
            if n == 1:
                own = {k: x for k, x in fields(v) if k in (1, 2, 3, 8, 9)}
                sid, la, lo = ((own[k] >> 1) ^ -(own[k] & 1) for k in (1, 8, 9))
                tags = [(strings[a], strings[b]) for a, b in zip(packed(own.get(2, b"")), packed(own.get(3, b"")), strict=True)]
                nodes.append((sid, 1e-9 * (lat0 + grain * la), 1e-9 * (lon0 + grain * lo), tags))
            elif n == 2:
                own = dict(fields(v))
                ids, las, los = (np.cumsum(packed(own.get(k, b""), True)) for k in (1, 8, 9))
                keys = packed(own.get(10, b"")).tolist()
                at = 0
                for sid, la, lo in zip(ids.tolist(), (1e-9 * (lat0 + grain * las)).tolist(), (1e-9 * (lon0 + grain * los)).tolist(), strict=True):
                    tags = []
                    while at < len(keys) and keys[at]:
                        tags.append((strings[keys[at]], strings[keys[at + 1]]))
                        at += 2
                    at += 1
                    nodes.append((sid, la, lo, tags))
            elif n == 3:
                own = dict(fields(v))
                tags = [(strings[a], strings[b]) for a, b in zip(packed(own.get(2, b"")), packed(own.get(3, b"")), strict=True)]
                ways.append((own[1], np.cumsum(packed(own.get(8, b""), True)).tolist(), tags))
    return nodes, ways


def unpacked(blob: bytes) -> bytes:
    """The block of a blob."""
    own = dict(fields(blob))
    if 1 in own:
        return own[1]
    if 3 in own:
        return zlib.decompress(own[3])
    if 4 in own:
        return lzma.decompress(own[4], format=lzma.FORMAT_AUTO)
    if 7 in own:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(own[7], max_output_size=own.get(2, 0))
    raise ValueError(f"a blob of fields {sorted(own)} is packed in a way that is not read")


def blobs(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """path, at (byte of the blob in its file) and data (unpacked block) of the data blobs; unless ``strict``, a file ends where it cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, at = content.as_buffer().to_pybytes(), 0
                while at < len(data):
                    try:
                        head_size = int.from_bytes(data[at : at + 4], "big")
                        head = dict(fields(data[at + 4 : at + 4 + head_size]))
                        begin, kind = at + 4 + head_size, head[1]
                        end = begin + head[3]
                        if end > len(data):
                            raise ValueError(f"{place} ends inside a blob")
                    except (ValueError, KeyError, IndexError):
                        if strict:
                            raise
                        break
                    if kind == b"OSMData":
                        yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([at]), pa.array([data[begin:end]], pa.binary())], ["path", "at", "data"])
                    at = end

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, at long, data binary")


def read_pbf(spark: SparkSession, path: str | list[str], partitions: int = 200, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) with NODES and WAYS; seq has the order of files by name and of places in a file."""
    spread = blobs(spark, path, strict).repartition(partitions, "path", "at")

    def rows(kind: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, at, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    found = block_rows(unpacked(blob))[kind]
                    place = pa.array(range(at << 20, (at << 20) + len(found)), pa.int64())
                    seq = pa.StructArray.from_arrays([pa.array([path] * len(found), pa.string()), place], ["path", "at"])
                    columns = list(zip(*found, strict=True)) or [()] * (4 - kind)
                    types = [pa.int64(), pa.float64(), pa.float64(), _TAGS] if kind == 0 else [pa.int64(), pa.list_(pa.int64()), _TAGS]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), seq], ["id", "lat", "lon", "tags", "seq"] if kind == 0 else ["id", "refs", "tags", "seq"])

        return run

    return spread.mapInArrow(rows(0), NODES), spread.mapInArrow(rows(1), WAYS)


def valid(lat: str = "lat", lon: str = "lon"):
    return F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180)
