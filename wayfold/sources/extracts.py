"""Map extracts (OSM PBF) as a Spark data source, ``map_extract``: files are read by byte ranges and written a file a task.

Reading: a range of ``split`` bytes is a partition.  Its task finds the first blob that begins in the range by the mark
of blob headers (a chance match is ruled out by the header before and the one after), then goes from blob to blob; a blob
belongs to the range where its header begins.  So files of any size are read by many tasks, each holds one blob, and the
driver sees names and sizes alone.

Options: ``kind`` (node or way), ``columns`` (of NODES or WAYS, comma-separated: others are not decoded), ``having`` (tag
keys, comma-separated: only rows with one of them are made), ``split``, ``strict`` (false: a range ends where it cannot
be read), ``files`` (JSON list of paths, else ``path``: a file or folder).  Stores are those that pyarrow reads; ``osm.read_pbf`` goes
through Spark's own readers instead, for files of up to 2 GB.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from wayfold.sources.osm import fields, packed, unpacked

MARK = b"\n\x07OSMData"
#: Bytes of a header at most (fixed value of the format), of a range, and rows of a block that is written.
MOST_HEADER, SPLIT, BLOCK_ROWS = 64 * 1024, 64 << 20, 8000
#: NODES and WAYS of the other reader, as types (a source is asked for its schema outside of any session).
_TAGS, _PLACE = T.MapType(T.StringType(), T.StringType()), T.StructType().add("path", T.StringType()).add("at", T.LongType())
NODES = T.StructType().add("id", T.LongType()).add("lat", T.DoubleType()).add("lon", T.DoubleType()).add("tags", _TAGS).add("seq", _PLACE)
WAYS = T.StructType().add("id", T.LongType()).add("refs", T.ArrayType(T.LongType())).add("tags", _TAGS).add("seq", _PLACE)
_SEQ = pa.struct([("path", pa.string()), ("at", pa.int64())])


def store(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return pa.fs.FileSystem.from_uri(path)


def sizes(paths: list[str]) -> list[tuple[str, int]]:
    """(path, bytes) of extracts, folders listed; names that begin with a dot or underscore are left out."""
    found = []
    for path in paths:
        system, place = store(path)
        lead = path.removesuffix(place)
        info = system.get_file_info(place)
        if info.type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(path)
        inside = [info] if info.is_file else system.get_file_info(pa.fs.FileSelector(place))
        found += [(lead + f.path, f.size) for f in inside if f.is_file and not f.base_name.startswith(("_", "."))]
    return sorted(found)


def check_beginnings(paths: list[str]) -> None:
    """An error for the first extract that does not begin with a blob; a few bytes of each are read, no task runs."""
    for path, size in sizes(paths):
        try:
            if size:
                Blobs(path, size, 0, size, True).header(0)
        except (IndexError, KeyError) as e:
            raise ValueError(f"{path} has no blob at 0") from e


class Blobs:
    """The data blobs of one file that begin in [begin, end)."""

    def __init__(self, path: str, size: int, begin: int, end: int, strict: bool):
        system, place = store(path)
        self.path, self.size, self.begin, self.end, self.strict = path, size, begin, end, strict
        self.file = system.open_input_file(place)

    def header(self, at: int) -> tuple[bytes, int, int]:
        """(kind, begin, end) of the blob whose header begins at ``at``."""
        head = self.file.read_at(min(4 + 256, self.size - at), at)
        n = int.from_bytes(head[:4], "big")
        if not 0 < n <= MOST_HEADER or at + 4 + n > self.size:
            raise ValueError(f"{self.path} has no blob at {at}")
        if len(head) < 4 + n:
            head = self.file.read_at(4 + n, at)
        own = dict(fields(head[4 : 4 + n]))
        if 1 not in own or 3 not in own:
            raise ValueError(f"{self.path} has no blob at {at}")
        if at + 4 + n + own[3] > self.size:
            raise ValueError(f"{self.path} ends inside a blob")
        return own[1], at + 4 + n, at + 4 + n + own[3]

    def first(self) -> int:
        """Where the first blob of the range begins; its end, if none does."""
        at = self.begin
        while at < self.end:
            piece = self.file.read_at(min((1 << 20) + 4 + len(MARK), self.size - at), at)
            k = piece.find(MARK)
            while k >= 0:
                if k >= 4 and self._fits(at + k - 4):
                    return at + k - 4
                k = piece.find(MARK, k + 1)
            at += 1 << 20
        return self.end

    def _fits(self, at: int) -> bool:
        """Whether a header stands here and another one, or the file's end, behind its blob."""
        try:
            _, _, end = self.header(at)
            if end < self.size:
                self.header(end)
        except ValueError as e:
            return "ends inside" in str(e)
        except (IndexError, KeyError):
            return False
        return True

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        at = self.first() if self.begin else 0
        while at < min(self.end, self.size):
            try:
                kind, begin, end = self.header(at)
                block = unpacked(self.file.read_at(end - begin, begin)) if kind == b"OSMData" else None
            except (ValueError, KeyError, IndexError, zlib.error):
                if self.strict:
                    raise
                return
            if block is not None:
                yield at, block
            at = end


def _maps(counts: np.ndarray, keys: np.ndarray, values: np.ndarray, strings: pa.Array) -> pa.Array:
    offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
    return pa.MapArray.from_arrays(offsets, strings.take(pa.array(keys)), strings.take(pa.array(values)))


def _bearing(counts: np.ndarray, keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which rows have one of the wanted keys."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return np.bincount(owner[np.isin(keys, wanted)], minlength=len(counts)) > 0


def _some(kept: np.ndarray, counts: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Counts and values of the kept rows."""
    inside = np.repeat(kept, counts)
    return [counts[kept], *(v[inside] for v in values)]


def _pairs(listed: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of tags of each node, and (key, value) of all, of a list where 0 in the place of a key ends a node."""
    if not len(listed):
        return np.zeros(nodes, np.int64), np.zeros((0, 2), np.int64)
    ends = np.flatnonzero(listed == 0)
    if len(ends) != nodes:  # some value is the empty string 0
        ends, at = [], 0
        while at < len(listed):
            if listed[at] == 0:
                ends.append(at)
            at += 1 if listed[at] == 0 else 2
        ends = np.array(ends)
    inside = np.ones(len(listed), bool)
    inside[ends] = False
    return (np.diff(ends, prepend=-1) - 1) // 2, listed[inside].reshape(-1, 2)


def block_batches(block: bytes, kind: str, columns: list[str], having: list[str]) -> Iterator[dict[str, pa.Array | np.ndarray]]:
    """Columns (id, lat, lon, refs, tags and place, the number in the block) of each group of a block."""
    strings, groups, grain, lat0, lon0 = pa.array([], pa.string()), [], 100, 0, 0
    for n, v in fields(block):
        if n == 1:
            strings = pa.array([s.decode("utf-8", "replace") for _, s in fields(v)], pa.string())
        elif n == 2:
            groups.append(v)
        elif n == 17:
            grain = v
        elif n == 19:
            lat0 = v - (1 << 64) if v >> 63 else v
        elif n == 20:
            lon0 = v - (1 << 64) if v >> 63 else v
    known = {s: k for k, s in enumerate(strings.to_pylist())} if having else {}
    wanted = np.array([known[k] for k in having if k in known], np.int64)
    if having and not len(wanted):
        return  # no row of the block can bear one
    place = 0
    for group in groups:
        dense, plain, ways = [], [], []
        for n, v in fields(group):
            if n in (1, 2, 3):
                (plain, dense, ways)[n - 1].append(v)
        if kind == "way":
            own = [dict(fields(v)) for v in ways]
            (counts, keys), (_, values), refs = (_lists([o.get(n, b"") for o in own], n == 8) for n in (2, 3, 8))
            yield from _group(kind, place, np.array([o[1] for o in own], np.uint64).astype(np.int64), keys, values, columns, wanted if having else None, strings, counts=counts, refs=refs)
        else:
            for v in dense:
                own = dict(fields(v))
                ids, las, los = (np.cumsum(packed(own.get(n, b""), True)) for n in (1, 8, 9))
                listed = packed(own.get(10, b""))
                counts, flat = _pairs(listed, len(ids))
                yield from _group(kind, place, ids, flat[:, 0], flat[:, 1], columns, wanted if having else None, strings, counts=counts, lat=1e-9 * (lat0 + grain * las), lon=1e-9 * (lon0 + grain * los))
                place += len(ids)
            own = [{n: x for n, x in fields(v) if n in (1, 2, 3, 8, 9)} for v in plain]
            sid, la, lo = (np.array([(o[n] >> 1) ^ -(o[n] & 1) for o in own], np.int64) for n in (1, 8, 9))
            keys, values = ([packed(o.get(n, b"")) for o in own] for n in (2, 3))
            yield from _group(kind, place, sid, keys, values, columns, wanted if having else None, strings, lat=1e-9 * (lat0 + grain * la), lon=1e-9 * (lon0 + grain * lo))
        place += len(plain) + len(ways) if kind == "node" else len(ways)


def _lists(parts: list[bytes], signed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Number of integers of each packed list, and those of all."""
    data = b"".join(parts)
    ends = np.concatenate(([0], np.cumsum(np.frombuffer(data, np.uint8) < 128)))
    return np.diff(ends[np.cumsum([0, *(len(p) for p in parts)])]), packed(data, signed)


def _sums(counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Running sums inside each list."""
    every = np.concatenate(([0], np.cumsum(values)))
    return every[1:] - np.repeat(every[np.cumsum(counts) - counts], counts)


def _group(kind, place, ids, keys, values, columns, wanted, strings, counts=None, refs=None, **more) -> Iterator[dict]:
    if not len(ids):
        return
    if counts is None:
        counts = np.array([len(k) for k in keys], np.int64)
        keys, values = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (keys, values))
    kept = np.ones(len(ids), bool) if wanted is None else _bearing(counts, keys, wanted)
    if not kept.any():
        return
    out = {"place": place + np.flatnonzero(kept), "id": pa.array(ids[kept])} | {n: pa.array(v[kept]) for n, v in more.items()}
    if refs is not None:
        n, r = _some(kept, *refs)
        out["refs"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(_sums(n, r)))
    if "tags" in columns:
        n, k, v = _some(kept, counts, keys, values)
        out["tags"] = _maps(n, k, v, strings)
    yield out


@dataclass
class Range(InputPartition):
    path: str
    size: int
    begin: int
    end: int


class ExtractReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.columns, self.kind = schema.names, options.get("kind", "node")
        self.paths = json.loads(options["files"]) if "files" in options else [options["path"]]
        self.split, self.strict = int(options.get("split", SPLIT)), options.get("strict", "true").lower() == "true"
        self.having = [k for k in options.get("having", "").split(",") if k]

    def partitions(self) -> list[Range]:
        return [Range(path, size, at, min(at + self.split, size)) for path, size in sizes(self.paths) for at in range(0, size, self.split)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        for at, block in Blobs(partition.path, partition.size, partition.begin, partition.end, self.strict):
            for group in block_batches(block, self.kind, self.columns, self.having):
                n = len(group["place"])
                group["seq"] = pa.StructArray.from_arrays([pa.array([partition.path] * n, pa.string()), pa.array((at << 20) + group["place"])], fields=list(_SEQ))
                yield pa.RecordBatch.from_arrays([group[c] for c in self.columns], self.columns)


def _coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers as variable-length integers: the bytes of all, and how many each has."""
    values = values.astype(np.uint64)
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    width = max(1, -(-int(values.max()).bit_length() // 7))
    groups = values[:, None] >> (np.uint64(7) * np.arange(width, dtype=np.uint64))
    used = np.maximum(1, (groups > 0).sum(axis=1))
    inside = np.arange(width) < used[:, None]
    more = np.arange(width) < used[:, None] - 1
    return (((groups & np.uint64(127)).astype(np.uint8)) | (more.astype(np.uint8) << 7))[inside], used


def varints(values: np.ndarray) -> bytes:
    """Unsigned numbers as variable-length integers."""
    return _coded(values)[0].tobytes()


def _zigzag(d: np.ndarray) -> np.ndarray:
    return ((d << 1) ^ (d >> 63)).view(np.uint64)


def deltas(values: np.ndarray) -> bytes:
    """Signed numbers, each as the zigzag-coded difference from the one before."""
    return varints(_zigzag(np.diff(values, prepend=0)))


def _number(value: int) -> bytes:
    value, out = value & ((1 << 64) - 1), bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _number(number << 3) + _number(value)
    return _number(number << 3 | 2) + _number(len(value)) + value


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, list[pa.Array]]:
    """Length of each list or map (0 if null), and what they hold: values, or keys and values."""
    lists = lists.combine_chunks() if lists.num_chunks != 1 else lists.chunk(0)
    offsets, there = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
    held = [lists.keys, lists.items] if pa.types.is_map(lists.type) else [lists.values]
    held = [h.slice(offsets[0], offsets[-1] - offsets[0]) for h in held]
    counts = np.diff(offsets)
    if not there.all():
        held = [h.filter(pa.array(np.repeat(there, counts))) for h in held]
    return np.where(there, counts, 0).astype(np.int64), held


def _sliced(counts: np.ndarray, values: np.ndarray) -> Iterator[bytes]:
    """Each list's numbers as variable-length integers."""
    data, used = _coded(values)
    ends = np.concatenate(([0], np.cumsum(used)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
    data = data.tobytes()
    return (data[a:b] for a, b in zip(ends, ends[1:], strict=False))


def block_of(rows: pa.Table) -> bytes:
    """A primitive block of nodes (id, lat, lon, tags) or ways (id, refs, tags)."""
    counts, (keys, values) = _flat(rows.column("tags"))
    coded = pa.chunked_array([keys.cast(pa.string()), values.cast(pa.string()).fill_null("")]).combine_chunks().dictionary_encode()
    numbers = coded.indices.to_numpy().astype(np.int64) + 1  # 0 stands for no string
    keys, values = np.split(numbers, 2)
    ids = rows.column("id").to_numpy()
    if "lat" in rows.column_names:
        lat, lon = (np.rint(rows.column(c).to_numpy() * 1e7).astype(np.int64) for c in ("lat", "lon"))
        # The pairs of each node stand before a 0, so a pair has as many zeros before it as nodes.
        at, listed = 2 * np.arange(len(keys)) + np.repeat(np.arange(len(counts)), counts), np.zeros(2 * len(keys) + len(counts), np.int64)
        listed[at], listed[at + 1] = keys, values
        group = field(2, field(1, deltas(ids)) + field(8, deltas(lat)) + field(9, deltas(lon)) + field(10, varints(listed)))
    else:
        n, (refs,) = _flat(rows.column("refs"))
        refs = refs.to_numpy(zero_copy_only=False).astype(np.int64)
        steps = np.diff(refs, prepend=0)
        begins = (np.cumsum(n) - n)[n > 0]
        steps[begins] = refs[begins]
        every = zip(ids.tolist(), _sliced(counts, keys), _sliced(counts, values), _sliced(n, _zigzag(steps)), strict=True)
        group = b"".join(field(3, field(1, i) + field(2, k) + field(3, v) + field(8, r)) for i, k, v, r in every)
    return field(1, b"".join(field(1, s.encode()) for s in ["", *coded.dictionary.to_pylist()])) + field(2, group)


def blob_of(kind: bytes, block: bytes) -> bytes:
    """A length-prefixed blob, packed by zlib."""
    blob = field(2, len(block)) + field(3, zlib.compress(block))
    head = field(1, kind) + field(3, len(blob))
    return len(head).to_bytes(4, "big") + head + blob


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class ExtractWriter(DataSourceArrowWriter):
    """A file a task under a hidden name; the commit renames the files of those tasks that count."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, place = store(self.path)
        system.create_dir(place)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.osm.pbf"
        with system.open_output_stream(f"{place}/_{name}") as out:
            out.write(blob_of(b"OSMHeader", field(4, b"OsmSchema-V0.6") + field(4, b"DenseNodes")))
            for batch in iterator:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    out.write(blob_of(b"OSMData", block_of(pa.Table.from_batches([batch.slice(at, BLOCK_ROWS)]))))
        return Written(f"{place}/_{name}", f"{place}/{name}")

    def commit(self, messages: list[Written | None]) -> None:
        system, place = store(self.path)
        if self.overwrite and system.get_file_info(place).type == pa.fs.FileType.Directory:
            for f in system.get_file_info(pa.fs.FileSelector(place)):
                if f.is_file and f.base_name.endswith(".osm.pbf") and not f.base_name.startswith("_"):
                    system.delete_file(f.path)
        for m in messages:
            if m is not None:
                system.move(m.temporary, m.final)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = store(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.temporary)


class MapExtract(DataSource):
    @classmethod
    def name(cls) -> str:
        return "map_extract"

    def schema(self) -> T.StructType:
        every = WAYS if self.options.get("kind") == "way" else NODES
        wanted = [c for c in self.options.get("columns", "").replace(" ", "").split(",") if c]
        return T.StructType([every[c] for c in wanted]) if wanted else every

    def reader(self, schema: T.StructType) -> ExtractReader:
        return ExtractReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> ExtractWriter:
        return ExtractWriter(self.options["path"], overwrite)


def extract_rows(spark: SparkSession, files: list[str] | str, kind: str, columns: str = "", having: str = "", strict: bool = True, split: int = SPLIT) -> DataFrame:
    """Nodes or ways of extracts, with only those columns and rows that are asked for."""
    spark.dataSource.register(MapExtract)
    asked = {"kind": kind, "columns": columns, "having": having, "strict": str(strict).lower(), "split": str(split), "files": json.dumps([files] if isinstance(files, str) else files)}
    return spark.read.format("map_extract").options(**asked).load()


def read_extracts(spark: SparkSession, files: list[str] | str, strict: bool = True, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) with NODES and WAYS."""
    return tuple(extract_rows(spark, files, kind, "", "", strict, split) for kind in ("node", "way"))


def write_extract(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Nodes (id, lat, lon, tags) or ways (id, refs, tags) as extract files below ``path``, one a partition in their order."""
    rows.sparkSession.dataSource.register(MapExtract)
    rows.write.format("map_extract").mode(mode).save(path)
