"""Media columns as baseline JPEG: payload bytes as quantised coefficients, read back with dimensions and hashes.

A payload byte is one coefficient of a grey image with quantiser steps of 1, so the file keeps it without loss;
64 bytes are one block in zigzag order.  Frequent text bytes get small amplitudes by a fixed order.  The image is
about as wide as high; blocks of zeros fill its last row, and the comment segment states the unpadded length.

``read_media`` reads any baseline JPEG: dimensions, the DC-only luminance thumbnail and its hashes; for files of
``text_media`` it also gives the payload's checks.  Files are written to and read from a stored table.

Defined cases: null text is empty: 64 bytes 0.  Equal texts give equal files.  Null, empty, damaged or other media:
dimensions, hashes and payload columns null; files read beside them are not affected.  Repeated rows are kept; an empty table gives an empty result.
Long texts are coded in runs of restart intervals, so arrays beside the text itself stay small.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.byte_tools import slices
from wayfold.llm.jpeg import END, MOST_BLOCKS, RESTART, average_hash, decode_scans, encode_intervals, grey_header, luminance, parse, stuffed
from wayfold.llm.scratch import stored

#: Bytes in the order of their amplitudes 0, 1, -1, 2, -2 ... (fixed values; bytes not listed follow by value).
ORDER = b" etanoirshdlucmfpgwyb,.vk\n\xc3-'xjqz|TAIEDSLROUPCMNHBFGWVKYJQXZ0123456789"
_order = np.array([*ORDER, *(b for b in range(256) if b not in ORDER)])
TO_COEFFICIENT = np.zeros(256, np.int16)
TO_COEFFICIENT[_order] = [(r + 1) // 2 if r % 2 else -(r // 2) for r in range(256)]
TO_BYTE = np.zeros(257, np.uint8)
TO_BYTE[TO_COEFFICIENT + 128] = np.arange(256)
#: Intervals coded or decoded at once.
RUN = 4096
#: What reading a damaged file may raise.
DAMAGED = (ValueError, IndexError, KeyError, struct.error)


def text_image(buf: np.ndarray, off: np.ndarray) -> list[bytes]:
    """A JPEG file for each text."""
    n = np.diff(off)
    blocks = np.maximum(1, -(-n // 64))
    wide = np.minimum(MOST_BLOCKS, np.ceil(np.sqrt(blocks)).astype(np.int64))
    high = -(-blocks // wide)
    if high.max(initial=0) > MOST_BLOCKS:
        raise ValueError("a text has more blocks than an image can have")
    area = wide * high
    first = np.concatenate(([0], np.cumsum(area)))
    coefficients = np.zeros(int(first[-1]) * 64, np.int16)
    at = np.arange(len(buf)) + np.repeat(first[:-1] * 64 - off[:-1], n)
    coefficients[at] = TO_COEFFICIENT[buf]
    padding = blocks * 64 - n
    rows = np.repeat(np.arange(len(n)), padding)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(padding) - padding, padding)
    coefficients[first[rows] * 64 + n[rows] + within] = TO_COEFFICIENT[0]
    coefficients = coefficients.reshape(-1, 64)
    intervals = -(-area // RESTART)
    row = np.repeat(np.arange(len(n)), intervals)
    number = np.arange(len(row)) - np.repeat(np.cumsum(intervals) - intervals, intervals)
    begin = np.append(first[row] + RESTART * number, first[-1])
    scans: list[list[bytes]] = [[] for _ in n]
    for lo in range(0, len(row), RUN):
        hi = min(len(row), lo + RUN)
        raw, edges = encode_intervals(coefficients[begin[lo] : begin[hi]], begin[lo:hi] - begin[lo])
        data, edges = stuffed(raw, edges, number[lo:hi])
        data = data.tobytes()
        cuts = np.flatnonzero(np.diff(row[lo:hi], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], hi - lo], strict=True):
            scans[row[lo + a]].append(data[edges[a] : edges[b]])
    return [b"".join([grey_header(8 * w, 8 * h, int(k).to_bytes(8, "big")), *scan, END]) for w, h, k, scan in zip(wide.tolist(), high.tolist(), n, scans, strict=True)]


def text_media(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and media: the file of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, buf, off in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(text_image(buf, off), pa.binary())], ["id", "media"])

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id bigint, media binary")


def _decoded(files: list[bytes | None]) -> list[tuple | None]:
    """(parsed, coefficients) of each readable file, those of one shape decoded together in runs of RUN intervals."""
    out: list[tuple | None] = [None] * len(files)
    groups: dict[tuple, list[tuple]] = {}
    for i, data in enumerate(files):
        try:
            image = parse(data or b"")
            groups.setdefault(image.shape, []).append((i, image))
        except DAMAGED:
            continue
    for found in groups.values():
        at = 0
        while at < len(found):
            size, to = 0, at
            while to < len(found) and (to == at or size < RUN):
                image = found[to][1]
                total = image.mcus[0] * image.mcus[1]
                size += -(-total // (image.restart or total or 1))
                to += 1
            for some in (found[at:to], *([one] for one in found[at:to])):
                try:
                    made = decode_scans([p for _, p in some], [files[i] for i, _ in some])
                except DAMAGED:
                    continue  # then each file alone
                for (i, image), c in zip(some, made, strict=True):
                    out[i] = image, c
                if len(some) == to - at:
                    break
            at = to
    return out


def _features(data: bytes | None, found: tuple | None) -> tuple:
    if found is None:
        return (None,) * 10
    image, coefficients = found
    try:
        thumbnail = luminance(image, coefficients)
    except DAMAGED:
        return (None,) * 10
    shown = hashlib.sha256(thumbnail.tobytes()).hexdigest()
    mean = average_hash(thumbnail)
    seen = (image.width, image.height, mean, shown, len(data), hashlib.sha256(data).hexdigest())
    n = int.from_bytes(image.comment, "big") if len(image.comment) == 8 else -1
    size = max(64, -(-n // 64) * 64)
    if n < 0 or size > coefficients.size or len(image.parts) > 1:
        return (*seen, None, None, None, None)
    payload = TO_BYTE[np.clip(coefficients.reshape(-1)[:size], -128, 128) + 128].tobytes()
    return (*seen, n, size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


FIELDS = "width int, height int, average_hash string, thumbnail_sha256 string, media_bytes bigint, media_sha256 string, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint"


def read_media(media: DataFrame, id: str = "id", column: str = "media") -> DataFrame:
    """id and FIELDS for every row: dimensions, thumbnail hashes and payload checks of its file."""
    schema = pa.schema([("id", pa.int64())] + [(n, {"int": pa.int32(), "string": pa.string(), "bigint": pa.int64()}[t]) for n, t in (x.split() for x in FIELDS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(1)
            rows = math.ceil(files.nbytes / (1 << 21)) or 1
            each = max(1, len(files) // rows)
            for at in range(0, len(files), each):
                part = files.slice(at, each).to_pylist()
                made = [_features(d, f) for d, f in zip(part, _decoded(part), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, each), *(pa.array(c, t) for c, t in zip(zip(*made, strict=True), schema.types[1:], strict=True))], schema=schema)

    return media.select(F.col(id).cast("long").alias("id"), F.col(column).alias("media")).mapInArrow(run, f"id bigint, {FIELDS}")


def op1_media_jpeg(spark, sf_dir: str) -> DataFrame:
    """Payload and file checks and thumbnail features of every document, read back from the stored JPEG files; null text is empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    feature = F.concat_ws(":", F.concat_ws("x", "width", "height"), "average_hash", F.substring("thumbnail_sha256", 1, 16))
    return read_media(stored(text_media(docs))).select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "width", "height", "thumbnail_sha256")
