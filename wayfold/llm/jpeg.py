"""Baseline JPEG in numpy: marker parsing, Huffman coding and decoding of many scans at once, DC-only thumbnails.

Entropy-coded data is cut into restart intervals, which do not depend on each other.  The decoder takes one
interval as a lane and steps through all lanes of a batch together, one symbol of every lane at a time, so that
each step is a few array operations however many images a batch has.  The encoder writes grey images whose
coefficients are given, in restart intervals of RESTART blocks.
"""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass

import numpy as np

RESTART = 8
#: Blocks along a side of an image: 8 * 8191 pixels is the most that baseline headers can state.
MOST_BLOCKS = 8191
_SIZE = np.array([abs(v).bit_length() for v in range(-4096, 4096)], np.int64)


def zigzag() -> np.ndarray:
    """Row-major index of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


@dataclass(frozen=True)
class Huffman:
    """A table as a DHT segment has it: codes of each length 1..16, and the symbols in code order."""

    counts: tuple[int, ...]
    symbols: bytes

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """Code and length by symbol; length 0 where the symbol has none."""
        code, length = np.zeros(256, np.uint64), np.zeros(256, np.int64)
        at = value = 0
        for n, count in enumerate(self.counts, 1):
            for s in self.symbols[at : at + count]:
                code[s], length[s] = value, n
                value += 1
            at += count
            value <<= 1
        return code, length

    def lookup(self) -> np.ndarray:
        """For the next 16 bits: code length | value bits << 5 | both << 10 | zeros before << 16; a block's end has 64 zeros."""
        out = np.zeros(1 << 16, np.int32)
        code, length = self.codes()
        for s in self.symbols:
            n, size, run = int(length[s]), s & 15, s >> 4
            first = int(code[s]) << (16 - n)
            out[first : first + (1 << (16 - n))] = n | size << 5 | (n + size) << 10 | (64 if s == 0 else run) << 16
        return out


def huffman_for(weights: dict[int, float]) -> Huffman:
    """Codes of at most 16 bits, none of ones alone, for the weights of the symbols."""
    heap = [(w, -s, [s]) for s, w in weights.items()] + [(0.0, -999, [-1])]
    heapq.heapify(heap)
    depth = dict.fromkeys([*weights, -1], 0)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    lengths = sorted(min(16, d) for d in depth.values())
    while sum(1 << (16 - n) for n in lengths) > 1 << 16:  # too many at the limit: lengthen the longest code below it
        k = max(i for i, n in enumerate(lengths) if n < 16)
        lengths[k] += 1
        lengths.sort()
    lengths.pop()  # one of the longest codes, at the end of the order, stays unused
    return Huffman(tuple(lengths.count(n) for n in range(1, 17)), bytes(sorted(weights, key=lambda s: (-weights[s], s))))


#: Shares of amplitude sizes 0..11 that the encoder's tables are made for (fixed values).
AMPLITUDES = (0.17, 0.2, 0.27, 0.21, 0.08, 0.02, 0.025, 0.02, 0.004, 1e-6, 1e-7, 1e-7)
DC_TABLE = huffman_for(dict(enumerate((0.05, 0.1, 0.15, 0.2, 0.2, 0.12, 0.1, 0.05, 0.03, 1e-3, 1e-5, 1e-6))))
AC_TABLE = huffman_for({0: 1e-3, 0xF0: 1e-6} | {r << 4 | s: 0.17**r * AMPLITUDES[s] for r in range(16) for s in range(1, 11)})
_DC_CODE, _DC_LENGTH = DC_TABLE.codes()
_AC_CODE, _AC_LENGTH = AC_TABLE.codes()


def encode_intervals(blocks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes, without stuffing, of (n, 64) coefficients in zigzag order, and where each interval
    begins in them (one more at the end); ``first``: the first block of each interval, at block 0 the first."""
    n = len(blocks)
    flat = blocks.astype(np.int64).ravel()
    dc = flat[::64].copy()
    diff = dc.copy()
    diff[1:] -= dc[:-1]
    diff[first] = dc[first]
    has = flat != 0
    has[::64] = True
    at = np.flatnonzero(has)
    value = flat[at]
    is_dc = (at & 63) == 0
    value[is_dc] = diff
    run = np.empty(len(at), np.int64)
    run[0] = 0
    run[1:] = at[1:] - at[:-1] - 1
    run[is_dc] = 0
    size = _SIZE[value + 4096]
    symbol = (run & 15) << 4 | size
    code = np.where(is_dc, _DC_CODE[size], _AC_CODE[symbol])
    length = np.where(is_dc, _DC_LENGTH[size], _AC_LENGTH[symbol])
    low = np.where(value < 0, value + (np.int64(1) << size) - 1, value).astype(np.uint64)
    last = np.append(np.flatnonzero(is_dc)[1:] - 1, len(at) - 1)  # each block's last item
    ends = np.zeros(len(at), bool)
    ends[last] = (at[last] & 63) < 63
    pads = np.zeros(len(at), bool)
    pads[last[np.append(first[1:], n) - 1]] = True
    zrl = run >> 4
    items = zrl + 1 + ends + pads
    stop = np.cumsum(items)
    begin = stop - items
    codes = np.full(stop[-1], _AC_CODE[0xF0], np.uint64)
    lengths = np.full(stop[-1], _AC_LENGTH[0xF0], np.int64)
    own = begin + zrl
    codes[own] = code << size.astype(np.uint64) | low
    lengths[own] = length + size
    codes[own[ends] + 1], lengths[own[ends] + 1] = _AC_CODE[0], _AC_LENGTH[0]
    pad = stop[pads] - 1
    lengths[pad] = 0
    starts = np.concatenate(([0], pad[:-1] + 1))
    fill = -np.add.reduceat(lengths, starts) % 8
    lengths[pad], codes[pad] = fill, (np.uint64(1) << fill.astype(np.uint64)) - np.uint64(1)
    to = np.cumsum(lengths)
    off = to - lengths
    word = off >> 5
    wide = codes << (64 - (off & 31) - lengths).clip(0, 63).astype(np.uint64)
    out = np.zeros(int(to[-1] >> 5) + 2, np.uint64)
    group = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[group]] = np.bitwise_or.reduceat(wide >> np.uint64(32), group)
    spill = wide & np.uint64(0xFFFFFFFF)
    over = np.flatnonzero(spill)
    out[word[over] + 1] |= spill[over]
    return out.astype(">u4").view(np.uint8)[: to[-1] >> 3], np.append(off[starts] >> 3, to[-1] >> 3)


def stuffed(raw: np.ndarray, begin: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``raw`` with a 0 after each 255 and a restart marker before each interval whose ``number`` in its image is
    over 0; and where each interval (with its marker) begins now (one more at the end)."""
    full = np.flatnonzero(raw == 255) + 1
    marked = begin[:-1][number > 0]
    marks = np.full((len(marked), 2), 255, np.uint8)
    marks[:, 1] = 0xD0 + (number[number > 0] - 1) % 8
    where = np.concatenate([full, np.repeat(marked, 2)])
    order = np.argsort(where, kind="stable")
    out = np.insert(raw, where[order], np.concatenate([np.zeros(len(full), np.uint8), marks.ravel()])[order])
    at = begin + np.searchsorted(full, begin, "right") + 2 * np.searchsorted(marked, begin, "left")
    return out, at


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


_QUANT = _segment(0xDB, bytes([0]) + bytes([1]) * 64)
_TABLES = _segment(0xC4, bytes([0x00, *DC_TABLE.counts]) + DC_TABLE.symbols) + _segment(0xC4, bytes([0x10, *AC_TABLE.counts]) + AC_TABLE.symbols)
_SCAN = _segment(0xDD, struct.pack(">H", RESTART)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def grey_header(width: int, height: int, comment: bytes) -> bytes:
    """All of a grey baseline file before its scan; quantiser steps are 1."""
    frame = _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0]))
    return b"\xff\xd8" + _segment(0xFE, comment) + _QUANT + frame + _TABLES + _SCAN


END = b"\xff\xd9"


@dataclass
class Parsed:
    """What the markers of a baseline file state."""

    width: int
    height: int
    comment: bytes
    steps: dict[int, np.ndarray]
    parts: list[tuple[int, int, int, int]]  # component id, horizontal and vertical sampling, quantiser
    tables: dict[int, Huffman]
    restart: int
    pattern: tuple[tuple[int, int, int], ...]  # for each block of an MCU: component, DC table, AC table
    mcus: tuple[int, int]
    scan: tuple[int, int]

    @property
    def shape(self) -> tuple:
        """Images of equal shape can be decoded together."""
        return self.pattern, tuple(sorted(self.tables.items()))


def parse(data: bytes) -> Parsed:
    """Markers of a baseline JPEG; ValueError for anything else."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    at, comment, restart = 2, b"", 0
    steps: dict[int, np.ndarray] = {}
    tables: dict[int, Huffman] = {}
    frame = None
    while at + 4 <= len(data):
        if data[at] != 255:
            raise ValueError(f"no marker at byte {at}")
        kind, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if kind == 0xFE:
            comment = body
        elif kind == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif kind == 0xDB:
            while body:
                wide = body[0] >> 4
                steps[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                body = body[65 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                counts = tuple(body[1:17])
                tables[body[0]] = Huffman(counts, body[17 : 17 + sum(counts)])
                body = body[17 + sum(counts) :]
        elif kind == 0xC0:
            frame = struct.unpack(">BHH", body[:5]), [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
        elif 0xC0 < kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("only baseline frames are read")
        elif kind == 0xDA:
            if frame is None or body[0] != len(frame[1]):
                raise ValueError("one scan of all components is read")
            (_, height, width), parts = frame
            of = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            if len(parts) == 1:
                parts = [(parts[0][0], 1, 1, parts[0][3])]
            pattern = tuple((c, of[p[0]] >> 4, of[p[0]] & 15) for c, p in enumerate(parts) for _ in range(p[1] * p[2]))
            wide, high = 8 * max(p[1] for p in parts), 8 * max(p[2] for p in parts)
            stop = data.rfind(END, at)
            return Parsed(width, height, comment, steps, parts, tables, restart, pattern, (-(-height // high), -(-width // wide)), (at, stop if stop >= 0 else len(data)))
    raise ValueError("no scan")


_HALF = np.array([0] + [1 << (s - 1) for s in range(1, 16)], np.int64)
_LOW = np.array([(1 << s) - 1 for s in range(16)], np.int64)


def decode_scans(images: list[Parsed], data: list[bytes]) -> list[np.ndarray]:
    """Quantised coefficients (blocks, 64), in zigzag and scan order, of images that have one ``shape``."""
    head = images[0]
    each = len(head.pattern)
    raw = np.frombuffer(b"".join(d[p.scan[0] : p.scan[1]] for p, d in zip(images, data, strict=True)) + bytes(8), np.uint8)
    start = np.cumsum([0, *(p.scan[1] - p.scan[0] for p in images)])
    after = np.append(raw[1:], np.uint8(0))
    full = raw == 255
    mark = full & (after >= 0xD0) & (after <= 0xD7)
    mark_at = np.flatnonzero(mark)
    drop = mark.copy()
    drop[mark_at + 1] = True
    drop[np.flatnonzero(full & (after == 0)) + 1] = True
    drop[-8:] = False
    kept = np.cumsum(~drop) - ~drop  # place of each byte among those kept
    bits = raw[~drop].astype(np.uint64)
    window = np.zeros(len(bits), np.uint64)
    for k in range(5):
        window[: len(bits) - k] |= bits[k:] << np.uint64(32 - 8 * k)

    lane_pos, lane_block, lane_left = [], [], []
    blocks = np.cumsum([0, *(p.mcus[0] * p.mcus[1] * each for p in images)])
    for i, p in enumerate(images):
        own = mark_at[np.searchsorted(mark_at, start[i]) : np.searchsorted(mark_at, start[i + 1])]
        total, span = blocks[i + 1] - blocks[i], (p.restart or p.mcus[0] * p.mcus[1]) * each
        n = -(-total // span)
        if n != len(own) + 1:
            raise ValueError("restart markers do not fit the frame")
        if total > 4 * (p.scan[1] - p.scan[0]):  # a block has at least two codes of a bit
            raise ValueError("the scan is too short for the frame")
        lane_pos.append(8 * kept[np.concatenate(([start[i]], own + 2))])
        lane_block.append(blocks[i] + span * np.arange(n))
        lane_left.append(np.minimum(span, total - span * np.arange(n)))
    pos, block, left = map(np.concatenate, (lane_pos, lane_block, lane_left))

    lookups = {key: k << 16 for k, key in enumerate(sorted(head.tables))}
    lut = np.concatenate([head.tables[key].lookup() for key in lookups])
    comp = np.array([c for c, _, _ in head.pattern])
    dc_table = np.array([lookups[t] for _, t, _ in head.pattern])
    ac_table = np.array([lookups[0x10 | t] for _, _, t in head.pattern])
    out = np.zeros(64 * (blocks[-1] + 1), np.int16)
    spare = 64 * blocks[-1]
    base, k, done = block * 64, np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    pred = np.zeros((len(pos), comp.max() + 1), np.int64)
    table = np.full(len(pos), dc_table[0])
    edge = 8 * (len(bits) - 8)
    step = 0
    while len(pos):
        w = window[pos >> 3] << (24 + (pos & 7)).astype(np.uint64)
        t = lut[table + (w >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        size = (t >> 5) & 31
        v = ((w << (t & 31).astype(np.uint64)) >> (63 - size).astype(np.uint64) >> np.uint64(1)).astype(np.int64)
        v -= np.where(v < _HALF[size], _LOW[size], 0)
        first = np.flatnonzero(k == 0)
        if len(first):
            c = comp[done[first] % each]
            pred[first, c] += v[first]
            v[first] = pred[first, c]
            table[first] = ac_table[done[first] % each]
            t[first] &= 0xFFFF  # a DC symbol has no zeros before it
        run = t >> 16
        out[base + np.minimum(k + run, 63)] = v
        k += run + 1
        pos += (t >> 10) & 63
        over = np.flatnonzero(k >= 64)
        if len(over):
            k[over] = 0
            base[over] += 64
            done[over] += 1
            table[over] = dc_table[done[over] % each]
            base[over[done[over] >= left[over]]] = spare
        step += 1
        if step % 32 == 0:
            live = np.flatnonzero((done < left) & (pos <= edge))
            if len(live) < len(pos):
                pos, base, k, done, left, pred, table = pos[live], base[live], k[live], done[live], left[live], pred[live], table[live]
        else:
            np.minimum(pos, edge, out=pos)
    whole = out[:spare].reshape(-1, 64)
    return [whole[blocks[i] : blocks[i + 1]] for i in range(len(images))]


def luminance(image: Parsed, coefficients: np.ndarray) -> np.ndarray:
    """The thumbnail of one pixel for each 8 x 8 luminance block, from DC coefficients alone (0..255)."""
    rows, cols = image.mcus
    _, h, v, quantiser = image.parts[0]
    own = np.flatnonzero([c == 0 for c, _, _ in image.pattern])
    dc = coefficients[:, 0].reshape(rows * cols, len(image.pattern))[:, own].astype(np.int64)
    grid = dc.reshape(rows, cols, v, h).transpose(0, 2, 1, 3).reshape(rows * v, cols * h)
    step = int(image.steps[quantiser][0])
    return np.clip((grid * step + 4) // 8 + 128, 0, 255).astype(np.uint8)


def average_hash(thumbnail: np.ndarray) -> str:
    """64 bits in hex: cells of an 8 x 8 grid over the thumbnail that are brighter than their mean."""
    for axis in (0, 1):
        n = thumbnail.shape[axis]
        edges = np.arange(9) * n // 8
        sums = np.concatenate([np.zeros_like(np.take(thumbnail, [0], axis), np.int64), np.cumsum(thumbnail, axis, dtype=np.int64)], axis)
        low, high = np.minimum(edges[:-1], n - 1), np.maximum(edges[1:], np.minimum(edges[:-1], n - 1) + 1)
        thumbnail = (np.take(sums, high, axis) - np.take(sums, low, axis)) * 256 // (high - low).reshape((-1, 1) if axis == 0 else (1, -1))
    return np.packbits(thumbnail > thumbnail.mean()).tobytes().hex()
