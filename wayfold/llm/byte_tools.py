"""Vectorised word work on the UTF-8 buffers of Arrow batches (numpy, inside Spark tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a task; a longer single text is handled alone.
SLICE_BYTES = 1 << 19
#: The same where each slice is merged into a tally.
TALLY_BYTES = 1 << 20
WORD = np.ones(256, bool)
WORD[[32, 9, 10, 11, 12, 13]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_P = pow(0x9E3779B97F4A7C15, 1, 1 << 64)
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    size = max(SLICE_BYTES + 1, n)
    if size not in _powers:
        both = []
        for base in (_P, _P_INV):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            both.append(np.cumprod(a, dtype=np.uint64))
        if size > SLICE_BYTES + 1:
            return both[0], both[1]
        _powers[size] = both[0], both[1]
    return _powers[size]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets into bytes) over runs of rows of about ``limit`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, to, raw[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def words(buf: np.ndarray, off: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text, and where each text's words begin (len(texts) + 1); ``table``: bytes of words."""
    is_word = table[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before = np.empty(len(buf), bool)
    if len(buf):
        before[0] = False
        before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | edge[:-1]))
    after = np.empty(len(buf), bool)
    if len(buf):
        after[-1] = False
        after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_numbers(buf: np.ndarray, off: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """The number of each word in an exact dictionary, that dictionary, where each text's words begin, and where each word starts."""
    starts, ends, first = words(buf, off, table)
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    spelt = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buf[table[buf]])])
    coded = spelt.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, first, starts


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, equal for equal bytes wherever they stand."""
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles and where each text's begin; a text of 1 to n - 1 words is one shingle."""
    counts = np.diff(first)
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    begin = np.concatenate(([0], np.cumsum(made)))
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    row = np.repeat(np.arange(len(counts)), made)
    pos = first[row] + np.arange(begin[-1]) - begin[row]
    length = np.minimum(counts[row], n)
    last = len(hashes) - 1
    h = mixed(length.astype(np.uint64))
    for k in range(n):
        here = hashes[np.minimum(pos + k, last)]
        h = np.where(k < length, mixed(h * np.uint64(0x2545F4914F6CDD1D) + here), h)
    return h, begin


def padded(buf: np.ndarray, off: np.ndarray, before: int, after: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text with ``before`` fill bytes ahead and ``after`` behind, and the offsets of the longer texts."""
    n = len(off) - 1
    new = off + (before + after) * np.arange(n + 1)
    out = np.full(int(new[-1]), fill, np.uint8)
    row = np.repeat(np.arange(n), np.diff(off))
    out[np.arange(len(buf)) + (before + after) * row + before] = buf
    return out, new


class Tally:
    """Counts of 64-bit keys, merged as sorted arrays."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        both, inverse = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        self.counts = np.bincount(inverse, np.concatenate([self.counts, counts]).astype(float), len(both)).astype(np.int64)
        self.keys = both
