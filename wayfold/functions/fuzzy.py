"""Partial similarity of strings as an Arrow-batched function, for what column expressions cannot say.

All pairs of a batch are compared in lanes.  For every place of the longer string a bit row says which characters of
the shorter one stand there; the longest common subsequence of all windows of all pairs then grows by three array
operations a step (bit rows of the dynamic programme), as many steps as the shorter string has characters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of the shorter string that fit one bit row.
ROW = 64
#: Bit rows held at once.
CELLS = 1 << 18


def _common(masks: dict[str, int], n: int, text: str) -> int:
    """Length of the longest common subsequence with a pattern of n characters, by bit rows."""
    row = (1 << n) - 1
    for ch in text:
        m = row & masks.get(ch, 0)
        row = (row + m) | (row - m)
    return n - bin(row & ((1 << n) - 1)).count("1")


def similarity(a: str | None, b: str | None) -> float | None:
    """0..100: the shorter string against its best-matching window in the longer one, windows at the ends included.

    Windows count by 2 * common / (both lengths), common being the longest common subsequence.  Null if either is
    null; two empty strings are equal, one empty string matches nothing.  One pair at a time: for patterns of more than
    ROW characters.
    """
    if a is None or b is None:
        return None
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    n, masks = len(short), {}
    for i, ch in enumerate(short):
        masks[ch] = masks.get(ch, 0) | 1 << i
    best = 0.0
    for end in range(1, len(long) + n):
        lo, hi = max(0, end - n), min(len(long), end)
        if 2 * (hi - lo) / (n + hi - lo) > best and (long[hi - 1] in masks or long[lo] in masks):
            best = max(best, 2 * _common(masks, n, long[lo:hi]) / (n + hi - lo))
    return 100 * best


def _points(texts: list[str], width: int) -> np.ndarray:
    """Code points, a row a text; places behind its end hold no character."""
    out = np.full((len(texts), width), 0xFFFFFFFF, np.uint32)
    sizes = np.array([len(t) for t in texts])
    out[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _lanes(short: list[str], long: list[str]) -> np.ndarray:
    """Similarity of pairs whose shorter strings have the same length (1 to ROW)."""
    n, sizes = len(short[0]), np.array([len(t) for t in long])
    width = int(sizes.max())
    pattern, text = _points(short, n), _points(long, width)
    # Bit i of here[p, n - 1 + j]: character i of the pattern stands at j.  Beyond both ends nothing does.
    here = np.zeros((len(short), width + 2 * (n - 1)), np.uint64)
    for i in range(n):
        here[:, n - 1 : n - 1 + width] |= (text == pattern[:, i, None]).astype(np.uint64) << np.uint64(i)
    windows = width + n - 1
    row = np.full((len(short), windows), (1 << n) - 1, np.uint64)
    for k in range(n):
        met = row & here[:, k : k + windows]
        row = (row + met) | (row - met)
    common = n - np.bitwise_count(row & np.uint64((1 << n) - 1)).astype(np.int64)
    end = np.arange(1, windows + 1)
    inside = np.minimum(end, sizes[:, None]) - np.maximum(0, end - n)
    return 100 * np.where(inside > 0, 2 * common / (n + np.maximum(inside, 1)), 0.0).max(axis=1)


def similarities(pairs: list[tuple[str, str]]) -> np.ndarray:
    """``similarity`` of many pairs without nulls."""
    out = np.zeros(len(pairs))
    ordered = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    sizes = np.array([(len(s), len(t)) for s, t in ordered]).reshape(-1, 2)
    for k in np.flatnonzero((sizes[:, 0] == 0) | (sizes[:, 0] > ROW)):
        out[k] = similarity(*ordered[k])
    lanes = np.flatnonzero((sizes[:, 0] > 0) & (sizes[:, 0] <= ROW))
    lanes = lanes[np.lexsort((sizes[lanes, 1], sizes[lanes, 0]))]
    at = 0
    while at < len(lanes):
        n, to = sizes[lanes[at], 0], at + 1
        # Pairs of one pattern length, the texts of similar lengths, as many as fit.
        while to < len(lanes) and sizes[lanes[to], 0] == n and (to + 1 - at) * (sizes[lanes[to], 1] + 2 * n) <= CELLS and sizes[lanes[to], 1] <= 2 * sizes[lanes[at], 1] + 16:
            to += 1
        own = lanes[at:to]
        out[own] = _lanes([ordered[k][0] for k in own], [ordered[k][1] for k in own])
        at = to
    return out


@F.pandas_udf(T.DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple, int] = {}
    rows = [known.setdefault(pair, len(known)) for pair in zip(a, b, strict=True)]
    given = {pair: at for pair, at in known.items() if None not in pair}
    value = np.full(len(known), np.nan)
    value[list(given.values())] = similarities(list(given))
    return pd.Series(value[rows], dtype="float64")
