"""Periodic runs of words, by probing a harmonic grid.

A run of period p is a stretch of words in which words p apart are identical.  A stretch of ``times`` (at least 3)
periods holds a whole grid cell [jp, (j+1)p] of equal words, wherever it begins.  So, period by period:

1. Word equality is tested at jp against (j+1)p for every j: n / p tests, n ln n over all periods.  A grid point
   goes on if its own test and the next one hold.
2. Grid points within a found run of a period that divides p are left out: their stretch is that run (two stretches
   of periods q and kq that share kq words are one stretch).  So every run is found once, by its smallest period.
3. Survivors compare the p words of their cell, in chunks that double while everything is equal.  Chains of equal
   cells are extended at both ends in the same way.
4. A stretch of enough periods and words is a run.

Periods are taken in octaves [P, 2P): none is a multiple of another in it, so all texts of an Arrow slice and all
periods of an octave are probed by the same array operations.  Words are compared as numbers of an exact dictionary.

Defined cases: null, empty and wordless texts have no words, no runs and an empty collapsed text.  Null and repeated
ids are rows like others.  Texts are taken whole, a very long one in a slice of its own; the arrays of a probe are
bounded by CELLS or one text's words.  Other columns do not matter.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.byte_tools import slices, word_numbers

#: Array elements that a probe handles at once.
CELLS = 1 << 18


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place within the owner) of sum(counts) elements."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def reach(word: np.ndarray, at: np.ndarray, step: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
    """How many words from ``at`` on (``way`` 1) or back (-1) equal the word ``step`` further, ``most`` at most."""
    done, live, width = np.zeros(len(at), np.int64), np.flatnonzero(most > 0), 8
    while len(live):
        rows, going = max(1, CELLS // width), []
        for k in range(0, len(live), rows):
            part = live[k : k + rows]
            ahead = done[part, None] + np.arange(width)
            inside = ahead < most[part, None]
            here = at[part, None] + way * np.where(inside, ahead, 0)
            same = (word[here] == word[here + step[part, None]]) & inside
            got = np.where(same.all(axis=1), width, same.argmin(axis=1))
            done[part] += got
            going.append(part[(got == width) & (done[part] < most[part])])
        live, width = np.concatenate(going), min(2 * width, CELLS)
    return done


class Found:
    """Runs found so far (places in the slice), by period."""

    def __init__(self):
        self.runs, self.by_period = [], {}

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        self.runs.append(np.stack([start, end, period], axis=1))

    def settle(self) -> None:
        """Runs added so far count for grid points from now on."""
        runs = self.all()
        self.runs, self.by_period = [runs], {}
        for q in np.unique(runs[:, 2]):
            own = runs[runs[:, 2] == q]
            own = own[np.argsort(own[:, 0])]
            self.by_period[int(q)] = own[:, 0], np.maximum.accumulate(own[:, 1])

    def all(self) -> np.ndarray:
        return np.concatenate([*self.runs, np.zeros((0, 3), np.int64)])

    def hold(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Whether the words [at, at + period) lie in a run whose period divides ``period``."""
        held = np.zeros(len(at), bool)
        for q, (start, end) in self.by_period.items():
            of = np.flatnonzero(period % q == 0)
            k = np.searchsorted(start, at[of], "right") - 1
            held[of] |= (k >= 0) & (end[k] >= at[of] + period[of])
        return held


def find_runs(word: np.ndarray, first: np.ndarray, times: int = 3, least: int = 24) -> np.ndarray:
    """Rows (text, start, length, period) by text, start and period; ``first`` is where each text's words begin (one more at the end)."""
    n, found, low = np.diff(first), Found(), 1
    texts = np.flatnonzero(n >= max(least, times))
    while len(texts) and low * times <= n[texts].max():
        periods = np.maximum(np.minimum(2 * low, n[texts] // times + 1) - low, 0)
        lane, nth = ragged(periods)
        text, period = texts[lane], low + nth
        tests = (n[text] - 1) // period
        begins = np.concatenate(([0], np.cumsum(tests)))
        k = 0
        while k < len(text):
            to = max(k + 1, int(np.searchsorted(begins, begins[k] + CELLS, "right")) - 1)
            _probe(word, first, text[k:to], period[k:to], tests[k:to], times, least, found)
            k = to
        found.settle()
        low *= 2
    runs = found.all()
    text = np.searchsorted(first, runs[:, 0], "right") - 1
    rows = np.stack([text, runs[:, 0] - first[text], runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _probe(word: np.ndarray, first: np.ndarray, text: np.ndarray, period: np.ndarray, tests: np.ndarray, times: int, least: int, found: Found) -> None:
    """Runs of these (text, period) lanes are added to ``found``."""
    lane, j = ragged(tests)
    step = period[lane]
    at = first[text[lane]] + j * step
    equal = word[at] == word[at + step]
    # The last test of a lane has no next one.
    both = np.flatnonzero(equal[:-1] & equal[1:] & (lane[:-1] == lane[1:]))
    both = both[~found.hold(at[both], step[both])]
    cells = both[reach(word, at[both], step[both], step[both], 1) == step[both]]
    if not len(cells):
        return
    joined = np.diff(cells) == 1
    head, tail = cells[np.concatenate(([True], ~joined))], cells[np.concatenate((~joined, [True]))]
    p, of = step[head], text[lane[head]]
    left = at[head] - reach(word, at[head] - 1, p, at[head] - first[of], -1)
    after = at[tail] + p
    right = after + reach(word, after, p, first[of + 1] - p - after, 1)
    run = (right - left >= (times - 1) * p) & (right + p - left >= least)
    found.add(left[run], right[run] + p[run], p[run])


def made_periodic(h: int, n: int) -> np.ndarray:
    """Word numbers of a text of n words for the number h: every tenth h repeats a stretch from some word on."""
    i, g = np.arange(n), h // 10
    if h % 10 or not n:
        return i
    a = g % n
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def period_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", times: int = 3, least: int = 24, rearranged: Column | None = None) -> DataFrame:
    """id, n_words, runs (array of start, length, period, by start and period) and collapsed (text) of every row.

    A run is a stretch of at least ``times`` of its smallest period and ``least`` words that no neighbour extends.
    ``collapsed`` joins by one space the words that no run contains after its first period.  ``rearranged``: a number
    for each row by which known cases are made (see made_periodic); null leaves the text as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(2).to_pylist()
            for at, to, buf, off in slices(batch.column(1)):
                word, known, first, _ = word_numbers(buf, off)
                for k, h in enumerate(numbers[at:to]):
                    if h is not None and h % 10 == 0:
                        word[first[k] : first[k + 1]] = word[first[k] + made_periodic(h, first[k + 1] - first[k])]
                runs = find_runs(word, first, times, least)
                covered = np.zeros(len(word) + 1, np.int64)
                begin = first[runs[:, 0]] + runs[:, 1]
                np.add.at(covered, begin + runs[:, 3], 1)
                np.add.at(covered, begin + runs[:, 2], -1)
                kept = np.cumsum(covered[:-1]) == 0
                ends = np.concatenate(([0], np.cumsum(kept)))[first]
                words = pa.LargeListArray.from_arrays(pa.array(ends), known.take(pa.array(word[kept])).cast(pa.large_string()))
                each = np.searchsorted(runs[:, 0], np.arange(to - at + 1)).astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in (1, 2, 3)], ["start", "length", "period"])
                columns = [batch.column(0).slice(at, to - at), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(each), spans), pc.binary_join(words, pa.scalar(" ", pa.large_string())).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "collapsed"])

    src = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), (F.lit(None) if rearranged is None else rearranged).cast("long").alias("h"))
    made = src.mapInArrow(run, "id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return made.select(F.col("id").alias(id), "n_words", "runs", "collapsed")


def op13_period_runs(spark, sf_dir: str) -> DataFrame:
    """Runs and the collapsed text of every document, every tenth made periodic; null and wordless texts have none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = period_runs(docs, rearranged=F.crc32(F.col("doc_id").cast("string").cast("binary")))

    def better(a: Column, b: Column) -> Column:
        """Of two runs that of the greater length / period; runs come by start and period, so the first stays at ties."""
        return F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)

    best = F.reduce("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    shown = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    return shown.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
