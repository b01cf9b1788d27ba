"""A blocked Bloom filter over ids, so that rows nobody asks for stay out of a shuffle; the join after it is exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.byte_tools import mixed

#: 64-bit blocks at most (8 MiB: twelve bits for each of 5.6 million ids); more ids let more rows pass, none is lost.
MOST_BLOCKS = 1 << 20


def _places(ids: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and four bits of each id."""
    h = mixed(np.ascontiguousarray(ids).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    mask = np.zeros(len(ids), np.uint64)
    for shift in (32, 38, 44, 50):
        mask |= np.uint64(1) << ((h >> np.uint64(shift)) & np.uint64(63))
    return (h % np.uint64(blocks)).astype(np.int64), mask


def bloom(ids: DataFrame, count: int, most: int = MOST_BLOCKS) -> np.ndarray:
    """The filter of a table with one column, id (long), of about ``count`` rows; tasks fill blocks, Spark joins them."""
    blocks = 1
    while blocks * 64 < 12 * count and blocks < most:
        blocks *= 2

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(blocks, np.uint64)
        for batch in batches:
            np.bitwise_or.at(words, *_places(batch.column(0).to_numpy(zero_copy_only=False), blocks))
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(words[used].view(np.int64))], ["block", "mask"])

    table = ids.where("id is not null").mapInArrow(fill, "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(blocks, np.uint64)
    words[table.column("block").to_numpy()] = table.column("mask").to_numpy().view(np.uint64)
    return words


def holds(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each id."""
    block, mask = _places(ids, len(words))
    return (words[block] & mask) == mask


def divided(rows: DataFrame, ids: DataFrame, id: str = "id") -> tuple[DataFrame, DataFrame]:
    """Those ``rows`` whose ``id`` may be in ``ids`` (all that are, and a few more), and those where it surely is not."""
    shared = rows.sparkSession.sparkContext.broadcast(bloom(ids.select(F.col(id).cast("long").alias("id")), ids.count()))

    @F.pandas_udf(T.BooleanType())
    def asked_for(id: pd.Series) -> pd.Series:
        return pd.Series(holds(shared.value, id.to_numpy(np.int64)))

    number = F.col(id).cast("long")
    some = rows.where(number.isNotNull())
    return some.where(asked_for(number)), some.where(~asked_for(number)).union(rows.where(number.isNull()))
