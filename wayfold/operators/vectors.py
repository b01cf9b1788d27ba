"""Similarity of vectors: the k nearest index rows of each query by dot product of unit vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wayfold.functions.geo import emblem_score
from wayfold.tables import numbered, stored

#: Index rows of a block, queries of a group, and blocks of a lane (what one key of the join stands for).
BLOCK = 4096
GROUP = 8192
LANE = 8


def packed(rows: DataFrame, id: str, vector: str, size: int) -> DataFrame:
    """dim, part, ids and x (unit vectors as bytes) of about ``size`` rows each; parts of a dimension count from 0."""
    whole = rows.select(F.col(id).cast("long").alias("id"), F.transform(F.col(vector), lambda v: v.cast("double")).alias("vector"))
    whole = whole.where("id is not null and vector is not null and size(vector) > 0").withColumn("dim", F.size("vector"))
    parts = whole.groupBy("dim").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame.vector.to_list())
        norm = np.sqrt((x**2).sum(1, keepdims=True))
        x = np.divide(x, norm, out=x, where=norm > 0)
        return pd.DataFrame({"dim": frame.dim.iloc[:1], "part": frame.part.iloc[:1], "ids": [frame.id.to_numpy(np.int64).tobytes()], "x": [x.tobytes()]})

    dealt = whole.join(F.broadcast(parts), "dim").select("id", "vector", "dim", F.pmod(F.xxhash64("id", "vector"), F.col("parts")).cast("int").alias("part"))
    return dealt.groupBy("dim", "part").applyInPandas(pack, "dim int, part int, ids binary, x binary")


def best_of(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the k largest values of each row; ties go to the smaller column, NaN is the least.  No row is sorted as a whole."""
    if s.shape[1] > k:
        known = np.where(np.isnan(s), -np.inf, s)
        least = np.partition(known, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
        above, level = known > least, known == least
        room = k - above.sum(axis=1)
        rows, columns = np.nonzero(level)
        # How many of a row's equal values stand before this one.
        before = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = before < room[rows]
        above[rows[kept], columns[kept]] = True
        own, near = np.nonzero(above)
    else:
        own, near = (a.ravel() for a in np.indices(s.shape))
    return own, near, s[own, near]


def top_similar(queries: DataFrame, index: DataFrame, k: int = 5, digits: int = 6) -> DataFrame:
    """(query_id, id, similarity, rank): queries (query_id, vector) against index (id, vector) of the same dimension.

    Both sides are packed into matrices by tasks; each lane of the index's blocks meets each group of queries, and a task keeps
    k rows a query and block.  Nothing passes through the driver.  Zero vectors stay zero; ties go to the smaller id; null ids,
    null and empty vectors take no part.
    """
    asked = packed(queries, "query_id", "vector", GROUP).select("dim", F.col("part").alias("group"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x"))
    blocks = packed(index, "id", "vector", BLOCK).withColumn("lane", F.floor(F.col("part") / LANE).cast("int"))
    # Stored, as both sides need to know how many parts the other one has.
    asked, blocks = stored(asked), stored(blocks)
    groups, lanes = asked.groupBy("dim").agg(F.max("group").alias("last")), blocks.groupBy("dim").agg(F.max("lane").alias("last"))
    asked = asked.join(F.broadcast(lanes), "dim").withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("last"))))
    blocks = blocks.join(F.broadcast(groups), "dim").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("last"))))
    met = blocks.join(asked, ["dim", "group", "lane"]).select("dim", "q_ids", "q_x", "ids", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim, q_ids, q_x, ids, x = (c[r].as_py() for c in batch.columns)
                q_ids, ids = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                q, matrix = np.frombuffer(q_x).reshape(-1, dim), np.frombuffer(x).reshape(-1, dim)
                by_id = np.argsort(ids, kind="stable")
                ids, matrix = ids[by_id], matrix[by_id]
                for at in range(0, len(q_ids), 512):
                    own, near, s = best_of(np.round(q[at : at + 512] @ matrix.T, digits), k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[at : at + 512][own]), pa.array(ids[near]), pa.array(s)], ["query_id", "id", "similarity"])

    found = met.mapInArrow(run, "query_id long, id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")).cast("long")
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def emblem_index(embedded: DataFrame, catalogue: DataFrame, path: str) -> DataFrame:
    """The index of emblems (id, name, kind, lat, lon, vector), written to ``path``: catalogue rows whose picture was embedded."""
    rows = catalogue.select("id", "name", "kind", "lat", "lon").join(embedded.select("id", F.col("vector").cast("array<float>")).where("vector is not null"), "id")
    rows.write.mode("overwrite").parquet(path)
    return embedded.sparkSession.read.schema(rows.schema).parquet(path)


def emblem_matches(queries: DataFrame, emblems: DataFrame, k: int = 5, floor: float = 0.25) -> DataFrame:
    """Emblem candidates of each query: the k best first, then the floor; kinds and scores as the resolver wants them.

    Ties go to the smaller id (numbers or texts, in their own order).
    """
    keyed = emblems.select("id", "name", "kind", "lat", "lon", "vector").where("id is not null")
    keyed = numbered(keyed, "number", "id") if isinstance(emblems.schema["id"].dataType, StringType) else keyed.withColumn("number", F.col("id").cast("long"))
    top = top_similar(queries, keyed.select(F.col("number").alias("id"), "vector"), k).where(F.col("similarity") >= floor)
    kind = F.when(F.col("kind") == "city", "heraldry").otherwise("heraldry_region")
    named = top.withColumnRenamed("id", "number").join(keyed.select("number", "name", "kind", "lat", "lon"), "number")
    return named.select("query_id", "name", "lat", "lon", emblem_score(F.col("similarity")).alias("score"), kind.alias("kind"), "rank")
