"""Registered queries against DuckDB, the plans they should have, and operators on edge cases."""

from __future__ import annotations

import contextlib
import io

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold import queries
from wayfold.operators import shapes
from wayfold.operators.vectors import best_of, emblem_matches, top_similar
from wayfold.tables import numbered, spread

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    mine = queries.queries()[name](spark, SF).toPandas()
    if name not in queries.oracle_sql():
        assert len(mine)
        return
    theirs = duck.sql(queries.oracle_sql()[name]).df()
    columns = sorted(theirs)
    assert sorted(mine) == columns
    def rows(df):
        plain = lambda v: None if v != v else round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
        return sorted((tuple(map(plain, r)) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False)), key=repr)

    a, b = rows(mine), rows(theirs)
    assert len(a) == len(b)
    different = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert all(p == q or (isinstance(p, float) and p == pytest.approx(q)) for x, y in different for p, q in zip(x, y, strict=True)), different[:3]


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_scans_are_pruned_and_limits_are_pushed(spark):
    p = plan(queries.street_centroid(spark, SF))
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_discount:double>" in p and "ArrowEvalPython" not in p
    assert "WindowGroupLimit" in plan(queries.merge_topk(spark, SF))


def test_numbers_are_dense_and_ordered(spark):
    rows = numbered(spark.range(1000).select((1000 - F.col("id")).alias("x")), "n", "x").orderBy("n").collect()
    assert [r.n for r in rows] == list(range(1, 1001)) and [r.x for r in rows] == list(range(1, 1001))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k long, v string, lat double, lon double, score double, priority int, seq long")
    assert shapes.centroids(empty, ["k"]).count() == 0 and shapes.merge_top(empty, "k", ["v"]).count() == 0
    assert numbered(empty.select("k"), "n", "k").count() == 0
    vectors = spark.createDataFrame([], "id long, vector array<double>")
    assert top_similar(vectors.withColumnRenamed("id", "query_id"), vectors).count() == 0


def test_merges_keep_the_first_of_equals(spark):
    rows = [(1, "a", 0.5, 1, 3), (1, "a", 0.5, 0, 9), (1, "b", 0.9, 5, 1), (1, None, 0.1, 0, 0)]
    df = spark.createDataFrame(rows, "k long, v string, score double, priority int, seq long")
    assert [(r.v, r.seq) for r in shapes.merge_top(df, "k", ["v"], 2).orderBy("rank").collect()] == [("b", 1), ("a", 9)]
    assert [r.v for r in shapes.slice_then_merge(df, "k", ["v"], 3).orderBy("rank").collect()] == ["b", "a"]


def test_equal_emblems_come_by_id(spark):
    """Copies of a picture tie: numbers go by value, texts by their letters, and the k best are the first of them."""
    rows = spark.range(40).select("id", F.concat(F.lit("e"), "id").alias("name"), F.lit("city").alias("kind"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    asked = rows.where("id = 7").select(F.col("id").alias("query_id"), "vector")
    names = lambda emblems: [r.name for r in emblem_matches(asked, emblems, 3).orderBy("rank").collect()]
    assert names(rows) == ["e0", "e1", "e2"]
    assert names(rows.withColumn("id", F.col("id").cast("string"))) == ["e0", "e1", "e10"]


def test_best_of_rows():
    rng = np.random.default_rng(5)
    s = np.round(rng.random((50, 30)), 1)
    s[3, 4] = np.nan
    row, column, value = best_of(s, 6)
    order = np.lexsort((np.broadcast_to(np.arange(30), s.shape), -s), axis=1)[:, :6]
    assert sorted(zip(row.tolist(), column.tolist())) == sorted((r, c) for r in range(50) for c in order[r].tolist())
    assert (value == s[row, column]).all() and len(best_of(s[:, :4], 6)[0]) == 200


def test_rows_are_dealt_by_number(spark):
    """Files and shuffled data of cheap rows are small, so their size would leave the work to one task."""
    dealt = spread(spark.range(25_000).coalesce(1), rows=10_000)
    assert dealt.rdd.getNumPartitions() == 3 and dealt.count() == 25_000 and spread(spark.range(0)).count() == 0


def test_a_mode_counts_rows_as_often_as_they_say(spark):
    rows = spark.createDataFrame([("i", "a", 1, 1), ("i", "b", 2, 3), ("i", "a", 3, 1)], "k string, v string, seq int, times int")
    assert [tuple(r) for r in shapes.mode_value(rows, "k", "v", ["seq"], "times").collect()] == [("i", "b", 3)]
