"""Imports one by one: what counts after failures, repeats and new files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wayfold.operators.gazetteer import road_points
from wayfold.plans.imports import import_extracts, import_totals, imported
from wayfold.sources.extracts import write_extract

TAGS = "map<string,string>"


def write(spark, path, rows, roads=()):
    points = [(i, lat, lon, {"addr:city": c, "addr:street": s, "addr:housenumber": h}) for i, (c, s, h, lat, lon) in enumerate(rows, 1)]
    write_extract(spark.createDataFrame(points, f"id long, lat double, lon double, tags {TAGS}").coalesce(1), path)
    if roads:
        write_extract(spark.createDataFrame([(k, [1, 2], {"highway": "residential", "name": n}) for k, n in enumerate(roads)], f"id long, refs array<long>, tags {TAGS}").coalesce(1), path)


def test_runs_go_on_after_failures(spark, tmp_path):
    file = lambda k: str(tmp_path / k)
    write(spark, file("a"), [("Town", "North st", "1", 1.0, 1.0), ("Town", "South st", "2", 2.0, 2.0), ("Town", "North st", "1", 9.0, 9.0)], ["North st", "South st"])
    write(spark, file("b"), [("Town", "North st", "1", 5.0, 5.0), ("Town", "North st", "3", 3.0, 3.0), ("Port", "North st", "1", 4.0, 4.0)], ["North st", "South st"])
    (tmp_path / "c").mkdir()
    (tmp_path / "c/x.osm.pbf").write_bytes(b"junk" * 100)
    none, base = spark.createDataFrame([], "name_norm string"), file("g")
    with pytest.raises(Exception, match="no blob"):
        import_extracts(spark, [file("c")], base, none, stop_on_error=True)
    assert imported(spark, base).houses.count() == 0
    run = lambda: import_totals(import_extracts(spark, [file("a"), file("c"), file("b"), file("none")], base, none)).first()
    assert tuple(run()) == (2, 2, 2, 3, 4, 1)
    g = imported(spark, base)
    assert sorted((r.city_id, r.name, r.lat) for r in g.cities.collect()) == [(1, "Town", 1.0), (2, "Port", 4.0)]
    assert sorted((r.street_id, r.city_id, r.name_norm) for r in g.streets.collect()) == [(1, 1, "north st"), (2, 1, "south st"), (3, 2, "north st")]
    assert sorted((r.house_id, r.city_id, r.street_id, r.house, r.lat) for r in g.houses.collect()) == [(1, 1, 1, "1", 1.0), (2, 1, 2, "2", 2.0), (3, 1, 1, "3", 3.0), (4, 2, 3, "1", 4.0)]
    assert [(r.inter_id, r.city_id, round(r.lat, 6)) for r in g.intersections.collect()] == [(1, 1, 1.0)]
    # The same files again: finished ones are not read, broken ones fail again, and one that is mended counts.
    assert tuple(run()) == (2, 4, 2, 3, 4, 1)
    (tmp_path / "c/x.osm.pbf").unlink()
    write(spark, file("c"), [("Town", "East st", "7", 7.0, 7.0)])
    assert tuple(run())[0] == 3 and imported(spark, base).houses.where("house_id = 5 and street_id = 4").count() == 1
    # A part without its row in the table of finished imports does not count.
    imported(spark, base).houses.write.parquet(f"{base}/part=99/houses")
    assert imported(spark, base).houses.count() == 5 and imported(spark, base).houses.agg(F.count_distinct("house_id")).first()[0] == 5


def test_errors_of_the_jvm_leave_a_file_out(spark, tmp_path, monkeypatch):
    """On a cluster a failed job is not always turned into an error of PySpark."""
    from py4j.protocol import Py4JJavaError

    class Failed(Py4JJavaError):
        def __init__(self):
            Exception.__init__(self, "job failed")

        def __str__(self):
            return "job failed"

    def fail(*_):
        raise Failed

    monkeypatch.setattr("wayfold.plans.imports.import_extract", fail)
    write(spark, str(tmp_path / "x"), [("Town", "North st", "1", 1.0, 1.0)])
    none = spark.createDataFrame([], "name_norm string")
    rows = import_extracts(spark, [str(tmp_path / "x")], str(tmp_path / "g"), none).collect()
    assert [(r.part, r.error) for r in rows] == [(None, "job failed")]


def test_a_file_without_blobs_starts_no_job(spark, tmp_path, monkeypatch):
    (tmp_path / "x.osm.pbf").write_bytes(b"junk" * 100)
    monkeypatch.setattr("wayfold.plans.imports.import_extract", lambda *_: pytest.fail("was read"))
    rows = import_extracts(spark, [str(tmp_path / "x.osm.pbf")], str(tmp_path / "g"), spark.createDataFrame([], "name_norm string")).collect()
    assert [r.part for r in rows] == [None] and "no blob" in rows[0].error


def test_nodes_are_not_read_for_crossings_where_no_roads_meet(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(k):
        seen.add(1)
        return float(k % 90)

    nodes = spark.range(50_000).select("id", F.udf(counted, "double").asNondeterministic()("id").alias("lat"), F.lit(0.0).alias("lon"))
    roads = lambda n: spark.createDataFrame([(k, [k % n], {"highway": "residential", "name": f"{k} st"}) for k in range(6)], f"id long, refs array<long>, tags {TAGS}")
    assert road_points(roads(6), nodes).collect() == [] and seen.value == 0
    assert sorted((r.node, r.lat, r.names) for r in road_points(roads(3), nodes).collect()) == [(k, float(k), [f"{k} st", f"{k + 3} st"]) for k in range(3)]
