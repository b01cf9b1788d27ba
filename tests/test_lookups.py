"""Map extracts, nearest places and streams against brute force, round trips and restarts."""

from __future__ import annotations

import math
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfold import lookup_queries
from wayfold.functions import text
from wayfold.operators import gazetteer
from wayfold.operators.gazetteer import addresses, build_gazetteer, build_intersections
from wayfold.operators.shapes import first_wins
from wayfold.operators.spatial import nearest_places
from wayfold.sources import extracts, osm
from wayfold.streaming.ingest import append_first_arrivals
from wayfold.tables import stored

TAGS = "map<string,string>"


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """Nodes and ways in several extract files."""
    path = str(tmp_path_factory.mktemp("extract"))
    tags = F.when(F.col("id") % 5 == 0, F.create_map(F.lit("k"), F.concat(F.lit("é"), F.col("id").cast("string")), F.lit("x"), F.lit(""))).otherwise(F.create_map().cast(TAGS))
    nodes = spark.range(0, 30_000, 1, 3).select((F.col("id") * 7 % 30_000 - 100).alias("id"), (F.col("id") / 1000 - 15).alias("lat"), (F.col("id") / 500 - 30).alias("lon"), tags.alias("tags"))
    ways = spark.range(0, 5000, 1, 2).select("id", F.when(F.col("id") % 9 > 0, F.sequence(F.col("id"), F.col("id") + F.col("id") % 5)).otherwise(F.array().cast("array<bigint>")).alias("refs"), F.create_map(F.lit("name"), F.col("id").cast("string")).alias("tags"))
    extracts.write_extract(nodes, path)
    extracts.write_extract(ways, f"file://{path}")
    return path, nodes, ways


def shown(rows, *columns):
    return sorted(map(tuple, rows.select(*columns, F.to_json("tags").alias("t")).collect()))


@pytest.mark.parametrize("split", [777, 20_000, 1 << 30])
def test_ranges_of_any_size_give_each_row_once(spark, written, split):
    path, nodes, ways = written
    if split == 777:  # more ranges than blobs: most begin none
        nodes_only = extracts.extract_rows(spark, path, "node", "id", split=2000)
        assert nodes_only.rdd.getNumPartitions() > 30 and nodes_only.count() == 30_000
        return
    a, b = extracts.read_extracts(spark, path, split=split)
    where = ("id", F.round("lat", 6), F.round("lon", 6))
    assert shown(a, *where) == shown(nodes, *where) and shown(b, "id", "refs") == shown(ways, "id", "refs")
    assert a.select("seq.path", "seq.at").distinct().count() == 30_000


def test_both_readers_agree(spark, written):
    path, _, _ = written
    (a, b), (c, d) = extracts.read_extracts(spark, path, split=30_000), osm.read_pbf(spark, path, 4)
    assert shown(a, "id", "lat", "seq.at") == shown(c, "id", "lat", "seq.at") and shown(b, "id", "refs", "seq.at") == shown(d, "id", "refs", "seq.at")


def test_only_what_is_asked_for_is_made(spark, written):
    path, _, _ = written
    some = extracts.extract_rows(spark, path, "node", "id,tags", having="k,none")
    assert some.columns == ["id", "tags"] and some.count() == 6000 and some.where("tags['k'] is null").count() == 0
    assert extracts.extract_rows(spark, path, "way", having="none").count() == 0


def test_no_task_holds_a_file(tmp_path):
    """A blob is all that is read at once, and the ranges of a file have each blob once."""
    rows = lambda k: pa.table({"id": np.arange(k * 50, k * 50 + 50), "lat": np.random.default_rng(k).random(50), "lon": np.zeros(50), "tags": pa.array([[("k", str(k))]] * 50, pa.map_(pa.string(), pa.string()))})
    data = b"".join(extracts.blob_of(b"OSMData", extracts.block_of(rows(k))) for k in range(40))
    (tmp_path / "a.osm.pbf").write_bytes(data)
    big, size, reads = str(tmp_path / "a.osm.pbf"), len(data), []
    source = extracts.Blobs(big, size, 0, size, True)

    class Counted:
        def __init__(self, file):
            self.file = file

        def read_at(self, n, at):
            reads.append(n)
            return self.file.read_at(n, at)

    source.file = Counted(source.file)
    assert len(list(source)) == 40 and max(reads) < size / 20
    for step in (100, 1000, 5000):
        found = [at for begin in range(0, size, step) for at, _ in extracts.Blobs(big, size, begin, begin + step, True)]
        assert found == [at for at, _ in source]


def test_damaged_extracts(spark, written, tmp_path):
    path, _, _ = written
    file = min(extracts.sizes([path]), key=lambda x: x[1])[0]  # one of nodes, with two blobs
    whole = extracts.extract_rows(spark, file, "node", "id").count()
    (tmp_path / "cut.osm.pbf").write_bytes(Path(file).read_bytes()[:-50])
    cut = str(tmp_path / "cut.osm.pbf")
    assert 0 < extracts.extract_rows(spark, cut, "node", "id", strict=False, split=10_000).count() < whole
    with pytest.raises(Exception, match="ends inside"):
        extracts.extract_rows(spark, cut, "node", "id", split=10_000).count()
    (tmp_path / "junk.osm.pbf").write_bytes(b"junk" * 1000)
    with pytest.raises(Exception, match="no blob"):
        extracts.extract_rows(spark, str(tmp_path / "junk.osm.pbf"), "node", "id").count()
    with pytest.raises(Exception, match="none.osm"):
        extracts.extract_rows(spark, str(tmp_path / "none.osm.pbf"), "node", "id").count()


def test_overwriting_leaves_one_version(spark, tmp_path):
    rows = spark.range(10).select("id", F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.create_map().cast(TAGS).alias("tags"))
    for n in (10, 4):
        extracts.write_extract(rows.limit(n).coalesce(1), str(tmp_path / "e"), "overwrite")
    assert extracts.extract_rows(spark, str(tmp_path / "e"), "node", "id").count() == 4 and not list((tmp_path / "e").glob("_*"))


# --- nearest places


def km(a, b):
    (la, oa), (lb, ob) = a, b
    h = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(ob - oa) / 2) ** 2
    return round(2 * 6371.0 * math.asin(min(1.0, math.sqrt(h))), 6)


@pytest.mark.parametrize("spread", [0.02, 3, 180])
def test_nearest_equals_brute_force(spark, spread):
    rng = random.Random(spread)
    around = [(89.9, 10), (-20, 179.99), (55, 83)]
    near = lambda: (lambda c: (max(-90.0, min(90.0, c[0] + rng.uniform(-spread, spread) / 2)), (c[1] + rng.uniform(-spread, spread) + 540) % 360 - 180))(rng.choice(around))
    places = [near() for _ in range(60)] + [(1.5, 2.5)] * 3
    points = [near() for _ in range(150)] + [(1.5, 2.5), (-90.0, 0.0), places[0]]
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)] + [(999, None, 1.0)], "id long, lat double, lon double")
    q = spark.createDataFrame([(i, *x) for i, x in enumerate(places)] + [(1000, None, None)], "place long, lat double, lon double")
    got = {r.id: (r.km, r.place) for r in nearest_places(p, q, "id", "place").collect()}
    assert got == {i: min((km(x, y), k) for k, y in enumerate(places)) for i, x in enumerate(points)}
    assert nearest_places(p, q.limit(0), "id", "place").count() == 0


def test_crossing_in_the_nearest_city(spark):
    """Two cities have both streets: the larger one takes the crossing, or the nearer one if asked for."""
    rows = [("big", "a st", str(i), 10.0, 10.0, i) for i in range(3)] + [("big", "b st", "1", 10.0, 10.0, 7), ("small", "a st", "1", 50.0, 50.0, 8), ("small", "b st", "1", 50.0, 50.0, 9)]
    g = build_gazetteer(spark.createDataFrame(rows, "city string, street string, house string, lat double, lon double, seq long"))
    nodes = spark.createDataFrame([(1, 50.1, 50.1), (2, 10.1, 10.1)], "id long, lat double, lon double")
    tag = lambda n: {"highway": "residential", "name": n}
    ways = spark.createDataFrame([(1, [1, 2], tag("a st")), (2, [1, 2], tag("b st"))], f"id long, refs array<long>, tags {TAGS}")
    name = g.cities.select("city_id", "name")
    places = lambda **k: sorted((r.name, r.lat) for r in build_intersections(ways, nodes, g, spark.createDataFrame([], "name_norm string"), **k).join(name, "city_id").collect())
    assert places() == [("big", 50.1)] and places(nearest=True) == [("big", 10.1), ("small", 50.1)]


def test_a_vertex_is_one_row_with_its_names(spark):
    """Names and positions that come twice do not multiply; pairs of a vertex are made where they are counted."""
    nodes = spark.createDataFrame([(1, 2.0, 2.0), (1, 1.0, 3.0), (2, 0.0, 0.0)], "id long, lat double, lon double")
    ways = spark.createDataFrame([(k, [1, 1, k + 2], {"highway": "residential", "name": n}) for k, n in enumerate(["b st", "a st", "c st", "a st"])], f"id long, refs array<long>, tags {TAGS}")
    points = gazetteer.road_points(ways, nodes).collect()
    assert [tuple(r) for r in points] == [(1, 1.0, 3.0, ["a st", "b st", "c st"])]


def test_equal_spellings_are_normalised_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(house):
        seen.add(1)
        return house

    monkeypatch.setattr(gazetteer, "normalize_house", F.udf(counted, "string").asNondeterministic())
    rows = spark.range(1000).select(F.lit("Town").alias("city"), F.lit("a st").alias("street"), (F.col("id") % 5).cast("string").alias("house"), F.col("id").cast("double").alias("lat"), F.lit(0.0).alias("lon"), F.col("id").alias("seq"))
    assert sorted((r.house, r.lat) for r in build_gazetteer(rows).houses.collect()) == [(str(k), float(k)) for k in range(5)]
    assert seen.value <= 20


# --- streams


def test_first_arrivals_are_kept_over_a_restart(spark, tmp_path):
    schema, where = "k string, v long, seq long", tmp_path / "in"
    batches = [[("a", 1, 5), ("a", 2, 3), ("b", 3, 9), (None, 4, 1)], [("a", 9, 0), ("c", 5, 2), ("c", 6, 1)], [("b", 7, 1)], [("d", 8, 8), (None, 9, 0)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(where / f"day={k}"))
        stream = spark.readStream.schema(schema).option("basePath", str(where)).parquet(str(where / "day=*"))
        query = append_first_arrivals(stream, ["k"], "seq", ["v"], str(tmp_path / "table"), str(tmp_path / "state"))  # each time a new query goes on
        query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "table"))
    assert sorted((r.k or "", r.v, r.seq, r.batch) for r in got.collect()) == [("", 4, 1, 0), ("a", 2, 3, 0), ("b", 3, 9, 0), ("c", 6, 1, 1), ("d", 8, 8, 3)]
    every = spark.createDataFrame([(*r, n) for n, rows in enumerate(batches) for r in rows], f"{schema}, day long")
    assert got.drop("batch").exceptAll(first_wins(every, ["k"], ["day", "seq"], ["v"]).select("k", "seq", "v")).count() == 0


def test_addresses_of_an_extract_build_the_same(spark, written):
    path, _, _ = written
    rows = addresses(*extracts.read_extracts(spark, path))
    assert rows.count() == 0 and build_gazetteer(rows).houses.count() == 0


def test_batches_of_a_stream_have_as_many_ranges_as_rows_want(spark, tmp_path, monkeypatch):
    class NoStream:
        def awaitTermination(self):
            pass

    monkeypatch.setattr(lookup_queries, "RANGE_ROWS", 500)
    monkeypatch.setattr(lookup_queries, "append_first_arrivals", lambda *_: NoStream())
    monkeypatch.setattr(lookup_queries, "_shared_folder", lambda _: str(tmp_path))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        lookup_queries.streamed_firsts(spark, "/root/testdata/sf0.001")
    assert len(list(tmp_path.glob("in/part-*.parquet"))) == 12 and len(list(tmp_path.glob("arriving/day=*"))) == 4


# --- what an import does for each row


def test_blocks_hold_what_was_given():
    """Null tags, values and lists, negative and large numbers, slices; the plain reader decodes the same."""
    tags = pa.array([[("k", "é"), ("x", None)], None, [], [("k", "é"), ("y", "")], [("z", "1")]], pa.map_(pa.string(), pa.string()))
    ids = pa.array([5, -7, 1 << 62, 0, 9])
    nodes = pa.table({"id": ids, "lat": [1.0, -90.0, 0.5, 2.0, 3.0], "lon": [180.0, -180.0, 0.0, 1.0, 2.0], "tags": tags})
    ways = pa.table({"id": ids, "refs": pa.array([[1, -5, 1 << 62], None, [], [7], [8, 7]]), "tags": tags})
    said = [[(k, v or "") for k, v in t or []] for t in tags.to_pylist()]
    for begin, n in ((0, 5), (1, 4), (2, 0)):
        part = slice(begin, begin + n)
        got = osm.block_rows(extracts.block_of(nodes.slice(begin, n)))[0]
        assert [(i, round(la, 6), t) for i, la, _, t in got] == list(zip(ids.to_pylist()[part], nodes.column("lat").to_pylist()[part], said[part], strict=True))
        block = extracts.block_of(ways.slice(begin, n))
        refs = [r or [] for r in ways.column("refs").to_pylist()[part]]
        assert osm.block_rows(block)[1] == [(i % (1 << 64), r, t) for i, r, t in zip(ids.to_pylist()[part], refs, said[part], strict=True)]
        found = [g for g in extracts.block_batches(block, "way", ["id", "refs", "tags"], [])]
        assert [r for g in found for r in g["refs"].to_pylist()] == refs and [i for g in found for i in g["id"].to_pylist()] == ids.to_pylist()[part]


def test_blocks_without_a_wanted_key_are_not_decoded(monkeypatch):
    rows = pa.table({"id": [1, 2], "refs": [[1, 2], [3]], "tags": pa.array([[("k", "v")]] * 2, pa.map_(pa.string(), pa.string()))})
    block = extracts.block_of(rows)
    assert sum(len(g["place"]) for g in extracts.block_batches(block, "way", ["id"], ["k", "none"])) == 2
    monkeypatch.setattr(extracts, "packed", lambda *_: pytest.fail("was decoded"))
    assert not list(extracts.block_batches(block, "way", ["id"], ["none"]))


def test_normal_forms_wait_for_the_aggregate(spark, monkeypatch):
    """No pattern is met by every row: neither for trimming nor for a condition that is pushed below an aggregate."""
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df)

    monkeypatch.setattr(gazetteer, "stored", kept)
    nodes = spark.createDataFrame([(1, 1.0, 2.0, {"addr:city": " Town ", "addr:street": "North\u00a0", "addr:housenumber": str(k % 2)}, ("f", k)) for k in range(4)], extracts.NODES)
    houses = build_gazetteer(addresses(nodes, spark.createDataFrame([], extracts.WAYS))).houses
    assert houses.count() == 2 and len(read := [p for p in plans if "addr:housenumber" in p]) == 2  # ways with an address, spellings
    assert not [p for p in read if "regexp" in p]


def test_nodes_are_read_once_where_no_way_has_an_address(spark, monkeypatch):
    monkeypatch.setattr(gazetteer, "way_centres", lambda *_: pytest.fail("vertices were looked up"))
    nodes = spark.createDataFrame([(1, 1.0, 2.0, {"addr:city": "Town", "addr:street": "North", "addr:housenumber": "1"}, ("f", 0))], extracts.NODES)
    ways = spark.createDataFrame([(1, [1], {"highway": "residential", "name": "North"}, ("f", 1))], extracts.WAYS)
    assert [r.house for r in addresses(nodes, ways).collect()] == ["1"]


def test_trimming_knows_all_white_space(spark):
    every = spark.range(0x10000).where("id < 55296 or id >= 57344").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    told = every.select(F.explode(F.array("c", F.concat("c", F.lit(" x"), "c", F.lit("y\n"), "c"))).alias("s"))
    assert told.where(text.trimmed(F.col("s")) != F.regexp_replace("s", r"(?U)^\s+|\s+$", "")).count() == 0


def test_equal_names_of_roads_are_normalised_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(name):
        seen.add(1)
        return name

    monkeypatch.setattr(gazetteer, "normalize_street", F.udf(counted, "string").asNondeterministic())
    road = F.create_map(F.lit("highway"), F.lit("residential"), F.lit("name"), F.concat((F.col("id") % 3).cast("string"), F.lit(" st")))
    ways = spark.range(900).select("id", F.array(F.col("id") % 7).alias("refs"), road.alias("tags"))
    nodes = spark.range(7).select("id", F.col("id").cast("double").alias("lat"), F.lit(0.0).alias("lon"))
    assert {(r.node, tuple(r.names)) for r in gazetteer.road_points(ways, nodes).collect()} == {(k, ("0 st", "1 st", "2 st")) for k in range(7)}
    assert 3 <= seen.value <= 12
