"""Registered queries of name look-ups, nearest places, map extracts and streams, over names and positions of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold import place_queries as places
from wayfold.operators.gazetteer import addresses, build_gazetteer, build_intersections
from wayfold.operators.gram_index import build_index, names_holding, names_similar
from wayfold.operators.spatial import nearest_places
from wayfold.plans.imports import import_extracts, imported
from wayfold.sources.extracts import extract_rows, write_extract
from wayfold.streaming.ingest import append_first_arrivals
from wayfold.tables import folder


#: Batches of the stream, and rows of a range of it.
BATCHES, RANGE_ROWS = 4, 1_000_000


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    return f"{folder(spark)}/query-{uuid.uuid4().hex}"


def names_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that hold a text, by the stored index (here: addresses of pages that hold the end of a word of theirs, or a word of a part's name)."""
    urls = _t(spark, sf_dir, "pages").select("url").where("url is not null")
    ends = urls.select(F.substring_index("url", "/", -1).alias("w")).select(F.expr("right(w, 5)").alias("query"))
    words = _t(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("query"))
    return names_holding(ends.union(words), "query", build_index(urls, "url"))


HOLDING_SQL = """
WITH u AS (SELECT DISTINCT url FROM pages WHERE url <> ''),
q AS (SELECT right(list_last(string_split(url, '/')), 5) AS query FROM u UNION SELECT unnest(string_split(p_name, ' ')) FROM part)
SELECT query, url AS text FROM q JOIN u ON contains(url, query) WHERE query <> ''"""


def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names with a partial similarity of 75 and more to a query, by the stored index (here: part and nation names, queries with a letter changed or lost)."""
    names = _t(spark, sf_dir, "part").select(F.lower("p_name").alias("name")).union(_t(spark, sf_dir, "nation").select(F.lower("n_name")))
    name, key = F.col("name"), F.crc32(F.col("name").cast("binary"))
    at = (key % F.length("name") + 1).cast("int")
    lost = F.concat(F.substring(name, F.lit(1), at - 1), F.when(key % 2 == 0, F.lit("x")).otherwise(""), F.substring(name, at + 1, F.length("name")))
    return names_similar(names.select(lost.alias("query")), "query", build_index(names, "name"), 75)


def nearest_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest place of each point, by cells with an exact stop (here: customers and suppliers, placed by balance and key)."""
    points = _t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 125).alias("lat"), (F.col("c_custkey") % 360 - 180).cast("double").alias("lon"))
    known = _t(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 125).alias("lat"), (F.col("s_suppkey") * 7 % 360 - 180).cast("double").alias("lon"))
    return nearest_places(points, known, "c_custkey", "s_suppkey")


def _km(la: str, oa: str, lb: str, ob: str) -> str:
    return f"round(2 * 6371.0 * asin(least(1.0, sqrt(sin(radians({lb} - {la}) / 2) * sin(radians({lb} - {la}) / 2) + cos(radians({la})) * cos(radians({lb})) * sin(radians({ob} - {oa}) / 2) * sin(radians({ob} - {oa}) / 2)))), 6)"


NEAREST_PLACE_SQL = f"""
WITH c AS (SELECT c_custkey, c_acctbal / 125 AS la, (c_custkey % 360 - 180)::DOUBLE AS oa FROM customer),
s AS (SELECT s_suppkey, s_acctbal / 125 AS lb, (s_suppkey * 7 % 360 - 180)::DOUBLE AS ob FROM supplier)
SELECT c_custkey, s_suppkey, {_km("la", "oa", "lb", "ob")} AS km FROM c, s
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY {_km("la", "oa", "lb", "ob")}, s_suppkey) = 1"""


def crossings_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings in the nearest city, where that has both streets, else in the one with most houses."""
    g = places._gazetteer(spark, sf_dir, crossings=False)
    nodes, ways = places._roads(spark, sf_dir)
    g.intersections = build_intersections(ways, nodes, g, spark.createDataFrame([], "name_norm string"), nearest=True)
    return places.named_crossings(g)


DISTANCE_SQL = f"""WITH {places.ADDRESSES}, {places.CROSSINGS},
cc AS (SELECT city, min((l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS first, arg_min(lat, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS clat, arg_min(lon, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS clon FROM a GROUP BY city),
d AS (SELECT DISTINCT node, lat, lon FROM v),
near AS (SELECT node, city FROM d, cc QUALIFY row_number() OVER (PARTITION BY node ORDER BY {_km("lat", "lon", "clat", "clon")}, cc.first) = 1),
pn AS (SELECT p.*, near.city FROM p JOIN near USING (node) JOIN c x ON x.city = near.city AND x.street = sa JOIN c y ON y.city = near.city AND y.street = sb),
every AS (SELECT * FROM pn UNION ALL SELECT p.*, o.city FROM p JOIN o USING (sa, sb) WHERE NOT EXISTS (SELECT 1 FROM pn WHERE pn.node = p.node AND pn.sa = p.sa AND pn.sb = p.sb))
SELECT city, sa AS a, sb AS b, round(lat, 6) AS lat, lon FROM every QUALIFY row_number() OVER (PARTITION BY city, sa, sb ORDER BY node) = 1"""


def _written_extracts(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Folders of map extracts: address points, in the order of their rows; road vertices and roads."""
    base = _shared_folder(spark)
    rows = places._addresses(spark, sf_dir)
    tags = F.create_map(F.lit("addr:city"), F.col("city"), F.lit("addr:street"), F.col("street"), F.lit("addr:housenumber"), F.col("house"))
    ordered = rows.repartitionByRange("seq").sortWithinPartitions("seq")
    write_extract(ordered.select((F.col("seq.l_orderkey") * 8 + F.col("seq.l_linenumber")).alias("id"), "lat", "lon", tags.alias("tags")), f"{base}/addresses")
    nodes, ways = places._roads(spark, sf_dir)
    write_extract(nodes.select("id", "lat", "lon", F.create_map().cast("map<string,string>").alias("tags")), f"{base}/roads")
    write_extract(ways.select("id", "refs", "tags"), f"{base}/roads")
    return f"{base}/addresses", f"{base}/roads"


def extract_houses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Houses of a map extract that is written and read back by ranges of its bytes; only nodes with a house number are made."""
    points, roads = _written_extracts(spark, sf_dir)
    nodes = extract_rows(spark, points, "node", having="addr:housenumber", split=1 << 20)
    g = build_gazetteer(addresses(nodes, extract_rows(spark, roads, "way", having="addr:housenumber")))
    named = g.houses.join(g.streets.select("street_id", F.col("name_norm").alias("street")), "street_id").join(g.cities.select("city_id", F.col("name_norm").alias("city")), "city_id")
    return named.select("city", "street", F.col("house_norm").alias("house"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


EXTRACT_HOUSES_SQL = f"WITH {places.ADDRESSES} SELECT city, street, house, round(lat, 6) AS lat, round(lon, 6) AS lon FROM h"


def extract_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build from map extracts that are written and read back: vertices without tags, roads, address points."""
    points, roads = _written_extracts(spark, sf_dir)
    ways = extract_rows(spark, roads, "way", having="highway", split=1 << 18)
    vertices = extract_rows(spark, roads, "node", "id,lat,lon", split=1 << 18)
    g = build_gazetteer(addresses(extract_rows(spark, points, "node", having="addr:housenumber", split=1 << 20), ways))
    g.intersections = build_intersections(ways, vertices, g, spark.createDataFrame([], "name_norm string"))
    return places.named_crossings(g)


def streamed_firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rows by key of a stream in several batches, kept as state (here: order lines by supplier and quantity, in the order of orders)."""
    base, key, payload = _shared_folder(spark), ["l_suppkey", "l_quantity"], ["l_discount", "l_tax"]
    lines = _t(spark, sf_dir, "lineitem").withColumn("seq", F.col("l_orderkey") * 8 + F.col("l_linenumber")).select(*key, "seq", *payload)
    # Four batches, each of as many ranges as hold about a million rows, so no task sorts more when there are more lines.
    ranges = -(-lines.count() // (BATCHES * RANGE_ROWS)) or 1
    lines.repartitionByRange(BATCHES * ranges, "seq").sortWithinPartitions("seq").write.parquet(f"{base}/in")
    # The files' names have the order of their rows; each batch takes the next ones.
    files = sorted({f for f in spark.read.parquet(f"{base}/in").inputFiles()})
    each = -(-len(files) // BATCHES)
    for k in range(0, len(files), each):
        spark.read.schema(lines.schema).parquet(*files[k : k + each]).write.mode("append").parquet(f"{base}/arriving/day={k}")
        source = spark.readStream.schema(lines.schema).option("basePath", f"{base}/arriving").parquet(f"{base}/arriving/day=*")
        append_first_arrivals(source, key, "seq", payload, f"{base}/table", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/table").select(*key, "seq", *payload)


STREAMED_SQL = """
SELECT l_suppkey, l_quantity, l_orderkey * 8 + l_linenumber AS seq, l_discount, l_tax FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_quantity ORDER BY l_orderkey * 8 + l_linenumber, l_discount, l_tax) = 1"""

def imported_houses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Houses of three extracts that are imported one by one; a fourth one is broken and left out, a second run adds nothing (here: order lines by order)."""
    base, rows = _shared_folder(spark), places._addresses(spark, sf_dir)
    tags = F.create_map(F.lit("addr:city"), F.col("city"), F.lit("addr:street"), F.col("street"), F.lit("addr:housenumber"), F.col("house"))
    files = [f"{base}/region-{k}" for k in range(3)]
    for k, file in enumerate(files):
        own = rows.where(F.col("seq.l_orderkey") % 3 == k).repartitionByRange("seq").sortWithinPartitions("seq")
        write_extract(own.select((F.col("seq.l_orderkey") * 8 + F.col("seq.l_linenumber")).alias("id"), "lat", "lon", tags.alias("tags")), file)
    _t(spark, sf_dir, "supplier").limit(9).select("s_name").coalesce(1).write.text(f"{base}/broken")
    none = spark.createDataFrame([], "name_norm string")
    for _ in range(2):
        import_extracts(spark, [files[0], f"{base}/broken", *files[1:]], f"{base}/gazetteer", none)
    g = imported(spark, f"{base}/gazetteer")
    named = g.houses.join(g.streets.select("street_id", F.col("name_norm").alias("street")), "street_id").join(g.cities.select("city_id", F.col("name_norm").alias("city")), "city_id")
    return named.select("city", "street", F.col("house_norm").alias("house"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


IMPORTED_SQL = f"""WITH {places.ADDRESSES} SELECT city, street, house, round(lat, 6) AS lat, round(lon, 6) AS lon FROM a
QUALIFY row_number() OVER (PARTITION BY city, street, house ORDER BY l_orderkey % 3, l_orderkey, l_linenumber, l_partkey, l_suppkey, lat, lon) = 1"""

QUERIES = {
    "imported_houses": (imported_houses, IMPORTED_SQL),
    "names_by_part": (names_by_part, HOLDING_SQL), "similar_names": (similar_names, None), "nearest_place": (nearest_place, NEAREST_PLACE_SQL), "crossings_by_distance": (crossings_by_distance, DISTANCE_SQL),
    "extract_houses": (extract_houses, EXTRACT_HOUSES_SQL), "extract_crossings": (extract_crossings, places.CROSSING_SQL), "streamed_firsts": (streamed_firsts, STREAMED_SQL),
}
