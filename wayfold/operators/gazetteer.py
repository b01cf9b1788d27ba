"""Building the gazetteer: addresses from map nodes and ways, first-wins dimensions, street crossings.

Tables: cities (city_id, name, name_norm, lat, lon), streets (street_id, city_id, name, name_norm), houses (house_id,
city_id, street_id, house, house_norm, lat, lon), intersections (inter_id, city_id, street_a_id, street_b_id, lat, lon).
Every table has one row a key; what came first in the extract stays.  Cities are keyed by name alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.text import normalize_house, normalize_import, normalize_street, trimmed
from wayfold.operators.gram_index import GramIndex, build_index
from wayfold.operators.shapes import absent, first_wins
from wayfold.operators.spatial import nearest_places
from wayfold.sources.osm import valid
from wayfold.tables import numbered, spread, stored

#: Road classes whose crossings count (fixed values).
ROADS = ["motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "living_street", "road"]


@dataclass
class Gazetteer:
    cities: DataFrame
    streets: DataFrame
    houses: DataFrame
    intersections: DataFrame
    names: GramIndex | None = None

    def name_index(self) -> GramIndex:
        """The index of the streets' names, made once if it is not stored with the tables."""
        if self.names is None:
            self.names = build_index(self.streets, "name_norm")
        return self.names

    def tables(self) -> dict[str, DataFrame]:
        return {"cities": self.cities, "streets": self.streets, "houses": self.houses, "intersections": self.intersections}

    def save(self, path: str) -> None:
        """As Parquet tables below ``path``, the index of street names too; houses in files by city and street, as every look-up has them; a large city has several."""
        for name, table in self.tables().items():
            (table.repartitionByRange("city_id", "street_id") if name == "houses" else table).write.mode("overwrite").parquet(f"{path}/{name}")
        self.name_index().save(f"{path}/street_names")

    @staticmethod
    def load(spark, path: str) -> Gazetteer:
        return Gazetteer(*(spark.read.parquet(f"{path}/{n}") for n in ("cities", "streets", "houses", "intersections")), GramIndex.load(spark, f"{path}/street_names"))


def _tag(name: str) -> Column:
    return F.nullif(trimmed(F.coalesce(F.col("tags")[name], F.lit(""))), F.lit(""))


def way_centres(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean position of each way's located vertices (a closing vertex counts twice), with its tags."""
    vertices = ways.select("id", F.explode("refs").alias("node")).join(nodes.where(valid()).select(F.col("id").alias("node"), "lat", "lon"), "node")
    return ways.select("id", "tags", "seq").join(vertices.groupBy("id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")), "id")


def addresses(nodes: DataFrame, ways: DataFrame, default_city: str = "", limit: int | None = None) -> DataFrame:
    """city, street, house, lat, lon, seq of everything with an address; files by name, in a file nodes before ways.

    Ways with an address are stored before their vertices are looked up, so nodes are read again only where there is such a way,
    and few ways go to all tasks.
    """
    named = _tag("addr:housenumber").isNotNull() & _tag("addr:street").isNotNull() & F.coalesce(_tag("addr:city"), _tag("addr:place"), F.nullif(F.lit(default_city), F.lit(""))).isNotNull()
    seq = lambda kind: F.struct(F.col("seq.path").alias("path"), F.lit(kind).alias("kind"), F.col("seq.at").alias("at")).alias("seq")
    points = nodes.where(named & valid()).select("tags", "lat", "lon", seq(0))
    outlines = stored(ways.where(named))
    if not outlines.isEmpty():
        points = points.union(way_centres(outlines, nodes).select("tags", "lat", "lon", seq(1)))
    city = F.coalesce(_tag("addr:city"), _tag("addr:place"), F.lit(default_city))
    found = points.select(city.alias("city"), _tag("addr:street").alias("street"), _tag("addr:housenumber").alias("house"), "lat", "lon", "seq")
    return found if limit is None else found.orderBy("seq").limit(limit)


def build_gazetteer(rows: DataFrame) -> Gazetteer:
    """Cities, streets and houses of address rows; ids follow first appearance."""
    # Normal forms are the costly part, so of equal spellings only the first row gets to them.  Stored, as the condition
    # below would else be pushed through the aggregate and so take the normal forms of every row.
    spelt = stored(first_wins(rows, ["city", "street", "house"], "seq", ["lat", "lon"]))
    keyed = spread(spelt, "city", "street", "house", rows=50_000).withColumns({"city_norm": normalize_import(F.col("city")), "street_norm": normalize_street(F.col("street")), "house_norm": normalize_house(F.col("house"))})
    keyed = keyed.where("city_norm <> '' and street_norm <> '' and house_norm <> ''")
    # The first row of a street is the first row of one of its houses, that of a city the first of one of its streets.
    first_houses = stored(first_wins(keyed, ["city_norm", "street_norm", "house_norm"], "seq", ["city", "street", "house", "lat", "lon"]))
    first_streets = stored(first_wins(first_houses, ["city_norm", "street_norm"], "seq", ["city", "street", "lat", "lon"]))
    cities = numbered(first_wins(first_streets, ["city_norm"], "seq", ["city", "lat", "lon"]), "city_id", "seq", "city_norm")
    cities = cities.select("city_id", F.col("city").alias("name"), F.col("city_norm").alias("name_norm"), "lat", "lon")
    streets = numbered(first_streets, "street_id", "seq", "city_norm", "street_norm", ready=True).join(cities.select("city_id", F.col("name_norm").alias("city_norm")), "city_norm")
    keys = stored(streets.select("street_id", "city_id", "street", "street_norm", "city_norm"))
    streets = keys.select("street_id", "city_id", F.col("street").alias("name"), F.col("street_norm").alias("name_norm"))
    houses = numbered(first_houses, "house_id", "seq", "city_norm", "street_norm", "house_norm", ready=True).join(keys.drop("street"), ["city_norm", "street_norm"])
    houses = houses.select("house_id", "city_id", "street_id", "house", "house_norm", "lat", "lon")
    empty = rows.sparkSession.createDataFrame([], "inter_id long, city_id long, street_a_id long, street_b_id long, lat double, lon double")
    return Gazetteer(cities, streets, houses, empty)


def appended(old: DataFrame, new: DataFrame, key: list[str], id: str) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks, with ids that go on (insert-if-absent over files)."""
    fresh = absent(new.drop(id), old, key)
    top = old.agg(F.coalesce(F.max(id), F.lit(0))).first()[0]
    return old.unionByName(numbered(fresh, id, *key).withColumn(id, F.col(id) + top).select(*old.columns))


def road_points(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, lat, lon, names) of the vertices of two named roads and more: a row a vertex, its names in order, each once."""
    name = trimmed(F.coalesce(F.col("tags")["name"], F.lit("")))
    roads = stored(ways.where(F.col("tags")["highway"].isin(ROADS) & F.length(name).between(3, 120)).select(name.alias("name"), "refs"))
    names = stored(roads.select("name").distinct()).select("name", normalize_street(F.col("name")).alias("name_norm"))
    named = roads.join(stored(names.where(F.length("name_norm") >= 2)), "name").select("name_norm", F.explode("refs").alias("node"))
    # Stored, so that few or no such vertices are sent to the nodes, which need not be shuffled then.
    shared = stored(named.groupBy("node").agg(F.sort_array(F.collect_set("name_norm")).alias("names")).where(F.size("names") >= 2))
    located = nodes.where(valid()).select(F.col("id").alias("node"), "lat", "lon").join(shared, "node")
    return located.groupBy("node").agg(F.min(F.struct("lat", "lon")).alias("at"), F.first("names").alias("names")).select("node", "at.*", "names")


def _pairs_of(rows: DataFrame, names: str, *columns: str) -> DataFrame:
    """A row (columns, a, b) for each two of a row's sorted names, in order."""
    first = rows.select(*columns, names, F.posexplode(names).alias("k", "a"))
    return first.select(*columns, "a", F.explode(F.slice(names, F.col("k") + 2, F.size(names))).alias("b"))


def build_intersections(ways: DataFrame, nodes: DataFrame, gazetteer: Gazetteer, major: DataFrame, ordered_names_only: bool = False, most: int | None = None, nearest: bool = False) -> DataFrame:
    """Crossings of two named roads, in the city that has both streets and the most houses (then a major city).

    ``nearest``: a crossing lies in the city whose position is nearest to it, if that has both streets.  Pairs are unordered.  ``major`` (name_norm) lists major cities.  ``ordered_names_only`` keeps only pairs whose smaller
    name has the smaller street id; ``most`` ends after that many crossings, in the order of their cities and streets.
    """
    points = stored(road_points(ways, nodes))
    own = lambda side: gazetteer.streets.select("city_id", F.col("name_norm").alias(side), F.col("street_id").alias(f"street_{side}_id"))
    # A pair lies in one city, so its first vertex is enough; where the city depends on the vertex, its first one in each such city.
    # All pairs of all vertices are many more than these: they go straight into an aggregate that holds a number a pair.
    if nearest:
        closest = nearest_places(points.select("node", "lat", "lon"), gazetteer.cities, "node", "city_id").drop("km")
        known = points.select("node", F.explode("names").alias("a")).join(closest, "node").join(own("a"), ["city_id", "a"], "left")
        known = known.groupBy("node", "city_id").agg(F.sort_array(F.collect_list(F.struct("a", F.col("street_a_id").isNotNull().alias("there")))).alias("known"))
        pairs = _pairs_of(known, "known", "node", "city_id")
        close_by = F.when(F.col("a.there") & F.col("b.there"), F.col("city_id"))
        crossings = stored(pairs.groupBy(close_by.alias("city_id"), F.col("a.a").alias("a"), F.col("b.a").alias("b")).agg(F.min("node").alias("node")))
    else:
        crossings = stored(_pairs_of(points, "names", "node").groupBy("a", "b").agg(F.min("node").alias("node")))
    counts = gazetteer.houses.groupBy("city_id").agg(F.count("*").alias("n"))
    large = major.select("name_norm").distinct().withColumn("major", F.lit(True))
    cities = gazetteer.cities.select("city_id", "name_norm").join(large, "name_norm", "left").select("city_id", F.coalesce("major", F.lit(False)).alias("major"))
    weights = cities.join(counts, "city_id", "left").select("city_id", (F.coalesce("n", F.lit(0)) * 2 + F.col("major").cast("int")).alias("weight"))
    # Only pairs that cross somewhere meet the street tables, not all pairs of a city's streets.
    both = crossings.select("a", "b").distinct().join(own("a"), "a").join(own("b"), ["city_id", "b"]).join(weights, "city_id")
    best = both.groupBy("a", "b").agg(F.max_by(F.struct("city_id", "street_a_id", "street_b_id"), F.struct("weight", -F.col("city_id"))).alias("best"))
    columns = ["node", "city_id", "street_a_id", "street_b_id"]
    rest = crossings.where("city_id is null").drop("city_id") if nearest else crossings
    placed = rest.join(best, ["a", "b"]).select("node", "best.*")
    if nearest:
        placed = placed.select(*columns).union(crossings.join(own("a"), ["city_id", "a"]).join(own("b"), ["city_id", "b"]).select(*columns))
    if ordered_names_only:
        placed = placed.where("street_a_id < street_b_id")
    first = placed.groupBy("city_id", "street_a_id", "street_b_id").agg(F.min("node").alias("node")).join(points.drop("names"), "node")
    if most is not None:
        first = first.orderBy("city_id", "street_a_id", "street_b_id").limit(most)
    return numbered(first, "inter_id", "city_id", "street_a_id", "street_b_id").select("inter_id", "city_id", "street_a_id", "street_b_id", "lat", "lon")


def import_counts(rows: DataFrame) -> DataFrame:
    """Distinct cities and streets, and house rows seen, of address rows."""
    city, street = normalize_import(F.col("city")), normalize_street(F.col("street"))
    spelt = rows.groupBy("city", "street").agg(F.count("*").alias("n"))
    return spelt.agg(F.count_distinct(city).alias("cities"), F.count_distinct(city, street).alias("streets"), F.coalesce(F.sum("n"), F.lit(0)).alias("houses"))
