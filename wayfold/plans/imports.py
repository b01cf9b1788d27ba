"""Import of many extracts, one after the other, with a table of finished ones: a run can be repeated and goes on where it ended.

Below a folder there are the gazetteer's tables of each import (``part=<number>/cities`` ...) and ``finished``, a row for each
import that is whole: file, bytes, part, rows, error.  A part counts only once its row is there, so an import that fails, or ends
in the middle, leaves nothing behind: the next run writes its part anew.  A file that cannot be read gets a row with its
error and no part; it is tried again by the next run.  Keys that earlier imports have stay as they are, new ones get
ids that go on.  One run at a time writes below a folder.
"""

from __future__ import annotations

import logging
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.gazetteer import Gazetteer, addresses, build_gazetteer, build_intersections
from wayfold.sources.extracts import check_beginnings, read_extracts, sizes
from wayfold.tables import numbered, stored

log = logging.getLogger("wayfold")
FINISHED = "file string, bytes long, part long, cities long, streets long, houses long, intersections long, error string"
SCHEMAS = {
    "cities": "city_id long, name string, name_norm string, lat double, lon double", "streets": "street_id long, city_id long, name string, name_norm string",
    "houses": "house_id long, city_id long, street_id long, house string, house_norm string, lat double, lon double",
    "intersections": "inter_id long, city_id long, street_a_id long, street_b_id long, lat double, lon double",
}


def finished(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``finished`` (none if nothing was imported)."""
    try:
        return spark.read.schema(FINISHED).parquet(f"{path}/finished")
    except PySparkException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], FINISHED)


def imported(spark: SparkSession, path: str) -> Gazetteer:
    """The gazetteer of all whole imports."""
    parts = [r.part for r in finished(spark, path).where("error is null").select("part").collect()]
    tables = []
    for name, schema in SCHEMAS.items():
        tables.append(spark.read.schema(schema).parquet(*(f"{path}/part={n}/{name}" for n in parts)) if parts else spark.createDataFrame([], schema))
    return Gazetteer(*tables)


def _next(table: DataFrame, id: str) -> int:
    return table.agg(F.coalesce(F.max(id), F.lit(0))).first()[0]


def _placed(new: DataFrame, old: DataFrame, key: list[str], id: str, was: str) -> tuple[DataFrame, DataFrame]:
    """(rows of ``new`` that are new, with ids that go on in the order of their own; was -> id for all rows of ``new``)."""
    new = stored(new.withColumnRenamed(id, was))
    known = new.join(old.select(id, *key), key).select(was, id)
    fresh = new.join(old.select(*key), key, "left_anti")
    fresh = stored(numbered(fresh, "nth", was).withColumn(id, F.col("nth") + _next(old, id)).drop("nth"))
    return fresh, known.union(fresh.select(was, id))


def additions(old: Gazetteer, new: Gazetteer) -> Gazetteer:
    """What ``new`` adds to ``old``: rows whose keys it lacks, their ids going on behind those of ``old``."""
    cities, city = _placed(new.cities, old.cities, ["name_norm"], "city_id", "was_city")
    moved = new.streets.withColumnRenamed("city_id", "was_city").join(city, "was_city").drop("was_city")
    streets, street = _placed(moved, old.streets, ["city_id", "name_norm"], "street_id", "was_street")
    moved = new.houses.withColumnsRenamed({"city_id": "was_city", "street_id": "was_street"}).join(city, "was_city").join(street, "was_street").drop("was_city", "was_street")
    houses, _ = _placed(moved, old.houses, ["city_id", "street_id", "house_norm"], "house_id", "was_house")
    return Gazetteer(*(t.select(*[c.split()[0] for c in SCHEMAS[n].split(", ")]) for n, t in (("cities", cities), ("streets", streets), ("houses", houses))), old.intersections.limit(0))


def _together(old: Gazetteer, new: Gazetteer) -> Gazetteer:
    return Gazetteer(*(old.tables()[n].unionByName(new.tables()[n]) for n in SCHEMAS))


def import_extract(spark: SparkSession, file: str, path: str, part: int, major: DataFrame, default_city: str = "") -> dict[str, int]:
    """Write what one extract (a file or folder) adds as a part; the number of rows of each table."""
    nodes, ways = read_extracts(spark, file)
    old = imported(spark, path)
    added = additions(old, build_gazetteer(addresses(nodes, ways, default_city)))
    for name in ("cities", "streets", "houses"):
        added.tables()[name].write.mode("overwrite").parquet(f"{path}/part={part}/{name}")
    added = Gazetteer(*(spark.read.schema(SCHEMAS[n]).parquet(f"{path}/part={part}/{n}") for n in ("cities", "streets", "houses")), old.intersections.limit(0))
    crossings = build_intersections(ways, nodes, _together(old, added), major)
    fresh, _ = _placed(crossings, old.intersections, ["city_id", "street_a_id", "street_b_id"], "inter_id", "was_inter")
    fresh.select(*[c.split()[0] for c in SCHEMAS["intersections"].split(", ")]).write.mode("overwrite").parquet(f"{path}/part={part}/intersections")
    return {n: spark.read.schema(s).parquet(f"{path}/part={part}/{n}").count() for n, s in SCHEMAS.items()}


def import_extracts(spark: SparkSession, files: list[str], path: str, major: DataFrame, default_city: str = "", stop_on_error: bool = False) -> DataFrame:
    """Import those ``files`` that no run before has finished (by path and size); the rows of ``finished``.

    A file that fails is left out as a whole and logged, unless ``stop_on_error``.
    """
    seen = finished(spark, path).collect()
    whole, part = {(r.file, r.bytes) for r in seen if r.error is None}, max((r.part for r in seen if r.part is not None), default=-1) + 1
    for file in files:
        try:
            bytes_ = sum(n for _, n in sizes([file]))
            if (file, bytes_) in whole:
                log.info("%s: imported before", file)
                continue
            check_beginnings([file])
            counts, error = import_extract(spark, file, path, part, major, default_city), None
        except (PySparkException, Py4JJavaError, OSError, ValueError) as e:  # a job that fails on a cluster may come as a plain error of the JVM
            if stop_on_error:
                raise
            bytes_, counts, error = 0, {}, str(e)[:1000]
            log.error("%s: left out: %s", file, error.strip().partition("\n")[0])
        row = (file, bytes_, None if error else part, *(counts.get(n) for n in SCHEMAS), error)
        spark.createDataFrame([row], FINISHED).write.mode("append").parquet(f"{path}/finished")
        part += error is None
    return finished(spark, path)


def import_totals(rows: DataFrame) -> DataFrame:
    """Sums over the finished imports, and how many failed."""
    sums = reduce(lambda s, n: [*s, F.coalesce(F.sum(n), F.lit(0)).alias(n)], SCHEMAS, [])
    return rows.agg(F.count_if(F.col("error").isNull()).alias("files"), F.count_if(F.col("error").isNotNull()).alias("failed"), *sums)
