"""Commands: build a gazetteer, resolve requests, show table states, run regression cases."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.gazetteer import Gazetteer, addresses, build_gazetteer, build_intersections
from wayfold.plans import regression
from wayfold.plans.health import health
from wayfold.plans.imports import import_extracts, import_totals, imported
from wayfold.plans.locate import Seeds, locate, located, responses
from wayfold.plans.report import report
from wayfold.sources import osm, seeds

log = logging.getLogger("wayfold")


def read_seeds(spark: SparkSession, path: str) -> Seeds:
    return Seeds(
        seeds.cities(spark, f"{path}/cities.csv"), seeds.plate_regions(spark, f"{path}/plate_regions.csv"), seeds.highways(spark, f"{path}/highways.csv"), seeds.phone_cities(spark),
        seeds.houses(spark, f"{path}/houses.csv"), seeds.intersections(spark, f"{path}/intersections.csv"),
    )


def arguments(args: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="wayfold", description=__doc__)
    parser.add_argument("--seeds", default="seeds", help="folder of the seed tables")
    parser.add_argument("--gazetteer", default="gazetteer", help="folder of the gazetteer tables")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="map extracts to a gazetteer")
    build.add_argument("path", help="a folder or file of extracts, in any store that Spark reads")
    build.add_argument("--exclude", action="append", default=[], help="part of the name of files to leave out")
    build.add_argument("--default-city", default="")
    build.add_argument("--limit", type=int, help="addresses at most")
    build.add_argument("--max-inserts", type=int, help="crossings at most")
    build.add_argument("--log", help="a file to append time-stamped lines to")
    build.add_argument("--stop-on-error", action="store_true", help="end at a file that cannot be read; else go on without it")
    many = commands.add_parser("import", help="map extracts to a gazetteer, one after the other; finished ones are not read again")
    many.add_argument("path", help="a folder or file of extracts, in a store that pyarrow reads")
    many.add_argument("--exclude", action="append", default=[], help="part of the name of files to leave out")
    many.add_argument("--default-city", default="")
    many.add_argument("--stop-on-error", action="store_true", help="end at a file that fails; else it is left out as a whole")
    find = commands.add_parser("locate", help="requests (JSON lines) to responses")
    find.add_argument("requests")
    find.add_argument("out")
    commands.add_parser("health", help="row counts of the tables")
    told = commands.add_parser("report", help="table counts, latency medians and share of passed cases as text")
    told.add_argument("--samples", help="CSV of class,ms")
    told.add_argument("--csv", default="regression_cases.csv")
    check = commands.add_parser("regression", help="0: all cases pass, 1: some fail, 2: they cannot be run")
    check.add_argument("--csv", default="regression_cases.csv")
    return parser.parse_args(args)


def _resolved(cases: DataFrame, gazetteer: Gazetteer, known: Seeds) -> DataFrame:
    asked = cases.select("request_id", "manual_text", F.lit("geoguess").alias("mode"), F.from_json(F.lit("[]"), seeds.FRAGMENTS).alias("fragments"))
    best = locate(asked, gazetteer, known).where("rank = 1").join(cases.select("id", "request_id"), "request_id")
    return regression.checked(cases, best.select("id", "kind", "name"))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments(args)
    spark = spark or SparkSession.builder.appName("wayfold").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    known = read_seeds(spark, a.seeds)
    if a.command == "import":
        files = [r.path for r in seeds.extracts(spark, a.path, exclude=tuple(a.exclude)).select("path").collect()]
        found = import_extracts(spark, sorted(files), f"{a.gazetteer}/imports", known.major(), a.default_city, a.stop_on_error)
        imported(spark, f"{a.gazetteer}/imports").save(a.gazetteer)
        import_totals(found).show(truncate=False)
        return 0 if found.where("error is not null").isEmpty() else 1
    if a.command == "build":
        files = [r.path for r in seeds.extracts(spark, a.path, exclude=tuple(a.exclude)).select("path").collect()]
        if a.log:
            handler = logging.FileHandler(a.log, encoding="utf-8")
            handler.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
            log.addHandler(handler)
            log.setLevel(logging.INFO)
        log.info("%d files", len(files))
        nodes, ways = osm.read_pbf(spark, files, strict=a.stop_on_error)
        gazetteer = build_gazetteer(addresses(nodes, ways, a.default_city, a.limit))
        gazetteer.intersections = build_intersections(ways, nodes, gazetteer, known.major(), most=a.max_inserts)
        gazetteer.save(a.gazetteer)
        for r in health(Gazetteer.load(spark, a.gazetteer), known).orderBy("name").collect():
            log.info("%s: %d", r.name, r.n)
        return 0
    try:
        gazetteer = Gazetteer.load(spark, a.gazetteer)
        if a.command == "health":
            health(gazetteer, known).orderBy("name").show(100, False)
            return 0
        if a.command == "report":
            samples = spark.read.csv(a.samples, header=True, schema="class string, ms double") if a.samples else None
            found = regression.cases(spark, a.csv).withColumn("request_id", F.xxhash64("id"))
            results = None if found.isEmpty() else _resolved(found, gazetteer, known)
            print("\n".join(r.line for r in report(gazetteer, known, samples, results).orderBy("nth").collect()))
            return 0
        if a.command == "locate":
            asked = seeds.requests(spark, a.requests)
            responses(asked, *located(asked, gazetteer, known)).select(F.col("json").alias("value")).write.mode("overwrite").text(a.out)
            return 0
        cases = regression.cases(spark, a.csv).withColumn("request_id", F.xxhash64("id"))
        if cases.isEmpty():
            log.error("no enabled case in %s", a.csv)
            return 2
        results = _resolved(cases, gazetteer, known)
        results.orderBy("id").show(1000, False)
        counts = regression.summary(results).first()
        return 0 if counts.passed == counts.cases else 1
    except AnalysisException as e:
        log.error("%s", e)
        return 2


if __name__ == "__main__":
    sys.exit(main())
