"""Seed tables (CSV), requests (JSON), emblem index (Parquet), images (binary files) as DataFrames with fixed schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.text import trimmed

FRAGMENTS = "array<struct<id: string, created_at_ms: long, rect: struct<x: int, y: int, w: int, h: int>, note: string, ocr_text: string, image_b64: string, clue_type: string>>"
REQUEST = f"schema string, created_at_ms long, manual_text string, mode string, fragments {FRAGMENTS}"
EMBLEMS = "id string, name string, kind string, lat double, lon double, vector array<float>"
#: Cities to fall back on when there is no city table (fixed values: name, lat, lon, aliases).
CITIES = [
    ("Москва", 55.7558, 37.6173, "мск|moscow"),
    ("Санкт-Петербург", 59.9386, 30.3141, "питер|спб|saint petersburg|st petersburg"),
    ("Новосибирск", 55.0084, 82.9357, "академгородок|novosibirsk"),
    ("Екатеринбург", 56.8389, 60.6057, "екб|yekaterinburg"),
    ("Казань", 55.7961, 49.1064, "kazan"),
    ("Нижний Новгород", 56.2965, 43.9361, "нн|nizhny novgorod"),
    ("Краснодар", 45.0355, 38.9753, "krasnodar"),
    ("Сочи", 43.5855, 39.7231, "sochi"),
    ("Ростов-на-Дону", 47.2357, 39.7015, "ростов|rostov-on-don"),
    ("Самара", 53.1959, 50.1002, "samara"),
    ("Уфа", 54.7388, 55.9721, "ufa"),
    ("Пермь", 58.0105, 56.2502, "perm"),
    ("Владивосток", 43.1155, 131.8855, "vladivostok"),
    ("Хабаровск", 48.4802, 135.0719, "khabarovsk"),
    ("Тюмень", 57.1530, 65.5343, "tyumen"),
    ("Челябинск", 55.1644, 61.4368, "chelyabinsk"),
    ("Омск", 54.9893, 73.3682, "omsk"),
    ("Воронеж", 51.6608, 39.2003, "voronezh"),
]
#: Dialling codes of three digits, as texts give them (fixed values: code, city, lat, lon).
PHONE_CODES = [
    ("495", "Москва", 55.7558, 37.6173), ("499", "Москва", 55.7558, 37.6173), ("812", "Санкт-Петербург", 59.9386, 30.3141),
    ("813", "Санкт-Петербург", 59.9386, 30.3141), ("383", "Новосибирск", 55.0084, 82.9357), ("343", "Екатеринбург", 56.8389, 60.6057),
    ("843", "Казань", 55.7961, 49.1064), ("831", "Нижний Новгород", 56.2965, 43.9361), ("861", "Краснодар", 45.0355, 38.9753),
    ("863", "Ростов-на-Дону", 47.2357, 39.7015), ("846", "Самара", 53.1959, 50.1002), ("347", "Уфа", 54.7388, 55.9721),
    ("342", "Пермь", 58.0105, 56.2502), ("423", "Владивосток", 43.1155, 131.8855), ("351", "Челябинск", 55.1644, 61.4368),
    ("473", "Воронеж", 51.6608, 39.2003), ("862", "Сочи", 43.5855, 39.7231), ("391", "Красноярск", 56.0153, 92.8932),
]


def csv_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as strings; a missing file has no rows.  Line ends inside quotes and a leading byte order mark are read."""
    try:
        raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    names = {c.lstrip("﻿").strip(): c for c in raw.columns}
    return raw.select(*(F.col(f"`{names[c]}`").alias(c) if c in names else F.lit(None).cast("string").alias(c) for c in columns))


def number(name: str):
    """A number with decimal point or comma; null if it is none."""
    return F.replace(trimmed(F.col(name)), F.lit(","), F.lit(".")).try_cast("double")


def split_list(name: str):
    """Parts between bars, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(F.col(name), F.lit("")), r"\|"), trimmed), lambda x: x != "")


def _complete(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.where(F.col(n).isNotNull() & (F.col(n).cast("string") != ""))
    return df


def cities(spark: SparkSession, path: str) -> DataFrame:
    """name, lat, lon, aliases; rows without a name or numbers are dropped, an empty table gives CITIES."""
    def shaped(rows: DataFrame) -> DataFrame:
        return _complete(rows.select(trimmed(F.col("name")).alias("name"), number("lat").alias("lat"), number("lon").alias("lon"), split_list("aliases").alias("aliases")), "name", "lat", "lon")

    found = shaped(csv_rows(spark, path, ["name", "lat", "lon", "aliases"]))
    return shaped(spark.createDataFrame([(n, str(a), str(o), s) for n, a, o, s in CITIES], "name string, lat string, lon string, aliases string")) if found.isEmpty() else found


def streets(spark: SparkSession, path: str) -> DataFrame:
    return _complete(csv_rows(spark, path, ["city", "street", "aliases"]).select("city", "street", split_list("aliases").alias("aliases")), "city", "street")


def houses(spark: SparkSession, path: str) -> DataFrame:
    rows = csv_rows(spark, path, ["city", "street", "house", "lat", "lon"])
    return _complete(rows.select("city", "street", "house", number("lat").alias("lat"), number("lon").alias("lon")), "city", "street", "house", "lat", "lon")


def intersections(spark: SparkSession, path: str) -> DataFrame:
    rows = csv_rows(spark, path, ["city", "street_a", "street_b", "lat", "lon"])
    return _complete(rows.select("city", "street_a", "street_b", number("lat").alias("lat"), number("lon").alias("lon")), "city", "street_a", "street_b", "lat", "lon")


def keyed(spark: SparkSession, path: str, key: str, columns: list[str]) -> DataFrame:
    """Rows by their trimmed upper-case key, the last of equal keys; blank keys are dropped."""
    rows = csv_rows(spark, path, [key, *columns]).withColumn("__seq", F.monotonically_increasing_id())
    rows = rows.withColumn(key, F.upper(trimmed(F.coalesce(F.col(key), F.lit(""))))).where(F.col(key) != "")
    return rows.groupBy(key).agg(*(F.max_by(c, "__seq").alias(c) for c in columns))


def plate_regions(spark: SparkSession, path: str) -> DataFrame:
    rows = keyed(spark, path, "code", ["region", "lat", "lon"])
    return rows.select("code", F.col("region").alias("name"), number("lat").alias("lat"), number("lon").alias("lon")).dropna()


def highways(spark: SparkSession, path: str) -> DataFrame:
    rows = keyed(spark, path, "code", ["name", "lat", "lon", "hint"])
    return rows.select("code", "name", number("lat").alias("lat"), number("lon").alias("lon"), "hint").dropna(subset=["name", "lat", "lon"])


def phone_cities(spark: SparkSession) -> DataFrame:
    rows = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(r, ("code", "name", "lat", "lon"), strict=True))) for r in PHONE_CODES))
    return spark.range(1).select(F.inline(rows))  # so that Spark knows how small the table is


def requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests, one JSON object a line, with defaults for text and mode."""
    rows = spark.read.schema(REQUEST).json(path)
    return rows.fillna({"manual_text": "", "mode": "geoguess"}).withColumn("request_id", F.xxhash64(F.to_json(F.struct(*rows.columns))))


def images(spark: SparkSession, path: str, least_bytes: int = 500) -> DataFrame:
    """path and content of image files; smaller files are failed downloads."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") >= least_bytes).select("path", "content")


def decoded_image(column: str):
    """Bytes of a base64 column; null if it is none."""
    return F.try_to_binary(F.col(column), F.lit("base64"))


def extracts(spark: SparkSession, path: str, suffix: str = "*.pbf", exclude: tuple[str, ...] = ()) -> DataFrame:
    """Files below a folder in name order, without those whose base name holds an excluded part (any case)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(path).select("path", "length")
    base = F.lower(F.element_at(F.split("path", "/"), -1))
    for part in exclude:
        files = files.where(~F.contains(base, F.lit(part.lower())))
    return files.orderBy("path")
