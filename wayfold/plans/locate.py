"""Resolving batches of requests into ranked places.

Every stage is a set of joins over all requests at once.  Stage tables have the columns of CANDIDATE; ``locate``
keeps, for each request, the rows of the first stage that has any, ranks them and shapes the response.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import clues, text
from wayfold.functions.fuzzy import partial_ratio
from wayfold.functions.geo import haversine_km, house_score, ordinal_score, pair_score, street_score
from wayfold.functions.streets import street_candidates
from wayfold.operators.gazetteer import Gazetteer
from wayfold.operators.gram_index import build_index, names_holding, names_similar
from wayfold.operators.shapes import centroids, merge_top, running_flag, slice_then_merge
from wayfold.operators.vectors import emblem_matches
from wayfold.tables import spread, stored

CANDIDATE = "request_id long, kind string, name string, city string, lat double, lon double, score double, priority int, seq long, detail string, fragment_id string"
STAGES = ["clues", "house", "listed_house", "intersection", "listed_intersection", "pair_centroid", "street_centroid", "city"]


@dataclass
class Seeds:
    """Small curated tables beside the gazetteer."""

    cities: DataFrame
    plates: DataFrame
    highways: DataFrame
    phones: DataFrame
    houses: DataFrame | None = None
    intersections: DataFrame | None = None
    emblems: DataFrame | None = None

    def city_keys(self) -> DataFrame:
        """key (name or alias, normalised), name, lat, lon, own (whether the key is the name)."""
        keys = F.concat(F.array("name"), "aliases")
        rows = self.cities.select("name", "lat", "lon", F.posexplode(keys).alias("at", "key"))
        return rows.select(text.normalize(F.col("key")).alias("key"), "name", "lat", "lon", (F.col("at") == 0).alias("own")).where("key <> ''")

    def major(self) -> DataFrame:
        """name_norm of the seed cities."""
        return self.cities.select(text.normalize_import(F.col("name")).alias("name_norm")).distinct()


def _candidate(df: DataFrame, kind: Column | str, name: Column, score: Column | str, seq: Column, **more: Column) -> DataFrame:
    given = {"city": F.lit(None), "detail": F.lit(None), "fragment_id": F.lit(None)} | more
    kind = F.lit(kind) if isinstance(kind, str) else kind
    score = F.col(score) if isinstance(score, str) else score
    columns = {"kind": kind, "name": name, "score": score.cast("double"), "priority": clues.kind_priority(kind), "seq": seq.cast("long")}
    return df.select("request_id", *(c.alias(n) for n, c in columns.items()), "lat", "lon", *(c.cast("string").alias(n) for n, c in given.items()))


def request_texts(requests: DataFrame) -> DataFrame:
    """request_id, mode, text (manual text, notes and recognised text of all fragments, distinct, by line)."""
    parts = F.concat(F.array("manual_text"), F.flatten(F.transform(F.coalesce("fragments", F.array()), lambda f: F.array(f["note"], f["ocr_text"]))))
    return requests.select("request_id", F.coalesce("mode", F.lit("geoguess")).alias("mode"), text.joined_text(parts).alias("text"))


def keys_inside(q: DataFrame, seeds: Seeds) -> DataFrame:
    """(request_id, key): seed names that a text (tokens, norm) holds; up to three characters as a token, else anywhere.

    Longer ones are met by their first four characters, which must be among those of the text, and then compared.
    """
    keys = seeds.city_keys().select("key").distinct()
    short = q.select("request_id", F.explode(F.array_distinct("tokens")).alias("key")).join(keys.where("length(key) <= 3"), "key")
    long = keys.where("length(key) > 3").select("key", F.substring("key", 1, 4).alias("gram"))
    met = q.select("request_id", "norm", F.explode(text.grams(F.col("norm"), 4)).alias("gram")).join(long, "gram").where(F.contains("norm", F.col("key")))
    return short.select("request_id", "key").union(met.select("request_id", "key"))


def queried(texts: DataFrame, seeds: Seeds, gazetteer: Gazetteer) -> DataFrame:
    """Texts with tokens, street names, house number and the city that a token names (city_id null if none)."""
    c = F.col("text")
    read = stored(texts.withColumns({"tokens": text.tokens(c), "norm": text.normalize(c), "markers": text.street_marker_count(c), "number": text.house_number(c)}))
    words = read.select("request_id", F.explode(F.array_distinct(F.split(text.normalize_ocr(c), " "))).alias("key"))
    held = words.join(seeds.city_keys().select("key").distinct(), "key").select("request_id", "key").union(keys_inside(read, seeds))
    held = held.groupBy("request_id").agg(F.collect_set("key").alias("cities"))
    q = read.join(held, "request_id", "left").withColumn("cities", F.coalesce("cities", F.array().cast("array<string>")))
    q = q.withColumns({"streets": street_candidates(c, F.col("cities")), "named": text.name_tokens(c, F.col("cities"))})
    hints = q.select("request_id", F.posexplode("tokens").alias("pos", "key")).join(seeds.city_keys().select("key", F.col("name").alias("hint_city")), "key")
    hints = hints.groupBy("request_id").agg(F.min_by("hint_city", F.struct("pos", "hint_city")).alias("hint_city"))
    ids = gazetteer.cities.select(F.col("name_norm").alias("hint_norm"), F.col("city_id").alias("hint_id"))
    q = q.join(hints, "request_id", "left").withColumn("hint_norm", text.normalize_import(F.col("hint_city")))
    q = q.join(ids, "hint_norm", "left")
    chosen = F.when(F.size("streets") >= 2, F.col("streets")).otherwise(F.array_distinct(F.concat("streets", F.transform("named", text.normalize_street))))
    return stored(q.withColumn("pairing", chosen).withColumn("pairs", text.pairs(F.col("pairing"))))


def _in_hinted_city(asked: DataFrame, streets: DataFrame, name: str) -> DataFrame:
    """``asked`` with the streets (city_id) of equal ``name``: those of the city that a text hints at, else of all."""
    hinted = asked.where("hint_id is not null").withColumn("city_id", F.col("hint_id")).join(streets, [name, "city_id"])
    return hinted.unionByName(asked.where("hint_id is null").join(streets, name))


def street_matches(q: DataFrame, gazetteer: Gazetteer) -> DataFrame:
    """request_id, pos, query, street_id, city_id, name, similarity: exact names, else names that hold the query's beginning
    anywhere (by the stored index of names); then kind of street, word overlap and similarity (72 at least) are held against the query.

    Each query and name are compared once, whatever the number of requests and cities.
    """
    asked = stored(q.select("request_id", "hint_id", text.street_kind(F.col("norm")).alias("kind"), F.posexplode(F.slice("streets", 1, 8)).alias("pos", "query")).where(F.length("query") >= 2))
    streets = gazetteer.streets.select("street_id", "city_id", "name", "name_norm", text.street_kind(F.col("name")).alias("own"))
    exact = _in_hinted_city(asked.withColumn("name_norm", F.col("query")), streets, "name_norm")
    left = stored(asked.join(exact.select("request_id", "pos"), ["request_id", "pos"], "left_anti"))
    queries = left.select("query").distinct().withColumn("start", F.substring("query", 1, 16))
    held = stored(queries.join(names_holding(queries, "start", gazetteer.name_index()).withColumnRenamed("text", "name_norm"), "start").drop("start"))
    part = held.withColumn("similarity", F.when(F.contains("name_norm", F.col("query")), 100.0).otherwise(partial_ratio("query", "name_norm")))
    long = lambda c: F.filter(F.split(c, " "), lambda t: F.length(t) >= 3)
    overlap = (F.size(long("query")) < 2) | (F.size(F.array_intersect(long("query"), long("name_norm"))) >= 2)
    part = stored(part.where(overlap & (F.col("similarity") >= 72)))
    met = _in_hinted_city(left.join(part, "query"), streets, "name_norm")
    found = exact.withColumn("similarity", F.lit(100.0)).where(overlap).unionByName(met)
    return found.where(F.col("kind").isNull() | F.col("own").isNull() | (F.col("kind") == F.col("own"))).drop("kind", "own", "hint_id")


def numbered_houses(asked: DataFrame, houses: DataFrame) -> DataFrame:
    """The house of each (city_id, street_id, number) of a table of distinct ones: the one with the number, else the nearest number of the street.

    Nearest numbers are found among a street's sorted numbers, one house a number, so neither repeated nor distant ones multiply.
    """
    key, by = ["city_id", "street_id"], ["city_id", "street_id", "number"]
    houses = houses.select(*key, "house", "house_norm", "lat", "lon", "house_id")
    keys = asked.select(*by, F.posexplode(text.house_keys(F.col("number"))).alias("nth", "house_norm"))
    exact = keys.join(houses, [*key, "house_norm"]).groupBy(*by).agg(F.min_by(F.struct("house", "lat", "lon", F.lit(0).cast("long").alias("distance")), F.struct("nth", "house_id")).alias("h"))
    left = asked.join(exact.select(*by), by, "left_anti").withColumn("wanted", text.house_number_int(F.col("number"))).where("wanted is not null")
    left = stored(left)
    known = houses.join(left.select(*key).distinct(), key, "left_semi").withColumn("at", text.house_number_int(F.col("house_norm"))).where("at is not null")
    known = known.groupBy(*key, "at").agg(F.min(F.struct("house_norm", "house_id", "house", "lat", "lon")).alias("first")).withColumn("first", F.struct("at", "first.*"))
    both = known.unionByName(left.select(*key, F.col("wanted").alias("at")).distinct().withColumn("first", F.lit(None).cast(known.schema["first"].dataType)))
    near = lambda order: F.last("first", ignorenulls=True).over(Window.partitionBy(*key).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    sides = both.select(*key, F.col("at").alias("wanted"), F.col("first").isNull().alias("asked"), F.array(near(F.asc("at")), near(F.desc("at"))).alias("sides")).where("asked").drop("asked")
    far = lambda h: F.abs(h["at"] - F.col("wanted"))
    ranked = F.transform(F.filter("sides", lambda h: h.isNotNull()), lambda h: F.struct(far(h).alias("distance"), h["house_norm"].alias("house_norm"), h["house_id"].alias("house_id"), h["house"].alias("house"), h["lat"].alias("lat"), h["lon"].alias("lon")))
    nearest = sides.select(*key, "wanted", F.array_min(ranked).alias("h")).where("h is not null")
    nearest = left.join(nearest, [*key, "wanted"]).select(*by, F.struct("h.house", "h.lat", "h.lon", "h.distance").alias("h"))
    return exact.union(nearest).select(*by, "h.*")


def house_stage(q: DataFrame, gazetteer: Gazetteer, matches: DataFrame) -> DataFrame:
    """The house with the number, else the nearest number of the street; the best one over the request's streets.

    Requests that ask for the same number of the same street share its answer.
    """
    asked = matches.join(q.where("number is not null and markers < 2").select("request_id", "number"), "request_id")
    by = ["city_id", "street_id", "number"]
    found = asked.join(stored(numbered_houses(stored(asked.select(*by).distinct()), gazetteer.houses)), by)
    found = found.select("request_id", "pos", "street_id", "city_id", "name", "similarity", "house", "lat", "lon", "distance").withColumn("score", house_score(F.col("similarity"), F.col("distance")))
    best = found.groupBy("request_id").agg(F.max_by(F.struct(*[c for c in found.columns if c != "request_id"]), F.struct("score", -F.col("pos"), -F.col("street_id"))).alias("b")).select("request_id", "b.*")
    named = best.join(gazetteer.cities.select("city_id", F.col("name").alias("city")), "city_id")
    detail = F.when(F.col("distance") == 0, "house").otherwise("house_approx")
    return _candidate(named, "house", F.concat_ws(", ", "city", "name", "house"), "score", F.lit(0), city=F.col("city"), detail=detail)


def listed_house_stage(q: DataFrame, seeds: Seeds) -> DataFrame:
    """Houses of the seed table whose street is most similar to a name of the text (78 at least)."""
    rows = seeds.houses.select(F.monotonically_increasing_id().alias("row"), "city", "street", "house", "lat", "lon", text.normalize_street(F.col("street")).alias("street_norm"), F.explode(text.house_keys(F.col("house"))).alias("key"))
    asked = q.where("number is not null and markers < 2").select("request_id", F.explode(text.house_keys(F.col("number"))).alias("key"), F.posexplode("streets").alias("pos", "query"))
    met = asked.join(rows, "key").withColumn("similarity", partial_ratio("query", "street_norm")).where("similarity >= 78")
    best = met.groupBy("request_id").agg(F.max_by(F.struct("city", "street", "house", "lat", "lon", "similarity"), F.struct("similarity", -F.col("pos"), -F.col("row"))).alias("b")).select("request_id", "b.*")
    return _candidate(best, "house", F.concat_ws(", ", "city", "street", "house"), house_score(F.col("similarity"), F.lit(0)), F.lit(0), city=F.col("city"), detail=F.lit("listed"))


def _pairs(q: DataFrame) -> DataFrame:
    pair = F.posexplode("pairs").alias("pos", "p")
    return q.select("request_id", "hint_id", pair).select("request_id", "hint_id", "pos", F.least("p.a", "p.b").alias("a"), F.greatest("p.a", "p.b").alias("b"))


def _crossing_name() -> Column:
    return F.concat(F.col("city"), F.lit(": "), F.col("name_a"), F.lit(" ∩ "), F.col("name_b"))


def _ordered(df: DataFrame, *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy("request_id").orderBy(*order))


def _street_pairs(q: DataFrame, gazetteer: Gazetteer) -> DataFrame:
    """Pairs of streets of one city that bear a request's pair of names; each step is an equi-join on names."""
    side = lambda s: gazetteer.streets.select("city_id", F.col("name_norm").alias(s), F.col("street_id").alias(f"id_{s}"), F.col("name").alias(f"name_{s}"))
    met = _pairs(q).join(side("a"), "a").join(side("b"), ["city_id", "b"])
    return met.where(F.col("hint_id").isNull() | (F.col("hint_id") == F.col("city_id")))


def _placed(gazetteer: Gazetteer, major: DataFrame) -> DataFrame:
    """city_id, city and major (1 or 0)."""
    return gazetteer.cities.join(major.withColumn("known", F.lit(1)), "name_norm", "left").select("city_id", F.col("name").alias("city"), F.coalesce("known", F.lit(0)).alias("major"))


def intersection_stage(q: DataFrame, gazetteer: Gazetteer, major: DataFrame) -> DataFrame:
    """Known crossings of a pair of names."""
    met = _street_pairs(q, gazetteer)
    known = gazetteer.intersections.select("city_id", F.least("street_a_id", "street_b_id").alias("lo"), F.greatest("street_a_id", "street_b_id").alias("hi"), "lat", "lon")
    met = met.withColumns({"lo": F.least("id_a", "id_b"), "hi": F.greatest("id_a", "id_b")}).join(known, ["city_id", "lo", "hi"]).join(_placed(gazetteer, major), "city_id")
    return _candidate(met, "intersection", _crossing_name(), F.lit(clues.SCORES["intersection"]), _ordered(met, F.desc("major"), F.col("pos"), F.col("lo"), F.col("hi")), city=F.col("city"))


def listed_intersection_stage(q: DataFrame, seeds: Seeds) -> DataFrame:
    """Crossings of the seed table: of the two names in it that are most similar to names of the text (75 at least)."""
    a, b = text.normalize_street(F.col("street_a")), text.normalize_street(F.col("street_b"))
    rows = seeds.intersections.select("city", F.col("street_a").alias("name_a"), F.col("street_b").alias("name_b"), "lat", "lon", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    known = rows.select(F.col("a").alias("street")).union(rows.select("b")).where("street <> ''").distinct()
    asked = q.select("request_id", F.posexplode(F.slice("pairing", 1, 8)).alias("pos", "query"))
    # The most similar name is the query's own, whoever asks.
    met = names_similar(asked, "query", build_index(known, "street"), 75).withColumnRenamed("text", "street")
    best = asked.join(stored(met.groupBy("query").agg(F.max("similarity").alias("similarity"), F.min_by("street", F.struct(-F.col("similarity"), F.col("street"))).alias("street"))), "query")
    once = best.groupBy("request_id", "street").agg(F.min(F.struct((-F.col("similarity")).alias("far"), "pos")).alias("at"))
    two = once.withColumn("n", _ordered(once, F.col("at"))).where("n <= 2").groupBy("request_id").agg(F.min("street").alias("a"), F.max("street").alias("b")).where("a < b")
    found = two.join(rows, ["a", "b"])
    return _candidate(found, "intersection", _crossing_name(), F.lit(clues.SCORES["listed_intersection"]), _ordered(found, F.col("city"), F.col("name_a"), F.col("name_b")), city=F.col("city"), detail=F.lit("listed"))


def street_centres(gazetteer: Gazetteer) -> DataFrame:
    """Mean position of each street's houses, once for all requests."""
    return centroids(gazetteer.houses, ["city_id", "street_id"]).drop("score")


def pair_stage(q: DataFrame, gazetteer: Gazetteer, major: DataFrame, centres: DataFrame) -> DataFrame:
    """Between the centres of two streets of one city; the closest pairs come first."""
    side = lambda s: centres.select("city_id", F.col("street_id").alias(f"id_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("lat", "lon", "houses")))
    met = _street_pairs(q, gazetteer).join(side("a"), ["city_id", "id_a"]).join(side("b"), ["city_id", "id_b"])
    met = met.join(_placed(gazetteer, major), "city_id")
    fewer = F.least("houses_a", "houses_b")
    met = met.withColumns({
        "sep": F.round(haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")), 3), "fewer": fewer, "pair_score": pair_score(fewer),
        "lat": (F.col("lat_a") + F.col("lat_b")) / 2, "lon": (F.col("lon_a") + F.col("lon_b")) / 2,
    })
    order = (F.desc("major"), F.col("sep"), F.desc("pair_score"), F.desc("fewer"), F.desc(F.col("houses_a") + F.col("houses_b")), F.col("id_a"), F.col("id_b"))
    return _candidate(met, "intersection_approx", _crossing_name(), "pair_score", _ordered(met, *order), city=F.col("city"))


def street_stage(q: DataFrame, gazetteer: Gazetteer, major: DataFrame, centres: DataFrame) -> DataFrame:
    """The one street a text names: its centre; for ordinals without an exact name the nearest ordinals that hold that base."""
    asked = q.where(F.size("streets") == 1).select("request_id", "hint_id", F.get("streets", 0).alias("query"))
    fits = F.col("hint_id").isNull() | (F.col("hint_id") == F.col("city_id"))
    places = gazetteer.streets.join(centres, ["city_id", "street_id"]).join(_placed(gazetteer, major), "city_id")
    exact = asked.join(places, F.col("query") == F.col("name_norm")).where(fits).withColumns({"points": street_score(F.col("houses")), "kind": F.lit("street_centroid")})
    left = asked.join(exact.select("request_id"), "request_id", "left_anti").withColumn("o", text.ordinal_parts(F.col("query"))).where("o is not null").select("request_id", "hint_id", "query", F.col("o.number").alias("wanted"), F.col("o.base").alias("base"))
    ordinals = places.withColumn("o", text.ordinal_parts(F.col("name_norm"))).where("o is not null").select("*", F.col("o.number").alias("number"), F.col("o.base").alias("base")).drop("o")
    left = stored(left.where(F.length("base") >= 2))
    held = names_holding(left, "base", gazetteer.name_index()).withColumnRenamed("text", "name_norm")
    near = left.join(held, "base").join(ordinals.drop("base"), "name_norm").where(fits).withColumn("distance", F.abs(F.col("number") - F.col("wanted")))
    near = near.withColumn("n", _ordered(near, F.col("distance"), F.desc("major"), F.col("street_id"))).where("n <= 8")
    near = near.withColumns({"points": ordinal_score(F.col("distance"), F.col("houses")), "kind": F.lit("street_approx")})
    found = exact.unionByName(near.select(*exact.columns))
    order = (F.desc(F.col("points") + 0.1 * F.col("major")), F.desc("houses"), F.col("street_id"))
    made = _candidate(found, F.col("kind"), F.concat_ws(", ", "city", "name"), "points", _ordered(found, *order), city=F.col("city"))
    return made.where("seq <= 12")


def city_scores(q: DataFrame, seeds: Seeds) -> DataFrame:
    """request_id, name, lat, lon, score: hits of each city's name and aliases in the text, at most five a request.

    Requests meet the seed table in equi-joins on beginnings of words and on runs of characters.
    """
    table = seeds.city_keys().withColumn("parts", text.tokens(F.col("key")))
    begins = lambda t: F.substring(t, 1, 2)
    words = q.select("request_id", "norm", "tokens", F.explode(F.array_distinct(F.transform("tokens", begins))).alias("start"))
    # A key can only score where one of its words begins like a token of the text, or stands inside the text.
    near = words.join(table.withColumn("start", F.explode(F.array_distinct(F.transform("parts", begins)))), "start")
    inside = keys_inside(q, seeds).join(q.select("request_id", "norm", "tokens"), "request_id").join(table, "key")
    columns = ["request_id", "norm", "tokens", "key", "name", "lat", "lon", "own", "parts"]
    met = near.select(columns).union(inside.select(columns)).dropDuplicates(["request_id", "key", "name"])
    long = (F.length("key") >= 4) & (F.length("norm") >= 4)
    met = met.withColumn("whole", F.when(long, partial_ratio("key", "norm")).otherwise(0.0))
    token = met.select("request_id", "key", "name", F.explode(F.filter("tokens", lambda t: F.length(t) >= 4)).alias("token")).where(F.length("key") >= 4).withColumn("p", partial_ratio("key", "token"))
    close = (F.col("p") >= 88) & (F.startswith("key", "token") | F.startswith("token", "key") | (F.abs(F.length("key") - F.length("token")) <= 1) | (F.col("p") >= 94))
    token = token.where(close).groupBy("request_id", "key", "name").agg(F.max("p").alias("best"))
    met = met.join(token, ["request_id", "key", "name"], "left")
    w = F.col("whole")
    points = (
        F.when(text.in_text(F.col("key"), F.col("norm"), F.col("tokens")), 5.0).otherwise(0.0) + 1.5 * F.size(F.array_intersect("tokens", "parts"))
        + F.when(w >= 90, (w - 89) * 0.08).when(w >= 80, (w - 79) * 0.03).otherwise(0.0) + F.coalesce((F.col("best") - 87) * 0.05, F.lit(0.0))
        + F.when(F.col("own") & F.array_contains("tokens", F.col("key")), 2.0).otherwise(0.0)
    )
    scored = met.withColumn("points", points).groupBy("request_id", "name").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.round(F.sum("points"), 6).alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "name"))
    return scored.withColumn("rank", rank).where("rank <= 5")


def city_stage(q: DataFrame, seeds: Seeds) -> DataFrame:
    found = city_scores(q, seeds)
    return _candidate(found, "city", F.col("name"), "score", F.col("rank"), city=F.col("name"))


def text_clues(texts: DataFrame, seeds: Seeds) -> DataFrame:
    """Clues of (request_id, source, text): region plates (loose ones only where no plate has a known region), highways, codes.

    One clue a code: the place of its first mention.
    """
    def found(codes: Column, table: DataFrame, kind: str, score: float, base: int) -> DataFrame:
        rows = texts.select("request_id", "source", F.posexplode(codes).alias("pos", "code")).groupBy("request_id", "source", "code").agg(F.min("pos").alias("pos"))
        met = rows.join(table.select("code", "name", "lat", "lon"), "code")
        return met.select("request_id", "source", F.lit(kind).alias("kind"), "name", "code", "lat", "lon", F.lit(score).alias("score"), (F.lit(base) + F.col("pos")).cast("long").alias("pos"))

    c, s = F.col("text"), clues.SCORES
    strict = found(clues.plate_codes(c), seeds.plates, "plate_region", s["plate"], 0)
    loose = found(clues.loose_plate_codes(c), seeds.plates, "plate_region", s["loose_plate"], 0).join(strict.select("request_id", "source").distinct(), ["request_id", "source"], "left_anti")
    roads = found(clues.highway_codes(c), seeds.highways, "highway", s["highway"], 1 << 20)
    phones = found(clues.phone_codes(c), seeds.phones, "phone_code", s["phone"], 1 << 21)
    return reduce(DataFrame.unionByName, (strict, loose, roads, phones))


def fragments_of(requests: DataFrame, seeds: Seeds) -> DataFrame:
    """One row a fragment with its position, texts and effective type."""
    f = requests.select("request_id", F.posexplode("fragments").alias("pos", "f")).select("request_id", "pos", "f.*")
    f = f.withColumns({"note": F.coalesce("note", F.lit("")), "ocr_text": F.coalesce("ocr_text", F.lit(""))})
    blob = clues.fragment_blob(F.col("note"), F.col("ocr_text"))

    def known(codes: Column, table: DataFrame, name: str) -> DataFrame:
        met = f.select("request_id", "pos", F.explode(F.array_distinct(codes)).alias("code")).join(table.select("code").distinct(), "code", "left_semi")
        return met.select("request_id", "pos", F.lit(True).alias(name)).distinct()

    f = f.join(known(F.concat(clues.plate_codes(blob), clues.loose_plate_codes(blob)), seeds.plates, "has_plate"), ["request_id", "pos"], "left")
    f = f.join(known(clues.highway_codes(blob), seeds.highways, "has_highway"), ["request_id", "pos"], "left")
    has = [F.coalesce(c, F.lit(False)) for c in ("has_plate", "has_highway")]
    return f.withColumn("type", clues.effective_type(F.col("clue_type"), F.col("note"), F.col("ocr_text"), F.col("rect.w"), F.col("rect.h"), *has)).drop("has_plate", "has_highway")


def clue_stage(requests: DataFrame, seeds: Seeds, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, analysis).  ``vectors`` (request_id, fragment_id, vector) are embedded images of fragments."""
    f = stored(fragments_of(requests, seeds))
    read = f.where(clues.allows_text(F.col("type"))).select("request_id", F.col("pos").alias("source"), text.joined_text(F.array("note", "ocr_text")).alias("text"))
    manual = requests.select("request_id", F.lit(-1).alias("source"), "manual_text").withColumnRenamed("manual_text", "text")
    found = stored(text_clues(read.union(manual), seeds))
    of_fragments = found.where("source >= 0").join(f.select("request_id", F.col("pos").alias("source"), "id"), ["request_id", "source"])
    best = of_fragments.groupBy("request_id", "source").agg(F.max_by(F.struct("kind", "name", "score"), F.struct("score", -F.col("pos"))).alias("best"))
    flagged = running_flag(f.join(best, (f.request_id == best.request_id) & (f.pos == best.source), "left").select(f["*"], "best"), "request_id", ["pos"], F.col("best.kind") == "plate_region")
    typed = F.max(F.col("type").isin("street", "text", "highway") & (F.trim("ocr_text") != "")).over(Window.partitionBy("request_id"))
    flagged = flagged.withColumn("has_text", typed)
    analysis = flagged.select("request_id", "id", F.col("type").alias("clue_type"), "pos", F.col("best.kind").alias("detected_kind"), F.col("best.name").alias("detected_label"), F.coalesce("best.score", F.lit(0.0)).alias("score"))
    seq = (F.col("source") + 1).cast("long") * (1 << 24) + F.col("pos")
    parts = [_candidate(of_fragments, F.col("kind"), F.concat(F.col("name"), F.lit(" ("), F.col("code"), F.lit(")")), "score", seq, detail=F.col("code"), fragment_id=F.col("id"))]
    top = slice_then_merge(found.where("source < 0").withColumn("seq", F.col("pos")), "request_id", ["kind", "code"])
    parts.append(_candidate(top, F.col("kind"), F.concat(F.col("name"), F.lit(" ("), F.col("code"), F.lit(")")), "score", F.lit(1 << 60) + F.col("pos"), detail=F.col("code")))
    if vectors is not None and seeds.emblems is not None:
        open_ = clues.allows_emblems(F.col("type")) & ~((F.col("has_text") | F.col("seen")) & (F.col("type") == "auto")) & ~F.col("any")
        asked = flagged.where(open_).select("request_id", F.col("id").alias("fragment_id"), "type", "pos").join(vectors, ["request_id", "fragment_id"])
        asked = asked.withColumn("query_id", F.xxhash64("request_id", "fragment_id"))
        matched = emblem_matches(asked.select("query_id", "vector"), seeds.emblems, 3).join(asked.drop("vector"), "query_id").where(F.col("score") >= clues.emblem_floor(F.col("type")))
        parts.append(_candidate(matched, F.col("kind"), F.col("name"), "score", (F.col("pos") + 1).cast("long") * (1 << 24) + (1 << 23) + F.col("rank"), fragment_id=F.col("fragment_id")))
    return reduce(DataFrame.unionByName, parts), analysis


def locate(requests: DataFrame, gazetteer: Gazetteer, seeds: Seeds, vectors: DataFrame | None = None) -> DataFrame:
    return located(requests, gazetteer, seeds, vectors)[0]


def located(requests: DataFrame, gazetteer: Gazetteer, seeds: Seeds, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Ranked candidates of every request (CANDIDATE, stage, rank): the first stage that answers, eight rows at most.

    Requests of mode ``address`` skip the clue stage.  Beside them the analysis of each fragment (request_id, id, its
    type, detected kind, label and score).
    """
    requests = stored(spread(requests))  # all stages begin with them, and reading a text is costly
    # All stages but that of clues go by the text alone, so of requests with the same text one stands for all.
    texts = stored(request_texts(requests))
    asked = stored(texts.groupBy("text").agg(F.min("request_id").alias("request_id"), F.min("mode").alias("mode")))
    same = stored(texts.join(asked.select("text", F.col("request_id").alias("first_id")), "text").select("request_id", "first_id").distinct())
    q = queried(spread(asked.select("request_id", "mode", "text")), seeds, gazetteer)
    major, empty = seeds.major(), q.sparkSession.createDataFrame([], CANDIDATE)
    centres = stored(street_centres(gazetteer))
    of_clues, analysis = clue_stage(requests.where(F.coalesce("mode", F.lit("geoguess")) != "address"), seeds, vectors)
    numbered = "number is not null and markers < 2"
    stages = [
        lambda q: of_clues,
        lambda q: house_stage(q, gazetteer, stored(street_matches(q.where(numbered), gazetteer))),
        lambda q: listed_house_stage(q, seeds) if seeds.houses is not None else empty,
        lambda q: intersection_stage(q, gazetteer, major),
        lambda q: listed_intersection_stage(q, seeds) if seeds.intersections is not None else empty,
        lambda q: pair_stage(q, gazetteer, major, centres),
        lambda q: street_stage(q, gazetteer, major, centres),
        lambda q: city_stage(q, seeds),
    ]
    answered, open_ = [], same
    for n, stage in enumerate(stages):
        # A stage sees the requests that no stage before has answered.
        found = stage(q.join(open_.select(F.col("first_id").alias("request_id")).distinct(), "request_id", "left_semi"))
        if n:
            found = found.withColumnRenamed("request_id", "first_id").join(open_, "first_id").drop("first_id")
        answered.append(stored(empty.unionByName(found).withColumn("stage", F.lit(n).cast("long"))))
        open_ = stored(same.join(reduce(DataFrame.union, [a.select("request_id") for a in answered]).distinct(), "request_id", "left_anti"))
    chosen = reduce(DataFrame.union, answered)
    # Clues rank by score; the stages of the gazetteer come in their own order already.
    ranked = merge_top(chosen.withColumn("order", F.when(F.col("stage") == 0, F.col("score")).otherwise(-F.col("seq"))).withColumn("points", F.col("score")).withColumn("score", F.col("order")).drop("order"), "request_id", ["kind", "name"]).withColumn("score", F.col("points")).drop("points")
    return ranked, analysis


ANALYSIS = "array<struct<pos: int, id: string, clue_type: string, detected_kind: string, detected_label: string, score: double>>"


def responses(requests: DataFrame, found: DataFrame, analysis: DataFrame | None = None) -> DataFrame:
    """One row a request: script, tokens (80 at most), candidates by rank, the best one, the analysis of its fragments, all as a JSON document too."""
    texts = request_texts(requests)
    fields = ["name", "lat", "lon", "score", "kind", "fragment_id", "detail"]
    top = found.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("rank", *fields))).alias("topk"))
    shaped = texts.join(top, "request_id", "left").select("request_id", text.script(F.col("text")).alias("script"), F.slice(text.tokens(F.col("text")), 1, 80).alias("tokens"), F.coalesce("topk", F.array().cast(top.schema["topk"].dataType)).alias("topk"))
    shaped = shaped.withColumn("best", F.get("topk", 0))
    if analysis is None:
        shaped = shaped.withColumn("fragments", F.array().cast(ANALYSIS))
    else:
        rows = F.sort_array(F.collect_list(F.struct("pos", "id", "clue_type", "detected_kind", "detected_label", "score"))).cast(ANALYSIS)
        shaped = shaped.join(analysis.groupBy("request_id").agg(rows.alias("fragments")), "request_id", "left").withColumn("fragments", F.coalesce("fragments", F.array().cast(ANALYSIS)))
    return shaped.withColumn("json", F.to_json(F.struct(F.lit("wayfold.response.v1").alias("schema"), "script", "tokens", "topk", "best", "fragments")))


def with_analysis(fragments: DataFrame, analysis: DataFrame) -> DataFrame:
    """Fragments (request_id, id, ...) with what was found out about each, as the asking side shows it."""
    return fragments.join(analysis.select("request_id", "id", F.col("clue_type").alias("effective_type"), "detected_kind", "detected_label", F.col("score").alias("clue_score")), ["request_id", "id"], "left")


def display(found: DataFrame) -> DataFrame:
    """Candidates with the city and the rest of the name apart, as shown to people."""
    name = F.col("name")
    city = F.when(F.contains(name, F.lit(":")), F.substring_index(name, ":", 1)).otherwise(F.substring_index(name, ",", 1))
    return found.withColumns({"shown_city": F.trim(city), "shown_rest": F.trim(F.substring(name, F.length(city) + 2, F.length(name)))})
