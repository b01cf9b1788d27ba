"""Registered queries of the resolver, its texts, clues and images, over addresses and readings made of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import clues, geo, text
from wayfold.functions.streets import street_candidates
from wayfold.operators import ocr, perception
from wayfold.operators.gazetteer import Gazetteer, build_gazetteer, build_intersections, import_counts
from wayfold.operators.vectors import emblem_matches
from wayfold.plans import locate as plan
from wayfold.plans.health import health
from wayfold.sources import seeds
from wayfold.tables import numbered, spread, stored

LETTERS = "абвгдежзиклмнопр"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _city(key: Column) -> Column:
    """A city's name: ten letters that look like no other city's."""
    return F.translate(F.substring(F.md5(key.cast("string")), 1, 10), "0123456789abcdef", LETTERS)


CITY = f"translate(substr(md5(n_nationkey::VARCHAR), 1, 10), '0123456789abcdef', '{LETTERS}')"


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address rows: a nation as city, a part's name as street, line number and quantity as house."""
    nations = _t(spark, sf_dir, "supplier").select("s_suppkey", _city(F.col("s_nationkey")).alias("city"))
    rows = _t(spark, sf_dir, "lineitem").join(nations, F.col("l_suppkey") == F.col("s_suppkey")).join(_t(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    house = F.concat_ws("/", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"))
    return rows.select("city", F.concat(F.lit("ул. "), "p_name").alias("street"), house.alias("house"), (F.col("l_discount") * 100).alias("lat"), (F.col("l_tax") * 100).alias("lon"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"))


ADDRESSES = f"""a AS (SELECT {CITY} AS city, p_name AS street, l_linenumber || '/' || l_quantity::INT AS house, l_linenumber::BIGINT AS number,
    l_discount * 100 AS lat, l_tax * 100 AS lon, l_orderkey, l_linenumber, l_partkey, l_suppkey
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey),
h AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY city, street, house ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, lat, lon) = 1),
c AS (SELECT city, street, avg(lat) AS lat, avg(lon) AS lon, count(*) AS n FROM h GROUP BY ALL)"""


def _roads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways): suppliers as vertices, parts as roads through the suppliers of their lines."""
    supplier, part = _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "part")
    nodes = supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 200).alias("lat"), (F.col("s_suppkey") % 90).cast("double").alias("lon"))
    refs = _t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.collect_set("l_suppkey").alias("refs"))
    tags = F.create_map(F.lit("highway"), F.when(F.col("p_size") < 5, "footway").otherwise("residential"), F.lit("name"), F.concat(F.lit("ул. "), "p_name"))
    return nodes, part.join(refs, F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_partkey").alias("id"), "refs", tags.alias("tags"))


CROSSINGS = """v AS (SELECT DISTINCT p_name AS street, l_suppkey AS node, s_acctbal / 200 AS lat, (s_suppkey % 90)::DOUBLE AS lon
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size >= 5 AND s_acctbal / 200 BETWEEN -90 AND 90),
f AS (SELECT city, min((l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS first FROM a GROUP BY city),
w AS (SELECT h.city, count(*) AS n, any_value(f.first) AS first FROM h JOIN f USING (city) GROUP BY ALL),
p AS (SELECT x.street AS sa, y.street AS sb, x.node, x.lat, x.lon FROM v x JOIN v y ON x.node = y.node AND x.street < y.street),
o AS (SELECT x.street AS sa, y.street AS sb, x.city FROM c x JOIN c y ON x.city = y.city AND x.street < y.street JOIN w ON w.city = x.city
    QUALIFY row_number() OVER (PARTITION BY x.street, y.street ORDER BY w.n DESC, w.first) = 1),
i AS (SELECT o.city, sa, sb, lat, lon FROM p JOIN o USING (sa, sb) QUALIFY row_number() OVER (PARTITION BY sa, sb ORDER BY node) = 1)"""


def _seeds(spark: SparkSession, sf_dir: str) -> plan.Seeds:
    nation = _t(spark, sf_dir, "nation")
    lat, lon = F.col("n_nationkey").cast("double").alias("lat"), F.col("n_regionkey").cast("double").alias("lon")
    cities = nation.select(_city(F.col("n_nationkey")).alias("name"), lat, lon, F.array(_city(F.concat(F.col("n_nationkey").cast("string"), F.lit("x")))).alias("aliases"))
    plates = nation.select(F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0").alias("code"), F.col("n_name").alias("name"), lat, lon)
    highways = nation.select(F.concat(F.lit("M-"), F.col("n_nationkey").cast("string")).alias("code"), F.concat(F.lit("road "), "n_name").alias("name"), lat, lon, F.lit("").alias("hint"))
    return plan.Seeds(cities, plates, highways, seeds.phone_cities(spark))


def _gazetteer(spark: SparkSession, sf_dir: str, crossings: bool = True) -> Gazetteer:
    g = build_gazetteer(_addresses(spark, sf_dir))
    if crossings:
        nodes, ways = _roads(spark, sf_dir)
        g.intersections = build_intersections(ways, nodes, g, spark.createDataFrame([], "name_norm string"))
    return g


def gazetteer_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings of named roads, each in the city that has both streets and the most houses."""
    return named_crossings(_gazetteer(spark, sf_dir))


def named_crossings(g: Gazetteer) -> DataFrame:
    """Crossings with the names of their cities and streets."""
    name = lambda s: g.streets.select(F.col("street_id").alias(f"street_{s}_id"), F.col("name_norm").alias(s))
    named = g.intersections.join(name("a"), "street_a_id").join(name("b"), "street_b_id").join(g.cities.select("city_id", F.col("name").alias("city")), "city_id")
    return named.select("city", "a", "b", F.round("lat", 6).alias("lat"), "lon")


CROSSING_SQL = f"WITH {ADDRESSES}, {CROSSINGS} SELECT city, sa AS a, sb AS b, round(lat, 6) AS lat, lon FROM i"


def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct cities and streets, and rows, of an import."""
    return import_counts(_addresses(spark, sf_dir))


IMPORT_SQL = f"WITH {ADDRESSES} SELECT count(DISTINCT city) AS cities, count(DISTINCT (city, street)) AS streets, count(*) AS houses FROM a"


def table_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of gazetteer and seed tables, and which are empty."""
    return health(_gazetteer(spark, sf_dir), _seeds(spark, sf_dir))


HEALTH_SQL = f"""WITH {ADDRESSES}, {CROSSINGS}, n AS (SELECT 'cities' AS name, count(DISTINCT city) AS n FROM a UNION ALL SELECT 'streets', count(*) FROM c UNION ALL SELECT 'houses', count(*) FROM h
    UNION ALL SELECT 'intersections', count(*) FROM i UNION ALL SELECT unnest(['seed_cities', 'seed_plates', 'seed_highways']), count(*) FROM nation UNION ALL SELECT 'seed_phones', {len(seeds.PHONE_CODES)})
SELECT name, n, n = 0 AS empty FROM n"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request of each customer: a house, two streets, one street, a city or an alias, by the name's last digits."""
    names = stored(numbered(_t(spark, sf_dir, "part").select("p_name").distinct(), "n", "p_name").select((F.col("n") - 1).alias("k"), "p_name"))
    different = names.count()
    name = lambda s: names.select(F.col("k").alias(f"k_{s}"), F.col("p_name").alias(s))
    key = F.col("c_custkey")
    supplier = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    many = supplier.agg(F.count("*").alias("many"))
    c = _t(spark, sf_dir, "customer").withColumns({"k_a": key % different, "k_b": (key * 7 + 3) % different}).join(name("a"), "k_a").join(name("b"), "k_b")
    c = c.withColumn("s_suppkey", key % F.lit(many.first()[0])).join(supplier, "s_suppkey")  # cities that have addresses
    city = _city(F.col("s_nationkey"))
    number = F.concat((key % 9 + 1).cast("string"), F.lit("/"), (key % 50 + 1).cast("string"))
    alias = _city(F.concat(F.col("s_nationkey").cast("string"), F.lit("x")))
    said = (
        F.when(key % 5 == 0, F.concat(city, F.lit(", ул. "), "a", F.lit(" д. "), number)).when(key % 5 == 1, F.concat(city, F.lit(" ул. "), "a", F.lit(" ул. "), "b"))
        .when(key % 5 == 2, F.concat(F.lit("УЛ. "), "a", F.lit(" "), city)).when(key % 5 == 3, F.initcap(city)).otherwise(alias)
    )
    return c.select(key.alias("request_id"), said.alias("manual_text"), F.lit("geoguess").alias("mode"), F.lit(None).cast(seeds.FRAGMENTS).alias("fragments"))


ASKED = f"""m AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT p_name FROM part)),
q AS (SELECT c_custkey AS id, {CITY} AS city, x.p_name AS a, y.p_name AS b, c_custkey % 9 + 1 AS number, (c_custkey % 9 + 1) || '/' || (c_custkey % 50 + 1) AS house, c_custkey % 5 AS what,
    n_nationkey::DOUBLE AS nlat, n_regionkey::DOUBLE AS nlon
    FROM customer JOIN supplier ON s_suppkey = c_custkey % (SELECT count(*) FROM supplier) JOIN nation ON s_nationkey = n_nationkey JOIN m x ON x.k = c_custkey % x.n JOIN m y ON y.k = (c_custkey * 7 + 3) % y.n)"""


def locate_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked answers of the whole resolver: houses, crossings, points between streets, streets and cities."""
    requests = _asked(spark, sf_dir)
    found = plan.locate(requests, _gazetteer(spark, sf_dir), _seeds(spark, sf_dir))
    return found.select("request_id", "rank", "stage", "kind", "name", "city", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("score", 4).alias("score"))


LOCATE_SQL = f"""WITH {ADDRESSES}, {CROSSINGS}, {ASKED},
house AS (SELECT id, 1 AS stage, 'house' AS kind, q.city || ', ул. ' || h.street || ', ' || h.house AS name, q.city, lat, lon,
        1.0 - CASE WHEN h.house = q.house OR h.number = q.number THEN 0.0 WHEN abs(h.number - q.number) <= 2 THEN 0.15 WHEN abs(h.number - q.number) <= 10 THEN 0.25 ELSE 0.35 END AS score, 1 AS rank
    FROM q JOIN h ON h.city = q.city AND h.street = q.a WHERE what = 0
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY h.house <> q.house, abs(h.number - q.number), h.house) = 1),
pair AS (SELECT id, 5 AS stage, 'intersection_approx' AS kind, x.city, least(q.a, q.b) AS sa, greatest(q.a, q.b) AS sb, (x.lat + y.lat) / 2 AS lat, (x.lon + y.lon) / 2 AS lon,
        round(greatest(0.45, 0.82 - 1.0 / (4.0 + least(x.n, y.n))) + 1e-12, 4) AS score
    FROM q JOIN c x ON x.city = q.city AND x.street = q.a JOIN c y ON y.city = q.city AND y.street = q.b WHERE what = 1 AND q.a <> q.b),
crossed AS (SELECT id, coalesce(CASE WHEN i.city IS NOT NULL THEN 3 END, stage) AS stage, CASE WHEN i.city IS NULL THEN kind ELSE 'intersection' END AS kind,
        pair.city || ': ул. ' || sa || ' ∩ ул. ' || sb AS name, pair.city, coalesce(i.lat, pair.lat) AS lat, CASE WHEN i.city IS NULL THEN pair.lon ELSE i.lon END AS lon,
        CASE WHEN i.city IS NULL THEN score ELSE 0.92 END AS score, 1 AS rank
    FROM pair LEFT JOIN i USING (city, sa, sb)),
street AS (SELECT id, 6 AS stage, 'street_centroid' AS kind, c.city || ', ул. ' || c.street AS name, c.city, lat, lon, round(greatest(0.38, 0.68 - 1.0 / (3.0 + n)) + 1e-12, 4) AS score, 1 AS rank
    FROM q JOIN c ON c.city = q.city AND c.street = q.a WHERE what = 2 OR (what = 1 AND q.a = q.b)),
city AS (SELECT id, 7 AS stage, 'city' AS kind, city AS name, city, nlat AS lat, nlon AS lon, CASE WHEN what = 4 THEN 8.03 ELSE 10.03 END AS score, 1 AS rank
    FROM q WHERE what >= 3 OR id NOT IN (SELECT id FROM house UNION SELECT id FROM crossed UNION SELECT id FROM street)),
every AS (SELECT * FROM house UNION ALL SELECT * FROM crossed UNION ALL SELECT * FROM street UNION ALL SELECT * FROM city)
SELECT id AS request_id, rank::BIGINT AS rank, stage::BIGINT AS stage, kind, name, city, round(lat, 6) AS lat, round(lon, 6) AS lon, round(score::DOUBLE, 4) AS score FROM every"""


def _listed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Curated houses and crossings: streets that no extract has, a house and a crossing for each name of a part."""
    names = stored(numbered(_t(spark, sf_dir, "part").select("p_name").distinct(), "n", "p_name"))
    street = lambda c: F.concat(F.lit("ул. q"), c, F.lit(" north"))  # the letter: no name is a part of another one
    city = _city(F.col("n") % 25)
    houses = names.select(city.alias("city"), street(F.col("p_name")).alias("street"), F.col("n").cast("string").alias("house"), (F.col("n") / 4).alias("lat"), (F.col("n") / 8).alias("lon"))
    after = names.select((F.col("n") - 1).alias("n"), F.col("p_name").alias("next"))
    crossings = names.join(after, "n").select(city.alias("city"), street(F.col("p_name")).alias("street_a"), street(F.col("next")).alias("street_b"), (F.col("n") / 2).alias("lat"), (F.col("n") / 16).alias("lon"))
    return houses, crossings


def locate_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolver on parts of street names with a house number, on listed houses and on listed crossings, by customers."""
    known, g = _seeds(spark, sf_dir), _gazetteer(spark, sf_dir, crossings=False)
    known.houses, known.intersections = _listed(spark, sf_dir)
    names = stored(numbered(_t(spark, sf_dir, "part").select("p_name").distinct(), "n", "p_name"))
    different, key = names.count(), F.col("c_custkey")
    a, b = (names.select(F.col("n").alias(f"n_{s}"), F.col("p_name").alias(s)) for s in "ab")
    supplier = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    c = _t(spark, sf_dir, "customer").withColumn("n_a", key % (different - 1) + 1).withColumn("n_b", F.col("n_a") + 1).join(a, "n_a").join(b, "n_b")
    c = c.withColumn("s_suppkey", key % F.lit(supplier.count())).join(supplier, "s_suppkey")
    number = F.concat((key % 9 + 1).cast("string"), F.lit("/"), (key % 50 + 1).cast("string"))
    said = (
        F.when(key % 3 == 0, F.concat(_city(F.col("s_nationkey")), F.lit(", ул. "), F.substring_index("a", " ", -1), F.lit(" д. "), number))
        .when(key % 3 == 1, F.concat(F.lit("ул. q"), "a", F.lit(" north д. "), F.col("n_a").cast("string"))).otherwise(F.concat(F.lit("ул. q"), "a", F.lit(" north ул. q"), "b", F.lit(" north")))
    )
    asked = c.select(key.alias("request_id"), said.alias("manual_text"), F.lit("address").alias("mode"), F.lit(None).cast(seeds.FRAGMENTS).alias("fragments"))
    found = plan.locate(asked, g, known)
    return found.select("request_id", "rank", "stage", "kind", "name", "city", "detail", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("score", 4).alias("score"))


LISTED_CITY = f"translate(substr(md5((n % 25)::VARCHAR), 1, 10), '0123456789abcdef', '{LETTERS}')"
LISTED_SQL = f"""WITH {ADDRESSES}, m AS (SELECT p_name, row_number() OVER (ORDER BY p_name) AS n, count(*) OVER () AS every FROM (SELECT DISTINCT p_name FROM part)),
q AS (SELECT c_custkey AS id, {CITY} AS city, n_nationkey::DOUBLE AS nlat, n_regionkey::DOUBLE AS nlon, c_custkey % 3 AS what, x.p_name AS a, y.p_name AS b, x.n AS n, split_part(x.p_name, ' ', -1) AS word, c_custkey % 9 + 1 AS number, (c_custkey % 9 + 1) || '/' || (c_custkey % 50 + 1) AS house
    FROM customer JOIN supplier ON s_suppkey = c_custkey % (SELECT count(*) FROM supplier) JOIN nation ON s_nationkey = n_nationkey JOIN m x ON x.n = c_custkey % (x.every - 1) + 1 JOIN m y ON y.n = x.n + 1),
st AS (SELECT city, street, min((l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS first FROM a GROUP BY ALL),
near AS (SELECT id, q.city, h.street, st.first, h.house, lat, lon, h.house = q.house OR h.number = q.number AS same, abs(h.number - q.number) AS d
    FROM q JOIN h ON h.city = q.city AND contains(h.street, q.word) JOIN st ON st.city = h.city AND st.street = h.street WHERE what = 0
    QUALIFY row_number() OVER (PARTITION BY id, h.street ORDER BY h.house <> q.house, abs(h.number - q.number), h.house) = 1),
scored AS (SELECT *, 1.0 - CASE WHEN same THEN 0.0 WHEN d <= 2 THEN 0.15 WHEN d <= 10 THEN 0.25 ELSE 0.35 END AS score FROM near),
part_house AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, first) = 1),
every AS (SELECT id, 1 AS stage, 'house' AS kind, city || ', ул. ' || street || ', ' || house AS name, city, CASE WHEN same THEN 'house' ELSE 'house_approx' END AS detail, lat, lon, score FROM part_house
    UNION ALL SELECT id, 7, 'city', city, city, NULL, nlat, nlon, 10.03 FROM q WHERE what = 0 AND id NOT IN (SELECT id FROM part_house)
    UNION ALL SELECT id, 2, 'house', {LISTED_CITY} || ', ул. q' || a || ' north, ' || n, {LISTED_CITY}, 'listed', n / 4, n / 8, 1.0 FROM q WHERE what = 1
    UNION ALL SELECT id, 4, 'intersection', {LISTED_CITY} || ': ул. q' || a || ' north ∩ ул. q' || b || ' north', {LISTED_CITY}, 'listed', n / 2, n / 16, {clues.SCORES["listed_intersection"]} FROM q WHERE what = 2)
SELECT id AS request_id, 1::BIGINT AS rank, stage::BIGINT AS stage, kind, name, city, detail, round(lat, 6) AS lat, round(lon, 6) AS lon, round(score::DOUBLE, 4) AS score FROM every"""


def city_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response documents of requests that name a city alone: script, tokens, the best answer."""
    asked = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.concat(F.lit(" "), _city(F.col("c_nationkey")), F.lit(" ")).alias("manual_text"), F.lit("geoguess").alias("mode"), F.lit(None).cast(seeds.FRAGMENTS).alias("fragments"))
    known = _seeds(spark, sf_dir)
    empty = build_gazetteer(spark.createDataFrame([], "city string, street string, house string, lat double, lon double, seq long"))
    made = plan.responses(asked, *plan.located(asked, empty, known))
    read = F.from_json("json", "schema string, script string, tokens array<string>, topk array<struct<rank: long, name: string>>, best struct<name: string, kind: string, score: double>, fragments array<string>")
    return made.select("request_id", read.alias("r")).select("request_id", "r.schema", "r.script", F.array_join("r.tokens", "|").alias("tokens"), F.size("r.topk").cast("long").alias("n"), F.col("r.best.name").alias("name"), F.col("r.best.kind").alias("kind"), F.round("r.best.score", 4).alias("score"), F.size("r.fragments").cast("long").alias("fragments"))


CITY_SQL = f"""SELECT c_custkey AS request_id, 'wayfold.response.v1' AS schema, 'cyrillic' AS script, {CITY} AS tokens, 1::BIGINT AS n, {CITY} AS name, 'city' AS kind, 10.03::DOUBLE AS score, 0::BIGINT AS fragments
FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def several_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked cities of requests that name two of them, a third by its alias, and a fourth without its last letter."""
    nation = lambda k: (F.col("c_nationkey") + k) % 25
    alias, cut = _city(F.concat(nation(2).cast("string"), F.lit("x"))), F.substring(_city(nation(3)), 1, 9)
    asked = _t(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request_id"), F.concat_ws(" ", _city(nation(1)), cut, alias, _city(nation(0))).alias("manual_text"), F.lit("geoguess").alias("mode"), F.lit(None).cast(seeds.FRAGMENTS).alias("fragments"),
    )
    empty = build_gazetteer(spark.createDataFrame([], "city string, street string, house string, lat double, lon double, seq long"))
    return plan.locate(asked, empty, _seeds(spark, sf_dir)).select("request_id", "rank", "kind", "name", "lat", "lon", F.round("score", 4).alias("score"))


# Points for a name in the text, its token, its similarity to the whole text and to a token, and for the city's own name.
# Of ten letters nine stand in the text before a space: 2 * 9 of 20 agree with the whole, all of the token with the name.
SEVERAL_SQL = f"""WITH asked AS (SELECT c_custkey AS id, (c_nationkey + k) % 25 AS n_nationkey, k FROM customer CROSS JOIN range(0, 4) AS r(k)),
met AS (SELECT id, k, n_nationkey, {CITY} AS name, n_regionkey, CASE k WHEN 3 THEN 100.0 * 2 * 9 / 20 ELSE 100.0 END::DOUBLE AS whole, 100.0::DOUBLE AS token FROM asked JOIN nation USING (n_nationkey)),
scored AS (SELECT *, CASE WHEN k < 3 THEN 5.0 + 1.5 ELSE 0.0 END + CASE WHEN k < 2 THEN 2.0 ELSE 0.0 END + CASE WHEN whole >= 90 THEN (whole - 89) * 0.08 WHEN whole >= 80 THEN (whole - 79) * 0.03 ELSE 0.0 END + (token - 87) * 0.05 AS score FROM met)
SELECT id AS request_id, row_number() OVER (PARTITION BY id ORDER BY round(score, 6) DESC, name)::BIGINT AS rank, 'city' AS kind, name, n_nationkey::DOUBLE AS lat, n_regionkey::DOUBLE AS lon, round(score::DOUBLE, 4) AS score FROM scored"""


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as people write them, in four forms."""
    n = F.col("p_size").cast("string")
    forms = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("  Ул. "), "p_name", F.lit(", "), n, F.lit("а")))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("Проспект "), F.upper("p_name"), F.lit(" дом "), n, F.lit("/3")))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("3-й "), "p_name", F.lit(" переулок\t"), n, F.lit("/7 5")))
        .otherwise(F.concat("p_name", F.lit("  площадь   ёёёлка")))
    )
    return spread(_t(spark, sf_dir, "part")).select("p_partkey", forms.alias("t"))


def address_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms, house numbers, kinds of street, ordinals of written addresses."""
    t = F.col("t")
    rows = _written(spark, sf_dir).withColumns({"import": text.normalize_import(t), "ocr": text.normalize_ocr(t), "street": text.normalize_street(t), "number": text.house_number(t), "marked": text.house_number(t, bare_too=False)})
    o = text.ordinal_parts(F.col("street"))
    return rows.select(
        "p_partkey", "import", "ocr", "street", "number", "marked", text.house_number_int(F.col("number")).alias("number_int"), F.array_join(text.house_keys(F.col("number")), "|").alias("keys"),
        text.normalize_house(t).alias("house"), text.normalize_house(t, compat=False).alias("house_letters"), text.street_kind(t).alias("kind"), text.street_marker_count(t).cast("long").alias("markers"), o["number"].cast("long").alias("nth"), o["base"].alias("base"),
    )


FORMS = """f AS (SELECT p_partkey, p_partkey % 4 AS k, p_size::VARCHAR AS n, p_name AS s FROM part)"""
FORMS_SQL = f"""WITH {FORMS}
SELECT p_partkey,
    CASE k WHEN 0 THEN 'ул. ' || s || ', ' || n || 'а' WHEN 1 THEN 'проспект ' || s || ' дом ' || n || '/3' WHEN 2 THEN '3-й ' || s || ' переулок ' || n || '/7 5' ELSE s || ' площадь еелка' END AS import,
    CASE k WHEN 0 THEN 'ул. ' || s || ' ' || n || ' а' WHEN 1 THEN 'проспект ' || s || ' дом ' || n || '/3' WHEN 2 THEN '3-й ' || s || ' переулок ' || n || '/7 5' ELSE s || ' площадь еелка' END AS ocr,
    CASE k WHEN 0 THEN s || ' ' || n || ' а' WHEN 1 THEN s || ' дом ' || n || '/3' WHEN 2 THEN '3-й ' || s || ' ' || n || '/7 5' ELSE s || ' еелка' END AS street,
    CASE k WHEN 0 THEN n WHEN 1 THEN n || '/3' WHEN 2 THEN n || '/7' END AS number, CASE k WHEN 1 THEN n || '/3' WHEN 2 THEN n || '/7' END AS marked,
    CASE WHEN k < 3 THEN n::BIGINT END AS number_int,
    CASE k WHEN 0 THEN n WHEN 1 THEN n || '/3|' || n || 'к3' WHEN 2 THEN n || '/7|' || n || 'к7' ELSE '' END AS keys,
    CASE k WHEN 0 THEN 'ул.' || replace(s, ' ', '') || ',' || n || 'а' WHEN 1 THEN 'проспект' || replace(s, ' ', '') || 'дом' || n || '/3' WHEN 2 THEN '3-й' || replace(s, ' ', '') || 'переулок' || n || '/75' ELSE replace(s, ' ', '') || 'площадьеелка' END AS house,
    CASE k WHEN 0 THEN 'ул.' || replace(s, ' ', '') || ',' || n || 'а' WHEN 1 THEN 'проспект' || replace(s, ' ', '') || 'дом' || n || '/3' WHEN 2 THEN '3-й' || replace(s, ' ', '') || 'переулок' || n || '/75' ELSE replace(s, ' ', '') || 'площадьеелка' END AS house_letters,
    CASE k WHEN 0 THEN 'ulitsa' WHEN 1 THEN 'prospekt' WHEN 2 THEN 'pereulok' ELSE 'ploshchad' END AS kind, 1::BIGINT AS markers,
    CASE WHEN k = 2 THEN 3::BIGINT END AS nth, CASE WHEN k = 2 THEN s || ' ' || n || '/7 5' END AS base
FROM f"""


def street_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, names of streets and pairs of names in written addresses."""
    t = F.col("t")
    cities = F.array(F.lit("red"), F.lit("площадь"))
    rows = _written(spark, sf_dir).select("p_partkey", text.tokens(t).alias("tk"), street_candidates(t, cities).alias("st"), text.name_tokens(t, cities).alias("nm"))
    pair = F.transform(text.pairs(F.concat("st", "nm")), lambda p: F.concat_ws("+", p["a"], p["b"]))
    joined = {"tokens": F.col("tk"), "streets": F.col("st"), "names": F.col("nm"), "pairs": pair}
    return rows.select("p_partkey", *(F.array_join(c, "|").alias(n) for n, c in joined.items()))


STREETS_SQL = f"""WITH {FORMS},
g AS (SELECT *, split_part(s, ' ', 1) AS s1, split_part(s, ' ', 2) AS s2 FROM f),
r AS (SELECT p_partkey, list_filter(CASE k WHEN 0 THEN ['ул', s1, s2, n] WHEN 1 THEN ['проспект', s1, s2, 'дом', n] WHEN 2 THEN ['3-й', s1, s2, 'переулок', n] ELSE [s1, s2, 'площадь', 'еелка'] END, lambda x: length(x) >= 2) AS tokens,
    [CASE WHEN s1 = 'red' AND k <> 2 THEN s2 ELSE s END] AS base, k, n, s1, s2 FROM g),
u AS (SELECT *, CASE k WHEN 0 THEN [base[1] || ' ' || n || ' а'] WHEN 1 THEN base WHEN 2 THEN ['3-й ' || s1 || ' ' || s2, n || '/7'] ELSE [base[1], 'еелка'] END AS streets,
    list_filter(tokens, lambda x: length(x) >= 4 AND x NOT IN ('red', 'площадь', 'проспект', 'переулок')) AS names FROM r),
d AS (SELECT *, list_filter(list_concat(streets, names), lambda x, i: list_position(list_concat(streets, names), x) = i)[1:6] AS every FROM u)
SELECT p_partkey, array_to_string(tokens, '|') AS tokens, array_to_string(streets, '|') AS streets, array_to_string(names, '|') AS names,
    array_to_string(flatten(list_transform(every, lambda x, i: list_transform(every[i + 1:], lambda y: x || '+' || y)))[1:20], '|') AS pairs
FROM d"""


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a plate, a road and a dialling code of each order line's part; some speak of regions without a plate."""
    key, code = F.col("p_partkey"), F.lpad((F.col("p_size") % 30).cast("string"), 2, "0")
    plate = F.when(key % 3 == 0, F.concat(F.lit("А"), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit("ВС "), code)).when(key % 3 == 1, F.concat(F.lit("регион "), code)).otherwise(F.concat(F.lit("x"), code, F.lit("y")))
    road = F.concat(F.when(key % 2 == 0, "трасса М-").otherwise("road M "), (key % 40).cast("string"))
    phone = F.when(key % 5 == 0, F.concat(F.lit(" тел. +7 ("), F.element_at(F.array(F.lit("495"), F.lit("383"), F.lit("999")), (key % 3 + 1).cast("int")), F.lit(") 1"))).otherwise("")
    return _t(spark, sf_dir, "part").select(key.alias("request_id"), F.lit(0).alias("source"), F.concat(plate, F.lit("; "), road, phone).alias("text"))


SAID = """s AS (SELECT p_partkey AS id, lpad((p_size % 30)::VARCHAR, 2, '0') AS code, p_partkey % 40 AS road, ['495', '383', '999'][p_partkey % 3 + 1] AS phone FROM part)"""


def text_clues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plates, roads and dialling codes of texts, looked up in the seed tables."""
    found = plan.text_clues(_said(spark, sf_dir), _seeds(spark, sf_dir))
    return found.select("request_id", "kind", "name", "code", "lat", "lon", "score", clues.kind_priority(F.col("kind")).cast("long").alias("priority"))


TEXT_CLUES_SQL = f"""WITH {SAID}, p AS (SELECT lpad((n_nationkey + 1)::VARCHAR, 2, '0') AS code, n_name AS name, n_nationkey::DOUBLE AS lat, n_regionkey::DOUBLE AS lon FROM nation)
SELECT id AS request_id, 'plate_region' AS kind, name, s.code, lat, lon, CASE WHEN id % 3 = 0 THEN 0.95 ELSE 0.55 END::DOUBLE AS score, 0::BIGINT AS priority FROM s JOIN p ON p.code = s.code WHERE id % 3 < 2
UNION ALL SELECT id, 'plate_region', name, p.code, lat, lon, 0.55, 0 FROM s JOIN p ON p.code = road::VARCHAR WHERE id % 3 = 1 AND road >= 10 AND p.code <> s.code
UNION ALL SELECT id, 'highway', 'road ' || n_name, 'M-' || n_nationkey, n_nationkey, n_regionkey, 0.75, 1 FROM s JOIN nation ON n_nationkey = road
UNION ALL SELECT id, 'phone_code', CASE phone WHEN '495' THEN 'Москва' ELSE 'Новосибирск' END, phone, CASE phone WHEN '495' THEN 55.7558 ELSE 55.0084 END, CASE phone WHEN '495' THEN 37.6173 ELSE 82.9357 END, 0.65, 2
    FROM s WHERE id % 5 = 0 AND phone <> '999'"""


def plate_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plate that most readings of an image agree on, its region repaired by the table (here: an image of each part, read by its lines)."""
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("image_id"), F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")).alias("variant"), "l_linenumber", "l_partkey")
    digits = F.concat(F.lit("0"), F.col("l_linenumber").cast("string"), F.lit("5"))
    reading = F.concat(F.lit("[a"), digits, F.lit("bc "), F.lpad((F.col("l_partkey") % 90).cast("string"), 2, "0"), F.lit("] x"))
    regions = _t(spark, sf_dir, "nation").select(F.lpad((F.col("n_nationkey") + 60).cast("string"), 2, "0").alias("code"))
    return ocr.best_plates(lines.select("image_id", "variant", reading.alias("text")), regions).select("image_id", "plate", "code", "known")


PLATES_SQL = """WITH v AS (SELECT l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) AS variant FROM lineitem),
b AS (SELECT l_partkey, l_linenumber FROM v GROUP BY l_partkey, l_linenumber QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, min(variant)) = 1),
c AS (SELECT *, lpad((l_partkey % 90)::VARCHAR, 2, '0') AS code FROM b),
t AS (SELECT *, [code, regexp_replace(code, '3', '8'), regexp_replace(code, '8', '3')] AS tries FROM c),
k AS (SELECT *, list_filter(tries, lambda x: x::INT BETWEEN 60 AND 84)[1] AS hit FROM t)
SELECT l_partkey::VARCHAR AS image_id, 'А0' || l_linenumber || '5ВС' || code AS plate, coalesce(hit, code) AS code, hit IS NOT NULL AS known FROM k"""


def fragment_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of fragments by what is given, written, known to the seed tables, and by shape; labels and what each type allows."""
    key = F.col("p_partkey")
    written = F.element_at(F.array(*map(F.lit, ["", "ул. small ring", "А123ВС 05", "А123ВС 99", "трасса М-4", "+7 (383) 11", "12345 a"])), (key % 7 + 1).cast("int"))
    given = F.element_at(F.array(F.lit("auto"), F.lit("Flag "), F.lit(None).cast("string")), (key % 3 + 1).cast("int"))
    fragment = F.struct(key.cast("string").alias("id"), F.lit(0).cast("long").alias("created_at_ms"), F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), (F.col("p_size") * 3).cast("int").alias("w"), F.lit(30).alias("h")).alias("rect"), F.lit(None).cast("string").alias("note"), written.alias("ocr_text"), F.lit("").alias("image_b64"), given.alias("clue_type"))
    requests = _t(spark, sf_dir, "part").select(key.alias("request_id"), F.array(fragment).alias("fragments"))
    f = plan.fragments_of(requests, _seeds(spark, sf_dir))
    t = F.col("type")
    return f.select("request_id", "type", clues.type_label(t).alias("label"), clues.allows_text(t).alias("reads"), clues.allows_emblems(t).alias("shows"), clues.emblem_floor(t).alias("floor"), perception.needs_retry(F.col("ocr_text")).alias("again"))


TYPES_SQL = """WITH p AS (SELECT p_partkey AS id, p_partkey % 7 AS k, p_partkey % 3 = 1 AS flag, p_size * 3 / 30.0 BETWEEN 2.0 AND 6.5 AS wide FROM part),
t AS (SELECT *, CASE WHEN flag THEN 'flag' WHEN k = 1 THEN 'street' WHEN k = 2 THEN 'plate' WHEN k = 4 THEN 'highway' WHEN k = 5 THEN 'text' WHEN wide AND k = 6 THEN 'plate' WHEN wide AND k = 3 THEN 'plate' WHEN wide THEN 'street' ELSE 'auto' END AS type FROM p)
SELECT id AS request_id, type, CASE type WHEN 'flag' THEN 'Флаг' WHEN 'street' THEN 'Улица / адрес' WHEN 'plate' THEN 'Номер' WHEN 'highway' THEN 'Трасса' WHEN 'text' THEN 'Текст' ELSE 'Авто' END AS label,
    type <> 'flag' AS reads, type IN ('auto', 'flag') AS shows, CASE WHEN type = 'flag' THEN 0.35 ELSE 0.72 END::DOUBLE AS floor, k = 0 AS again FROM t"""


def fragment_clues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clues of requests' texts and fragments, ranked, and what each fragment shows (here: two fragments a part)."""
    key = F.col("p_partkey")
    said = _said(spark, sf_dir).select("request_id", "text")
    fragment = lambda n, c: F.struct(F.concat(key.cast("string"), F.lit(n)).alias("id"), F.lit(0).cast("long").alias("created_at_ms"), F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(9).alias("w"), F.lit(9).alias("h")).alias("rect"), F.lit("").alias("note"), c.alias("ocr_text"), F.lit("").alias("image_b64"), F.lit("text").alias("clue_type"))
    requests = _t(spark, sf_dir, "part").join(said, key == F.col("request_id")).select("request_id", F.lit("").alias("manual_text"), F.lit("geoguess").alias("mode"), F.array(fragment("a", F.lit("no clue")), fragment("b", F.col("text"))).alias("fragments"))
    _, analysis = plan.clue_stage(requests, _seeds(spark, sf_dir))
    return plan.with_analysis(requests.selectExpr("request_id", "inline(fragments)").select("request_id", "id"), analysis).select("request_id", "id", "effective_type", "detected_kind", "detected_label", "clue_score")


FRAGMENT_CLUES_SQL = f"""WITH c AS ({TEXT_CLUES_SQL}), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, CASE WHEN kind = 'plate_region' THEN CASE WHEN request_id % 3 = 1 AND code <> (SELECT lpad((p_size % 30)::VARCHAR, 2, '0') FROM part WHERE p_partkey = request_id) THEN 1 ELSE 0 END ELSE 2 END) = 1)
SELECT p_partkey AS request_id, p_partkey || 'a' AS id, 'text' AS effective_type, NULL AS detected_kind, NULL AS detected_label, 0.0::DOUBLE AS clue_score FROM part
UNION ALL SELECT p_partkey, p_partkey || 'b', 'text', kind, name, coalesce(score, 0.0) FROM part LEFT JOIN b ON request_id = p_partkey"""


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised words: an image of each order, its lines as words."""
    l = _t(spark, sf_dir, "lineitem")
    return l.select(F.col("l_orderkey").cast("string").alias("image_id"), (F.col("l_suppkey") % 2).cast("int").alias("variant"), (F.col("l_quantity") * 2).alias("y"), F.col("l_extendedprice").alias("x"), F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("text"), (F.col("l_discount") * 8).alias("conf"))


WORDS = "w AS (SELECT l_orderkey::VARCHAR AS image_id, l_suppkey % 2 AS variant, l_quantity * 2 AS y, l_extendedprice AS x, l_returnflag || l_partkey AS text, l_discount * 8 AS conf FROM lineitem)"


def reading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of recognised words, broken where the gap in height is large."""
    found = ocr.text_lines(_words(spark, sf_dir))
    return found.select("image_id", F.col("variant").cast("long").alias("variant"), "line", "text", F.round("conf", 6).alias("conf"))


LINES_SQL = f"""WITH {WORDS}, k AS (SELECT *, greatest(12.0, 0.08 * greatest(1.0, max(y) OVER (PARTITION BY image_id, variant) - min(y) OVER (PARTITION BY image_id, variant))) AS tol FROM w WHERE conf >= 0.25),
g AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY image_id, variant ORDER BY y, x, text) > tol THEN 1 ELSE 0 END AS new FROM k),
l AS (SELECT *, 1 + sum(new) OVER (PARTITION BY image_id, variant ORDER BY y, x, text ROWS UNBOUNDED PRECEDING) AS line FROM g)
SELECT image_id, variant::BIGINT AS variant, line::BIGINT AS line, string_agg(text, ' ' ORDER BY y, x, text) AS text, round(avg(conf), 6) AS conf FROM l GROUP BY ALL"""


def reading_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the positive whole confidences of each reading."""
    words = _words(spark, sf_dir).withColumn("conf", F.col("conf") * 100 - 5)
    return ocr.mean_confidence(words).select("image_id", F.col("variant").cast("long").alias("variant"), F.round("conf", 6).alias("conf"))


CONFIDENCE_SQL = f"""WITH {WORDS} SELECT image_id, variant::BIGINT AS variant, round(coalesce(avg(floor(conf * 100 - 5)) FILTER (floor(conf * 100 - 5) > 0), 0.0), 6) AS conf FROM w GROUP BY ALL"""


def best_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading of each image with the largest score (here: a conversation's turns as readings)."""
    turns = _t(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("image_id"), F.col("turn").alias("variant"), "text").groupBy("image_id", "variant").agg(F.min("text").alias("text"))
    return ocr.best_readings(turns).select("image_id", "variant", F.col("score").cast("long").alias("score"))


BEST_SQL = r"""WITH s AS (SELECT conv_id, turn, trim(coalesce(min(text), ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS s FROM conversations GROUP BY conv_id, turn),
m AS (SELECT *, length(regexp_replace(s, '[^\p{L}]', '', 'g')) AS l, length(regexp_replace(s, '[^\p{Nd}]', '', 'g')) AS d, length(s) - length(regexp_replace(s, '[\s\v]', '', 'g')) AS sp, len(regexp_split_to_array(s, '[\s\v]+')) AS w FROM s),
r AS (SELECT *, (CASE WHEN length(s) <= 2 THEN 0 ELSE greatest(0, l * 5 + d * 2 + length(s) + w * 12 + least(6, sp) * 2 - CASE WHEN l <= 2 AND w <= 1 AND length(s) <= 4 THEN 50 ELSE 0 END) END)::BIGINT AS score FROM m)
SELECT conv_id::VARCHAR AS image_id, turn AS variant, score FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) = 1"""


def cleaned_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings repaired, readings without words marked (here: readings made of part names and sizes)."""
    n = F.col("p_size").cast("string")
    made = F.element_at(F.array(F.concat(F.lit("«ули ца "), "p_name", F.lit("»  "), n), F.concat(n, F.lit(" "), n, F.lit(" "), n), F.lit("аб"), n, F.concat(F.lit("ул. "), "p_name", F.lit(" \\ — казбекс кая")), F.lit("1 2 3 4 "), F.lit("  ")), (F.col("p_partkey") % 7 + 1).cast("int"))
    rows = _t(spark, sf_dir, "part").select("p_partkey", made.alias("r"))
    return rows.select("p_partkey", text.repaired(F.col("r")).alias("text"), text.is_garbage(F.col("r")).alias("garbage"), text.plate_text(F.col("r")).alias("plate"))


CLEANED_SQL = r"""WITH p AS (SELECT p_partkey, p_partkey % 7 AS k, p_name AS s, p_size::VARCHAR AS n FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'улица ' || s || ' ' || n WHEN 1 THEN n || ' ' || n || ' ' || n WHEN 2 THEN 'аб' WHEN 3 THEN n WHEN 4 THEN 'улица ' || s || ' - Казбекская' WHEN 5 THEN '1 2 3 4' ELSE '' END AS text,
    CASE k WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN length(n) < 2 WHEN 5 THEN true WHEN 6 THEN true ELSE false END AS garbage,
    CASE k WHEN 0 THEN ' УЛИ ЦА ' || translate(upper(s), 'ABEKMHOPCTYX', 'АВЕКМНОРСТУХ') || ' ' || n WHEN 1 THEN n || ' ' || n || ' ' || n WHEN 2 THEN 'АБ' WHEN 3 THEN n WHEN 4 THEN 'УЛ ' || translate(upper(s), 'ABEKMHOPCTYX', 'АВЕКМНОРСТУХ') || ' КАЗБЕКС КАЯ' WHEN 5 THEN '1 2 3 4 ' ELSE ' ' END AS plate
FROM p"""


def text_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of inked rows (here: a picture of each brand, its sizes as rows, prices as ink)."""
    rows = _t(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("image_id"), F.col("p_size").cast("int").alias("y")).agg(F.max(F.col("p_retailprice") % 100).alias("ink"))
    found = ocr.text_bands(rows, share=0.6, merge=1, height=3, pad=2)
    return found.select("image_id", F.col("top").cast("long").alias("top"), F.col("bottom").cast("long").alias("bottom"))


BANDS_SQL = """WITH r AS (SELECT p_brand AS image_id, p_size AS y, max(p_retailprice % 100) AS ink FROM part GROUP BY ALL),
f AS (SELECT *, greatest(0.6 * max(ink) OVER (PARTITION BY image_id), 30.0) AS least, max(y) OVER (PARTITION BY image_id) AS last FROM r),
g AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY image_id ORDER BY y) > 2 THEN 1 ELSE 0 END AS new FROM f WHERE ink >= least),
l AS (SELECT *, sum(new) OVER (PARTITION BY image_id ORDER BY y ROWS UNBOUNDED PRECEDING) AS line FROM g),
b AS (SELECT image_id, min(y) AS top, max(y) AS bottom, any_value(last) AS last FROM l GROUP BY image_id, line HAVING max(y) - min(y) + 1 >= 3)
SELECT image_id, greatest(0, top - 2)::BIGINT AS top, least(last, bottom + 2)::BIGINT AS bottom FROM b"""


def merged_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an image without those that begin another one (here: part names and their first words, by brand)."""
    part = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("image_id"), "p_name")
    lines = part.select("image_id", F.col("p_name").alias("text")).union(part.select("image_id", F.substring_index("p_name", " ", 1))).union(part.select("image_id", F.concat(F.lit("ул "), F.substring("p_name", 1, 7))))
    return ocr.merged_lines(lines)


MERGED_SQL = """WITH t AS (SELECT p_brand AS image_id, p_name AS text FROM part UNION SELECT p_brand, split_part(p_name, ' ', 1) FROM part UNION SELECT p_brand, 'ул ' || substr(p_name, 1, 7) FROM part),
s AS (SELECT image_id, trim(regexp_replace(text, ' +', ' ', 'g')) AS clean, text, replace(text, ' ', '') AS key FROM t),
m AS (SELECT *, length(key) * 5 + length(clean) + len(string_split(clean, ' ')) * 12 + least(6, length(clean) - length(key)) * 2 AS score FROM s),
b AS (SELECT image_id, key, text FROM m QUALIFY row_number() OVER (PARTITION BY image_id, key ORDER BY score DESC, text DESC) = 1),
k AS (SELECT * FROM b x WHERE NOT EXISTS (SELECT 1 FROM b y WHERE y.image_id = x.image_id AND y.key <> x.key AND starts_with(y.key, x.key)))
SELECT image_id, text, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN starts_with(text, 'ул') THEN 1 ELSE 2 END, text) AS line FROM k"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections clamped to their images, slivers dropped, and the score of a panel of that shape (here: order lines as boxes)."""
    l = _t(spark, sf_dir, "lineitem")
    n = lambda c: F.col(c).cast("int")
    found = l.select(F.col("l_suppkey").alias("image_id"), "l_orderkey", "l_linenumber", "l_partkey", (n("l_quantity") * 4 - 60).alias("x1"), (n("l_quantity") * 4 + n("l_linenumber") * 15 - 60).alias("x2"), (n("l_linenumber") * 10 - 20).alias("y1"), (n("l_linenumber") * 10 + n("l_quantity") - 20).alias("y2"), (F.col("l_discount") * 10).alias("fill"))
    images = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), F.lit(120).alias("width"), F.lit(60).alias("height"))
    kept = ocr.crops(found, images)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    score = ocr.panel_score((w * h).cast("double"), w, h, F.col("fill"), F.lit(120), F.lit(60))
    return kept.groupBy("image_id").agg(F.count("*").alias("n"), F.sum(w * h).alias("area"), F.round(F.sum(score), 4).alias("score"))


BOXES_SQL = """WITH d AS (SELECT l_suppkey AS image_id, greatest(0, least(120, l_quantity::INT * 4 - 60)) AS x1, greatest(0, least(120, l_quantity::INT * 4 + l_linenumber * 15 - 60)) AS x2,
    greatest(0, least(60, l_linenumber * 10 - 20)) AS y1, greatest(0, least(60, l_linenumber * 10 + l_quantity::INT - 20)) AS y2, l_discount * 10 AS fill FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
k AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h FROM d WHERE x2 - x1 >= 12 AND y2 - y1 >= 12)
SELECT image_id, count(*) AS n, sum(w * h)::BIGINT AS area, round(sum(CASE WHEN w >= 25 AND h >= 18 AND fill >= 0.22 AND w * h >= 600 THEN w * h * fill * CASE WHEN w / h > 0.2 AND w / h < 4.5 THEN 1.25 ELSE 0.75 END ELSE -1.0 END), 4) AS score
FROM k GROUP BY image_id"""


def reader_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of text readers in their several shapes, addresses of pictures, scores as percent (here: made of parts)."""
    name, key = F.col("p_name"), F.col("p_partkey")
    hit = F.when(key % 4 == 0, F.concat(F.lit('[[[0,0],[1,1]],"'), name, F.lit('",0.5]'))).when(key % 4 == 1, F.concat(F.lit('["'), name, F.lit('",'), (F.col("p_size") / 64).cast("string"), F.lit("]"))).when(key % 4 == 2, F.concat(F.lit('"'), name, F.lit('"'))).otherwise(F.concat(F.lit('[[[0,0]],"'), name, F.lit('"]')))
    share = F.when(key % 3 == 0, F.col("p_size") / 64).when(key % 3 == 1, F.col("p_size") / 1024).otherwise(F.col("p_size") + 1.5)
    read = _t(spark, sf_dir, "part").select("p_partkey", ocr.recognised(hit).alias("r"), perception.picture_url(F.concat(name, F.when(key % 2 == 0, ".png").otherwise(" é")), "http://pictures/").alias("url"), geo.percent_text(share).alias("percent"))
    return read.select("p_partkey", F.col("r.text").alias("text"), F.col("r.conf").alias("conf"), "url", "percent")


HITS_SQL = """SELECT p_partkey, p_name AS text, CASE p_partkey % 4 WHEN 0 THEN 0.5 WHEN 1 THEN p_size / 64 ELSE 0.75 END::DOUBLE AS conf,
    'http://pictures/' || replace(p_name, ' ', '_') || CASE WHEN p_partkey % 2 = 0 THEN '.png' ELSE '_%C3%A9.svg' END AS url,
    CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_size / 64 * 100 >= 10 THEN printf('%.0f%%', (floor(p_size / 64 * 100 + 0.5))::DOUBLE) ELSE printf('%.1f%%', floor(p_size / 64 * 1000 + 0.5) / 10) END
        WHEN 1 THEN printf('%.1f%%', floor(p_size / 1024 * 1000 + 0.5) / 10) ELSE printf('%.2f', p_size + 1.5) END AS percent
FROM part"""


def shown_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City and the rest of candidates' names, as shown (here: crossings and streets of parts)."""
    key = F.col("p_partkey")
    name = F.when(key % 2 == 0, F.concat("p_brand", F.lit(": "), "p_name", F.lit(" ∩ "), "p_type")).otherwise(F.concat_ws(", ", "p_brand", "p_name", F.col("p_size").cast("string")))
    return plan.display(_t(spark, sf_dir, "part").select("p_partkey", name.alias("name"))).select("p_partkey", "shown_city", "shown_rest")


SHOWN_SQL = "SELECT p_partkey, p_brand AS shown_city, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' ∩ ' || p_type ELSE p_name || ', ' || p_size END AS shown_rest FROM part"


def emblem_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emblems that look like a picture: the five best above the floor (here: every twentieth vector against all)."""
    rows = _t(spark, sf_dir, "embeddings")
    kind = F.when(F.col("label") % 2 == 0, "city").otherwise("region")
    emblems = rows.select(F.col("vec_id").alias("id"), F.concat(F.lit("e"), "vec_id").alias("name"), kind.alias("kind"), F.col("label").cast("double").alias("lat"), F.lit(1.0).alias("lon"), F.col("embedding").alias("vector"))
    found = emblem_matches(rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), emblems)
    return found.select("query_id", "name", "lat", "score", "kind")


EMBLEM_SQL = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
p AS (SELECT q.vec_id AS query_id, i.vec_id AS id, i.label, round(list_dot_product(q.v, i.v), 6) AS s FROM u q, u i WHERE q.vec_id % 20 = 0),
r AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 5)
SELECT query_id, 'e' || id AS name, label::DOUBLE AS lat, round(least(0.99, s), 3) AS score, CASE WHEN label % 2 = 0 THEN 'heraldry' ELSE 'heraldry_region' END AS kind FROM r WHERE s >= 0.25"""


def ordinal_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets with a number in their name, of which the asked one is missing: the nearest numbers (odd ones are there, even ones asked for)."""
    rows = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    street = F.concat((F.col("p_size") % 10 * 2 + 1).cast("string"), F.lit("-й "), F.col("p_name"))
    rows = rows.select(F.lit("приморск").alias("city"), street.alias("street"), F.concat_ws("/", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string")).alias("house"), (F.col("l_discount") * 100).alias("lat"), (F.col("l_tax") * 100).alias("lon"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"))
    g = build_gazetteer(rows)
    known = plan.Seeds(*(spark.createDataFrame([], t) for t in ("name string, lat double, lon double, aliases array<string>", *["code string, name string, lat double, lon double"] * 3)))
    parts = _t(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("request_id"))
    said = F.concat(F.lit("ул. "), (F.col("request_id") % 10 * 2 + 2).cast("string"), F.lit("-й "), F.col("p_name"))
    asked = parts.select("request_id", said.alias("manual_text"), F.lit("address").alias("mode"), F.lit(None).cast(seeds.FRAGMENTS).alias("fragments"))
    q = plan.queried(plan.request_texts(asked), known, g)
    found = plan.street_stage(q, g, known.major(), plan.street_centres(g))
    return found.select("request_id", "kind", "name", F.round("score", 4).alias("score"), "seq")


ORDINAL_SQL = """WITH a AS (SELECT (p_size % 10 * 2 + 1) AS number, p_name, l_linenumber || '/' || l_quantity::INT AS house, (l_orderkey, l_linenumber, l_partkey, l_suppkey) AS seq FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT number, p_name, count(DISTINCT house) AS n, min(seq) AS first FROM a GROUP BY ALL),
q AS (SELECT p_name, min(p_partkey) AS id, min(p_partkey) % 10 * 2 + 2 AS wanted FROM part GROUP BY p_name),
m AS (SELECT id, number, s.p_name, n, first, abs(number - wanted) AS d FROM q JOIN s ON contains(s.p_name, q.p_name) QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(number - wanted), first) <= 8),
p AS (SELECT *, round(greatest(0.22, 0.52 - 0.06 * d - 1.0 / (3.0 + n)) + 1e-12, 4) AS score FROM m)
SELECT id AS request_id, 'street_approx' AS kind, 'приморск, ' || number || '-й ' || p_name AS name, score::DOUBLE AS score, row_number() OVER (PARTITION BY id ORDER BY score DESC, n DESC, first) AS seq FROM p"""


def payload_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What requests carry: fragments, images that their type can use, characters of recognised text (here: three fragments a part)."""
    key = F.col("p_partkey")
    fragment = lambda kind, ocr_text: F.struct(F.lit("f").alias("id"), F.lit(0).cast("long").alias("created_at_ms"), F.struct(*(F.lit(0).alias(c) for c in "xywh")).alias("rect"), F.lit("").alias("note"), ocr_text.alias("ocr_text"), F.lit("aW1n").alias("image_b64"), kind.alias("clue_type"))
    pieces = F.array(fragment(F.lit(None).cast("string"), F.lit("")), fragment(F.lit("flag"), F.lit(None).cast("string")), fragment(F.lit("text"), F.when(key % 2 == 0, F.col("p_name")).otherwise(" ")))
    requests = _t(spark, sf_dir, "part").select("p_brand", pieces.alias("fragments"))
    sent = perception.fragment_payload(requests)
    kept = F.size(F.filter("fragments", lambda f: f["image_b64"].isNotNull()))
    return sent.groupBy("p_brand").agg(F.count_if(perception.has_text(F.col("fragments"))).alias("with_text"), F.sum(kept).alias("images"))


PAYLOAD_SQL = "SELECT p_brand, count(*) FILTER (p_partkey % 2 = 0) AS with_text, sum(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END)::BIGINT AS images FROM part GROUP BY p_brand"


def payload_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over all requests of what they would carry (here: a fragment of each conversation's turn)."""
    fragment = F.struct(F.lit("f").alias("id"), F.lit(0).cast("long").alias("created_at_ms"), F.struct(*(F.lit(0).alias(c) for c in "xywh")).alias("rect"), F.lit("").alias("note"), F.col("text").alias("ocr_text"), F.when(F.col("role") == "user", "aW1n").alias("image_b64"), F.lit("flag").alias("clue_type"))
    return perception.dry_run(_t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(fragment).alias("fragments")))


TOTAL_SQL = "SELECT count(DISTINCT conv_id) AS requests, count(*) AS fragments, count(*) FILTER (role = 'user') AS images, sum(length(coalesce(text, '')))::BIGINT AS ocr_chars FROM conversations"


QUERIES = {
    "gazetteer_crossings": (gazetteer_crossings, CROSSING_SQL), "import_summary": (import_summary, IMPORT_SQL), "table_health": (table_health, HEALTH_SQL), "locate_places": (locate_places, LOCATE_SQL), "locate_listed": (locate_listed, LISTED_SQL),
    "city_answers": (city_answers, CITY_SQL), "several_cities": (several_cities, SEVERAL_SQL), "address_forms": (address_forms, FORMS_SQL), "street_forms": (street_forms, STREETS_SQL), "text_clues": (text_clues, TEXT_CLUES_SQL),
    "plate_readings": (plate_readings, PLATES_SQL), "fragment_types": (fragment_types, TYPES_SQL), "fragment_clues": (fragment_clues, FRAGMENT_CLUES_SQL), "reading_lines": (reading_lines, LINES_SQL),
    "reading_confidence": (reading_confidence, CONFIDENCE_SQL), "best_readings": (best_readings, BEST_SQL), "cleaned_readings": (cleaned_readings, CLEANED_SQL), "text_bands": (text_bands, BANDS_SQL),
    "merged_readings": (merged_readings, MERGED_SQL), "boxes": (boxes, BOXES_SQL), "reader_hits": (reader_hits, HITS_SQL), "shown_names": (shown_names, SHOWN_SQL), "emblem_answers": (emblem_answers, EMBLEM_SQL),
    "ordinal_streets": (ordinal_streets, ORDINAL_SQL), "payload_counts": (payload_counts, PAYLOAD_SQL), "payload_total": (payload_total, TOTAL_SQL),
}
