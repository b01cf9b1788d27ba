"""Registered queries of the library proper, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold import image_queries, lookup_queries, place_queries
from wayfold.functions import clues, text
from wayfold.operators import shapes
from wayfold.operators.gram_index import build_index, names_similar
from wayfold.operators.vectors import top_similar


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def street_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, count and count-driven score of each group (here: order lines by supplier)."""
    found = shapes.centroids(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_discount")
    return found.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


CENTROID_SQL = """
SELECT l_suppkey, round(avg(l_quantity), 6) AS lat, round(avg(l_discount), 6) AS lon, count(*) AS houses,
    round(greatest(0.38, 0.68 - 1.0 / (3.0 + count(*))), 4) AS score
FROM lineitem GROUP BY l_suppkey"""


def pair_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of places of one group: distance, midpoint, score (here: suppliers of one nation, placed by their lines)."""
    places = shapes.centroids(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_tax").join(_t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    found = shapes.pair_centroids(places, "s_nationkey", "s_suppkey")
    return found.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


PAIR_SQL = """
WITH p AS (SELECT s_nationkey, s_suppkey, avg(l_quantity) AS lat, avg(l_tax) AS lon, count(*) AS n
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
j AS (SELECT x.s_nationkey, x.s_suppkey AS a, y.s_suppkey AS b, x.lat AS la, x.lon AS oa, y.lat AS lb, y.lon AS ob, x.n AS na, y.n AS nb
    FROM p x JOIN p y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey)
SELECT s_nationkey, a, b,
    round(2 * 6371.0 * asin(least(1.0, sqrt(sin(radians(lb - la) / 2) * sin(radians(lb - la) / 2)
        + cos(radians(la)) * cos(radians(lb)) * sin(radians(ob - oa) / 2) * sin(radians(ob - oa) / 2)))), 3) AS sep_km,
    round((la + lb) / 2, 6) AS lat, round((oa + ob) / 2, 6) AS lon, least(na, nb) AS fewer, na + nb AS houses,
    round(greatest(0.45, 0.82 - 1.0 / (4.0 + least(na, nb))), 4) AS score
FROM j"""


def cooccurrence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that meet at a node (here: suppliers that share an order)."""
    return shapes.cooccurring_pairs(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


COOCCURRENCE_SQL = """
WITH d AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS nodes
FROM d x JOIN d y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY ALL"""


def pair_best_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each pair the group with most weight (here: market segments that share a nation, weighed by suppliers)."""
    members = _t(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()
    weights = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count("*").alias("suppliers"))
    return shapes.best_group_of_pairs(members, "c_nationkey", "c_mktsegment", weights, "suppliers")


BEST_GROUP_SQL = """
WITH m AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer),
w AS (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1),
p AS (SELECT x.c_nationkey, x.c_mktsegment AS a, y.c_mktsegment AS b, coalesce(suppliers, 0) AS suppliers
    FROM m x JOIN m y ON x.c_nationkey = y.c_nationkey AND x.c_mktsegment < y.c_mktsegment LEFT JOIN w ON s_nationkey = x.c_nationkey)
SELECT a, b, c_nationkey, suppliers FROM p
QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY suppliers DESC, c_nationkey) = 1"""


def first_wins_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first payload of each key (here: a customer's first order)."""
    return shapes.first_wins(_t(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderpriority", "o_totalprice"])


FIRST_SQL = """
SELECT o_custkey, o_orderdate, o_orderkey, o_orderpriority, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1"""


def last_wins_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last payload of each key in the place of the first (here: a user's events)."""
    rows = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return shapes.last_wins(rows, ["user_id"], "event_id", ["event_type", "value"])


LAST_SQL = """
SELECT user_id, min(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value
FROM events GROUP BY user_id"""


def anti_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key is absent (here: customers without urgent orders)."""
    present = _t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return shapes.absent(_t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), present, ["c_custkey"])


ANTI_SQL = "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"


def nearest_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest known number of each group, with the house score of the gap (here: quantities asked of each brand's part sizes)."""
    from wayfold.functions.geo import house_score

    part = _t(spark, sf_dir, "part").select("p_brand", F.col("p_size").cast("long").alias("p_size"), "p_partkey")
    lines = _t(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    asked = lines.select("p_brand", (2 * F.col("l_quantity")).cast("long").alias("p_size")).distinct()
    found = shapes.nearest_number(asked, part, ["p_brand"], "p_size", "p_partkey")
    return found.withColumn("score", house_score(F.lit(100.0), F.col("distance")))


NEAREST_SQL = """
WITH a AS (SELECT DISTINCT p_brand, (2 * l_quantity)::BIGINT AS asked FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT a.p_brand, asked, p_size::BIGINT AS found, p_partkey, abs(asked - p_size)::BIGINT AS distance FROM a JOIN part USING (p_brand) WHERE p_size IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY a.p_brand, asked ORDER BY abs(asked - p_size), p_size, p_partkey) = 1)
SELECT p_brand, asked AS p_size, found, p_partkey, distance,
    round(greatest(0.0, least(1.0, 1.0 - CASE WHEN distance = 0 THEN 0.0 WHEN distance <= 2 THEN 0.15 WHEN distance <= 10 THEN 0.25 ELSE 0.35 END)), 4) AS score
FROM m"""


def exact_then_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names equal to a term, else names that hold it (here: the last words of part names, and whole names, against all names)."""
    part = _t(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("p_name"))
    terms = part.select(F.substring_index("p_name", " ", -1).alias("term")).union(part.select(F.col("p_name").alias("term")))
    return shapes.exact_then_part(terms, part, "term", "p_name", "p_partkey").select("term", "p_partkey", "how")


EXACT_SQL = """
WITH p AS (SELECT p_partkey, lower(p_name) AS n FROM part),
t AS (SELECT DISTINCT term FROM (SELECT list_last(string_split(n, ' ')) AS term FROM p UNION ALL SELECT n FROM p) WHERE term <> ''),
e AS (SELECT term, p_partkey FROM t JOIN p ON n = term)
SELECT term, p_partkey, 'exact' AS how FROM e
UNION ALL
SELECT term, p_partkey, 'part' FROM (SELECT term FROM t WHERE term NOT IN (SELECT term FROM e)) JOIN p ON contains(' ' || n || ' ', ' ' || term || ' ')"""


def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form of every document, as length and digest, and its script."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("n"), text.script(F.col("text")).alias("script"))
    return docs.select("doc_id", F.md5("n").alias("digest"), F.length("n").cast("long").alias("n_chars"), "script")


NORMALISE_SQL = r"""
WITH n AS (SELECT doc_id, text, regexp_replace(replace(lower(regexp_replace(coalesce(text, ''), '^[\s\v\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\v\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g')), 'ё', 'е'),
    '[\s\v\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, md5(n) AS digest, length(n) AS n_chars,
    CASE WHEN regexp_matches(text, '[А-Яа-яЁё]') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(text, '[А-Яа-яЁё]') THEN 'cyrillic'
        WHEN regexp_matches(text, '[A-Za-z]') THEN 'latin' ELSE 'unknown' END AS script
FROM n"""


def letter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters, digits and OCR score of every turn of a conversation."""
    c = F.col("text")
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", text.letters(c).cast("long").alias("letters"), text.digits(c).cast("long").alias("digits"), text.text_score(c).cast("long").alias("score"))


LETTERS_SQL = r"""
WITH s AS (SELECT conv_id, turn, text, trim(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS s FROM conversations),
m AS (SELECT *, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS l, length(regexp_replace(text, '[^\p{Nd}]', '', 'g')) AS d,
    length(regexp_replace(s, '[^\p{L}]', '', 'g')) AS sl, length(regexp_replace(s, '[^\p{Nd}]', '', 'g')) AS sd,
    length(s) - length(regexp_replace(s, '[\s\v]', '', 'g')) AS sp, len(regexp_split_to_array(s, '[\s\v]+')) AS w FROM s)
SELECT conv_id, turn, l AS letters, d AS digits, (CASE WHEN length(s) <= 2 THEN 0
    ELSE greatest(0, sl * 5 + sd * 2 + length(s) + w * 12 + least(6, sp) * 2 - CASE WHEN sl <= 2 AND w <= 1 AND length(s) <= 4 THEN 50 ELSE 0 END) END)::BIGINT AS score
FROM m"""


def regex_clues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that documents mention, with their number (here: dialling codes)."""
    found = _t(spark, sf_dir, "documents").select("doc_id", F.explode(clues.phone_codes(F.col("text"))).alias("code"))
    return found.groupBy("doc_id", "code").agg(F.count("*").alias("n"))


CLUES_SQL = r"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:\+7|8)[\s\v\-()]*(?:\d{3})|\(\s*(?:\d{3})\s*\)')) AS m FROM documents)
SELECT doc_id, regexp_extract(m, '(\d{3})\D*$', 1) AS code, count(*) AS n FROM m GROUP BY ALL"""


def keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted hits of a dictionary (here: frequent words) in every document."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("words"))
    return shapes.keyword_scores(docs, "doc_id", "words", spark.range(1).select(F.explode(F.lit(KEYWORDS)).alias("name")))


KEYWORDS = ["the", "der", "que", "les", "of the", "und der", "of und"]
KEYWORD_SQL = f"""
WITH d AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS w FROM documents), k AS (SELECT unnest({KEYWORDS}) AS name)
SELECT doc_id, name, (CASE WHEN list_contains(w, name) THEN 7.0 ELSE 0.0 END + 1.5 * len(list_intersect(string_split(name, ' '), w)))::DOUBLE AS score
FROM d, k WHERE list_contains(w, name) OR len(list_intersect(string_split(name, ' '), w)) > 0"""


def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stage with an answer (here: a user's purchases, else clicks, else all events), summed."""
    events = _t(spark, sf_dir, "events")
    stages = [events.where("event_type = 'purchase' and value > 90"), events.where("event_type = 'click' and value > 50"), events]
    chosen = shapes.cascade([s.select("user_id", "value") for s in stages], "user_id")
    return chosen.groupBy("user_id", "stage").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


CASCADE_SQL = """
WITH s AS (SELECT 0 AS stage, user_id, value FROM events WHERE event_type = 'purchase' AND value > 90
    UNION ALL SELECT 1, user_id, value FROM events WHERE event_type = 'click' AND value > 50 UNION ALL SELECT 2, user_id, value FROM events)
SELECT user_id, stage::BIGINT AS stage, count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT *, min(stage) OVER (PARTITION BY user_id) AS first FROM s) WHERE stage = first GROUP BY ALL"""


def merge_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best distinct candidates of each key from several sources (here: customers' orders by two scores)."""
    orders = _t(spark, sf_dir, "orders")
    first = orders.select("o_custkey", F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("name"), F.round("o_totalprice", -2).alias("score"), F.lit(0).alias("priority"), F.col("o_orderkey").alias("seq"))
    second = first.withColumns({"score": F.round(F.col("score") * 0.9, 2), "priority": F.lit(1)})
    found = shapes.merge_top(first.union(second), "o_custkey", ["kind", "name"])
    return found.select("o_custkey", "rank", "kind", "name", "score", F.col("priority").cast("long").alias("priority"), "seq")


TOPK_SQL = """
WITH f AS (SELECT o_custkey, o_orderpriority AS kind, o_orderstatus AS name, round(o_totalprice, -2) AS score, 0 AS priority, o_orderkey AS seq FROM orders),
u AS (SELECT * FROM f UNION ALL SELECT o_custkey, kind, name, round(score * 0.9, 2), 1, seq FROM f),
o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY o_custkey, kind, name ORDER BY score DESC, priority, seq) = 1)
SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, priority, seq) AS rank, kind, name, score, priority::BIGINT AS priority, seq
FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, priority, seq) <= 8"""


def running_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag from the row on that sets it, and for the whole group (here: purchases of a user)."""
    rows = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return shapes.running_flag(rows, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase").select("event_id", "seen", "any")


FLAG_SQL = """
SELECT event_id, coalesce(bool_or(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS seen,
    coalesce(bool_or(event_type = 'purchase') OVER (PARTITION BY user_id), false) AS any
FROM events"""


def gap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines broken at gaps (here: a user's events more than ten minutes apart)."""
    rows = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    found = shapes.gap_groups(rows, ["user_id"], ["ts", "event_id"], F.timestamp_diff("SECOND", F.col("previous"), F.col("ts")) > 600)
    return found.groupBy("user_id", "line").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


GAP_SQL = """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 601 SECOND THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
l AS (SELECT *, 1 + sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS line FROM g)
SELECT user_id, line::BIGINT AS line, count(*) AS n, min(event_id) AS first_id FROM l GROUP BY ALL"""


def mode_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent value of each key (here: event types of users)."""
    return shapes.mode_value(_t(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])


MODE_SQL = """
WITH c AS (SELECT user_id, event_type, count(*) AS n, min((ts, event_id)) AS f FROM events WHERE event_type IS NOT NULL GROUP BY ALL)
SELECT user_id, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, length(event_type) DESC, f, event_type) = 1"""


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows most similar to each vector whose id is divisible by 20."""
    rows = _t(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return top_similar(queries, rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 5, 4)


VECTOR_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
p AS (SELECT q.vec_id AS query_id, i.vec_id AS id, round(list_dot_product(q.v, i.v), 4) AS similarity FROM u q, u i WHERE q.vec_id % 20 = 0)
SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 5"""


def fuzzy_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar other name of each part's name, if any reaches 70, by the index of names (a test holds it against brute force)."""
    names = _t(spark, sf_dir, "part").select(F.lower("p_name").alias("name"))
    scored = names_similar(names, "name", build_index(names, "name"), 70).where("text <> name")
    return scored.groupBy("name").agg(F.max_by("text", F.struct("similarity", F.lit(0) - F.length("text"), "text")).alias("other"), F.max("similarity").alias("similarity"))


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of the tables."""
    return shapes.table_counts({n: _t(spark, sf_dir, n) for n in TABLES})


TABLES = ["nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
COUNTS_SQL = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in TABLES)


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 95th percentile by class (here: event values by type)."""
    return shapes.latency_summary(_t(spark, sf_dir, "events").select("event_type", "value"), "event_type", "value")


LATENCY_SQL = """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, median(value) AS median, max(value) FILTER (k = greatest(1, n * 95 // 100)) AS p95, count(*) AS n FROM r GROUP BY event_type"""


def regression_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases against expectations: any of the kinds, all of the parts, none of the others (here: labelled documents)."""
    from wayfold.plans.regression import verdict

    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id")
    kinds, parts, others = F.split(F.lit("en|fr"), r"\|"), F.array(F.lit("the")), F.array(F.lit("###"), F.lit("$$$"))
    ok = verdict(F.col("lang"), F.lower("text"), kinds, parts, others)
    return rows.groupBy("quality", "toxic").agg(F.count("*").alias("cases"), F.count_if(ok).alias("passed"))


REGRESSION_SQL = """
SELECT quality, toxic, count(*) AS cases, count(*) FILTER (lang IN ('en', 'fr') AND contains(lower(text), 'the') AND NOT contains(lower(text), '###') AND NOT contains(lower(text), '$$$')) AS passed
FROM documents JOIN labels USING (doc_id) GROUP BY ALL"""

def gazetteer_houses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build of cities, streets and houses, first rows winning (here: nations, brands and order lines)."""
    from wayfold.operators.gazetteer import build_gazetteer

    nations = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    rows = _t(spark, sf_dir, "lineitem").join(nations, F.col("l_suppkey") == F.col("s_suppkey")).join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    house = F.concat_ws("/", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"))
    rows = rows.select(F.col("n_name").alias("city"), F.col("p_brand").alias("street"), house.alias("house"), F.col("l_discount").alias("lat"), F.col("l_tax").alias("lon"), F.struct("l_orderkey", "l_linenumber").alias("seq"))
    g = build_gazetteer(rows)
    named = g.houses.join(g.streets.select("street_id", F.col("name_norm").alias("street")), "street_id").join(g.cities.select("city_id", F.col("name_norm").alias("city")), "city_id")
    return named.select("city", "street", F.col("house_norm").alias("house"), "lat", "lon")


GAZETTEER_SQL = """
WITH r AS (SELECT lower(n_name) AS city, lower(p_brand) AS street, l_linenumber || '/' || l_quantity::INT AS house, l_discount AS lat, l_tax AS lon, l_orderkey, l_linenumber
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)
SELECT city, street, house, lat, lon FROM r QUALIFY row_number() OVER (PARTITION BY city, street, house ORDER BY l_orderkey, l_linenumber, lat, lon) = 1"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "street_centroid": (street_centroid, CENTROID_SQL), "pair_centroid": (pair_centroid, PAIR_SQL), "cooccurrence_pairs": (cooccurrence_pairs, COOCCURRENCE_SQL),
    "pair_best_group": (pair_best_group, BEST_GROUP_SQL), "first_wins_dim": (first_wins_dim, FIRST_SQL), "last_wins_dim": (last_wins_dim, LAST_SQL), "anti_append": (anti_append, ANTI_SQL),
    "nearest_number": (nearest_number, NEAREST_SQL), "exact_then_part": (exact_then_part, EXACT_SQL), "normalise_text": (normalise_text, NORMALISE_SQL),
    "letter_counts": (letter_counts, LETTERS_SQL), "regex_clues": (regex_clues, CLUES_SQL), "keyword_score": (keyword_score, KEYWORD_SQL), "cascade": (cascade, CASCADE_SQL),
    "merge_topk": (merge_topk, TOPK_SQL), "running_flag": (running_flag, FLAG_SQL), "gap_lines": (gap_lines, GAP_SQL), "mode_value": (mode_value, MODE_SQL),
    "vector_topk": (vector_topk, VECTOR_SQL), "fuzzy_best": (fuzzy_best, None), "table_counts": (table_counts, COUNTS_SQL), "latency_summary": (latency_summary, LATENCY_SQL),
    "regression_check": (regression_check, REGRESSION_SQL), "gazetteer_houses": (gazetteer_houses, GAZETTEER_SQL),
}


QUERIES |= place_queries.QUERIES | lookup_queries.QUERIES | image_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
