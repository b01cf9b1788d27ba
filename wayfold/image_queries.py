"""Registered queries of images as tables of pixels, over grids made of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import geometry, images


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as an image of eight columns."""
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 300 * F.col("e").cast("double")))).cast("int")
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("pos", "e")).select("image_id", (F.col("pos") % 8).alias("x"), F.floor(F.col("pos") / 8).cast("int").alias("y"), v.alias("v"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), F.ceil(F.size("embedding") / 8).cast("int").alias("height"))


PIXELS = """e AS (SELECT vec_id AS image_id, len(embedding) AS size, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
px AS (SELECT image_id, ceil(size / 8)::INT AS height, pos % 8 AS x, pos // 8 AS y, greatest(0, least(255, floor(128 + 300 * e)))::INT AS v FROM e)"""


def binarised_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels in black and white by each image's own threshold."""
    return images.binarised(_pixels(spark, sf_dir)).select("image_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("v").cast("long").alias("v"))


BINARISED_SQL = f"""WITH {PIXELS}, h AS (SELECT image_id, v, count(*) AS n FROM px GROUP BY ALL),
s AS (SELECT *, (sum(n) OVER w)::BIGINT AS low, (sum(n * v) OVER w)::BIGINT AS low_mass, (sum(n) OVER (PARTITION BY image_id))::BIGINT AS every, (sum(n * v) OVER (PARTITION BY image_id))::BIGINT AS mass FROM h WINDOW w AS (PARTITION BY image_id ORDER BY v ROWS UNBOUNDED PRECEDING)),
t AS (SELECT image_id, v AS threshold FROM s QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN low < every THEN (every * low_mass - low * mass)::DOUBLE * (every * low_mass - low * mass)::DOUBLE / (low * (every - low))::DOUBLE ELSE -1.0 END DESC, v) = 1),
c AS (SELECT px.*, v > threshold AS light FROM px JOIN t USING (image_id)),
d AS (SELECT image_id, 2 * count(*) FILTER (NOT light) > count(*) AS inverted FROM c GROUP BY image_id)
SELECT image_id, x::BIGINT AS x, y::BIGINT AS y, (CASE WHEN light <> inverted THEN 255 ELSE 0 END)::BIGINT AS v FROM c JOIN d USING (image_id)"""


def equalised_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with local contrast, two by two parts an image."""
    made = images.equalised(_pixels(spark, sf_dir), _sizes(spark, sf_dir), tiles=2, clip=40.0)
    return made.select("image_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.round(F.col("v") + 1e-9, 4).alias("v"))


EQUALISED_SQL = f"""WITH {PIXELS}, g AS (SELECT *, least(x * 2 // 8, 1) AS tx, least(y * 2 // height, 1) AS ty FROM px),
h AS (SELECT image_id, tx, ty, v, count(*) AS n FROM g GROUP BY ALL), z AS (SELECT image_id, tx, ty, sum(n)::BIGINT AS size FROM h GROUP BY ALL),
k AS (SELECT h.*, size, least(n::DOUBLE, greatest(1.0, 40.0 * size / 256)) AS kept FROM h JOIN z USING (image_id, tx, ty)),
l AS (SELECT image_id, tx, ty, any_value(size) AS size, sum(n - kept) AS spread FROM k GROUP BY ALL),
m AS (SELECT l.*, r.v, coalesce(k.kept, 0.0) AS kept FROM l CROSS JOIN range(0, 256) AS r(v) LEFT JOIN k ON k.image_id = l.image_id AND k.tx = l.tx AND k.ty = l.ty AND k.v = r.v),
u AS (SELECT image_id, tx, ty, v, 255 * (sum(kept) OVER (PARTITION BY image_id, tx, ty ORDER BY v ROWS UNBOUNDED PRECEDING) + spread * (v + 1) / 256) / size AS to_v FROM m),
p AS (SELECT *, (x + 0.5)::DOUBLE * 2 / 8 - 0.5 AS ax, (y + 0.5)::DOUBLE * 2 / height - 0.5 AS ay FROM px),
q AS (SELECT p.*, i, j, greatest(0, least(1, floor(ax)::INT + i)) AS tx, greatest(0, least(1, floor(ay)::INT + j)) AS ty,
    (CASE i WHEN 0 THEN 1 - (ax - floor(ax)) ELSE ax - floor(ax) END) * (CASE j WHEN 0 THEN 1 - (ay - floor(ay)) ELSE ay - floor(ay) END) AS w FROM p CROSS JOIN range(0, 2) AS a(i) CROSS JOIN range(0, 2) AS b(j))
SELECT image_id, x::BIGINT AS x, y::BIGINT AS y, round(sum(w * to_v) + 1e-9, 4) AS v FROM q JOIN u USING (image_id, tx, ty, v) GROUP BY ALL"""


def image_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected areas of the lighter pixels: boxes and areas (here: of vectors as images)."""
    found = images.outlines(_pixels(spark, sf_dir).where("v >= 128"))
    return found.select("image_id", "x1", "y1", "x2", "y2", "area")


OUTLINES_SQL = f"""WITH RECURSIVE {PIXELS}, k AS (SELECT image_id, x, y, y * 8 + x AS id FROM px WHERE v >= 128),
r AS (SELECT image_id, id AS seed, id, x, y FROM k UNION SELECT r.image_id, r.seed, k.id, k.x, k.y FROM r JOIN k ON k.image_id = r.image_id AND abs(k.x - r.x) <= 1 AND abs(k.y - r.y) <= 1),
c AS (SELECT image_id, id, any_value(x) AS x, any_value(y) AS y, min(seed) AS label FROM r GROUP BY image_id, id)
SELECT image_id, min(x)::BIGINT AS x1, min(y)::BIGINT AS y1, (max(x) + 1)::BIGINT AS x2, (max(y) + 1)::BIGINT AS y2, count(*)::BIGINT AS area FROM c GROUP BY image_id, label"""

def second_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best readings of images, short ones read again in other variants (here: order lines as readings of an order, the status and comments' lengths as texts)."""
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").cast("int").alias("variant"), F.round(F.col("l_discount") * 1000).alias("conf"), "l_partkey", "l_returnflag")
    name = _t(spark, sf_dir, "part").select("p_partkey", "p_name")
    first = lines.select("image_id", "variant", F.when(F.col("l_partkey") % 3 == 0, F.concat("l_returnflag", (F.col("l_partkey") % 100).cast("string"))).otherwise(F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).alias("text"), "conf")
    again = lambda left: lines.join(left, "image_id").join(name, F.col("l_partkey") == F.col("p_partkey")).select("image_id", "variant", F.col("p_name").alias("text"), (F.col("conf") / 2).alias("conf"))
    return images.best_of_variants(first, again).select("image_id", "text", "conf", F.col("score").cast("long").alias("score"))


SCORE = r"""(CASE WHEN length(text) <= 2 THEN 0 ELSE greatest(0, length(regexp_replace(text, '[^\p{L}]', '', 'g')) * 5 + length(regexp_replace(text, '[^\p{Nd}]', '', 'g')) * 2 + length(text) + len(regexp_split_to_array(text, '\s+')) * 12
    + least(6, length(text) - length(replace(text, ' ', ''))) * 2 - CASE WHEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) <= 2 AND len(regexp_split_to_array(text, '\s+')) <= 1 AND length(text) <= 4 THEN 50 ELSE 0 END) END)::BIGINT"""
SECOND_SQL = f"""WITH r AS (SELECT l_orderkey AS image_id, l_linenumber AS variant, round(l_discount * 1000) AS conf, CASE WHEN l_partkey % 3 = 0 THEN l_returnflag || l_partkey % 100 ELSE 'part ' || l_partkey END AS text, p_name FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT *, {SCORE} AS score FROM r),
f AS (SELECT image_id, text, conf, score, 0 AS stage, variant FROM s QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, score DESC, variant, text DESC) = 1),
a AS (SELECT r.image_id, p_name AS text, r.conf / 2 + 35 AS conf, 1 AS stage, r.variant FROM r JOIN f USING (image_id) WHERE length(f.text) <= 4),
g AS (SELECT image_id, text, conf, {SCORE} AS score, stage, variant FROM a),
e AS (SELECT * FROM f UNION ALL SELECT * FROM g WHERE score >= 40)
SELECT image_id, text, conf, score FROM e QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, score DESC, stage, variant, text DESC) = 1"""

def _long(c: str) -> Column:
    return F.col(c).cast("long").alias(c)


def image_skews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skew of the lighter pixels, and whether it is worth a turn (here: of vectors as images that are turned by id)."""
    k = F.col("image_id") % 4
    marked = _pixels(spark, sf_dir).where("v >= 128").select("image_id", (6 * F.col("x") + k * F.col("y")).alias("x"), (6 * F.col("y") - k * F.col("x")).alias("y"))
    found = geometry.skews(marked)
    return found.select("image_id", F.round("angle", 6).alias("angle"), F.round("area", 6).alias("area"), geometry.worth_turning(F.col("angle")).alias("turned"))


SKEWS_SQL = f"""WITH {PIXELS}, m AS (SELECT DISTINCT image_id, 6 * x + (image_id % 4) * y AS x, 6 * y - (image_id % 4) * x AS y FROM px WHERE v >= 128),
n AS (SELECT image_id FROM m GROUP BY image_id HAVING count(*) >= 20),
r AS (SELECT image_id, y, min(x) AS a, max(x) AS b FROM m SEMI JOIN n USING (image_id) GROUP BY ALL), p AS (SELECT image_id, y, a AS x FROM r UNION SELECT image_id, y, b FROM r),
d AS (SELECT DISTINCT p.image_id, q.x - p.x AS dx, q.y - p.y AS dy FROM p JOIN p AS q ON p.image_id = q.image_id AND (p.y, p.x) < (q.y, q.x)),
f AS (SELECT DISTINCT image_id, CASE WHEN abs(dy) > abs(dx) THEN dy ELSE dx END AS dx, CASE WHEN abs(dy) > abs(dx) THEN -dx ELSE dy END AS dy FROM d),
g AS (SELECT image_id, dx, dy, (max(x * dx + y * dy) - min(x * dx + y * dy))::DOUBLE * (max(y * dx - x * dy) - min(y * dx - x * dy))::DOUBLE / (dx * dx + dy * dy) AS area,
    CASE WHEN dy = -dx THEN 1.0 ELSE dy::DOUBLE / dx END AS slope FROM f JOIN p USING (image_id) GROUP BY image_id, dx, dy),
s AS (SELECT image_id, degrees(atan(slope)) AS angle, area FROM g QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY area, abs(slope), slope) = 1)
SELECT image_id, round(angle, 6) AS angle, round(area, 6) AS area, abs(angle) BETWEEN 0.15 AND 12 AS turned FROM s"""


def turned_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels turned by an angle for each image (here: by id), cubic between pixels."""
    sizes = _sizes(spark, sf_dir)
    made = geometry.turned(_pixels(spark, sf_dir), sizes, sizes.select("image_id", (F.col("image_id") % 25 - 12).alias("angle")))
    return made.select("image_id", _long("x"), _long("y"), F.round(F.col("v") + 1e-9, 4).alias("v"))


_CUBIC = "CASE WHEN abs({0}) <= 1 THEN (1.25 * abs({0}) - 2.25) * {0} * {0} + 1 WHEN abs({0}) < 2 THEN ((-0.75 * abs({0}) + 3.75) * abs({0}) - 6) * abs({0}) + 3 ELSE 0.0 END"
TURNED_SQL = f"""WITH {PIXELS}, a AS (SELECT image_id, x, y, v, height, radians(image_id % 25 - 12) AS r FROM px),
s AS (SELECT *, cos(r) * (x - 4) - sin(r) * (y - height // 2) + 4 AS sx, sin(r) * (x - 4) + cos(r) * (y - height // 2) + height // 2 AS sy FROM a),
t AS (SELECT *, floor(sx)::INT + i AS tx, floor(sy)::INT + j AS ty FROM s CROSS JOIN range(-1, 3) AS p(i) CROSS JOIN range(-1, 3) AS q(j)),
w AS (SELECT *, ({_CUBIC.format('(sx - tx)')}) * ({_CUBIC.format('(sy - ty)')}) AS w FROM t),
m AS (SELECT w.image_id, w.x, w.y, sum(w.w * px.v) AS v FROM w JOIN px ON px.image_id = w.image_id AND px.x = greatest(0, least(7, tx)) AND px.y = greatest(0, least(w.height - 1, ty)) GROUP BY ALL)
SELECT image_id, x::BIGINT AS x, y::BIGINT AS y, round(greatest(0.0, least(255.0, v)) + 1e-9, 4) AS v FROM m"""


def upright_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels turned by quarters, as a reader of orientations says (here: by id)."""
    sizes = _sizes(spark, sf_dir)
    made = geometry.quarter_turned(_pixels(spark, sf_dir), sizes, sizes.select("image_id", (F.col("image_id") % 4 * 90).alias("rotate")))
    return made.select("image_id", _long("x"), _long("y"), _long("v"))


UPRIGHT_SQL = f"""WITH {PIXELS} SELECT image_id, v::BIGINT AS v, (CASE image_id % 4 WHEN 0 THEN x WHEN 1 THEN height - 1 - y WHEN 2 THEN 7 - x ELSE y END)::BIGINT AS x,
    (CASE image_id % 4 WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN height - 1 - y ELSE 7 - x END)::BIGINT AS y FROM px"""


def enlarged_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of small images scaled up (here: to a longer side of 12)."""
    made = geometry.enlarged(_pixels(spark, sf_dir), _sizes(spark, sf_dir), 12)
    return made.select("image_id", _long("x"), _long("y"), F.round(F.col("v") + 1e-9, 4).alias("v"))


_SINC = "CASE WHEN {0} = 0 THEN 1.0 WHEN abs({0}) < 3 THEN 3 * sin(pi() * {0}) * sin(pi() * {0} / 3) / (pi() * {0} * pi() * {0}) ELSE 0.0 END"
ENLARGED_SQL = f"""WITH {PIXELS}, z AS (SELECT DISTINCT image_id, 8 AS width, height, 12.0::DOUBLE / greatest(8, height) AS scale FROM px),
g AS (SELECT *, round_even(width * scale, 0)::INT AS nw, greatest(1, round_even(height * scale, 0)::INT) AS nh FROM z WHERE scale > 1),
wx AS (SELECT image_id, tx, fx, {_SINC.format('((tx + 0.5)::DOUBLE * width / nw - 0.5 - fx)')} AS w FROM g CROSS JOIN range(0, 12) AS a(tx) CROSS JOIN range(0, 8) AS b(fx) WHERE tx < nw),
wy AS (SELECT image_id, ty, fy, {_SINC.format('((ty + 0.5)::DOUBLE * height / nh - 0.5 - fy)')} AS w FROM g CROSS JOIN range(0, 12) AS a(ty) CROSS JOIN range(0, 12) AS b(fy) WHERE ty < nh AND fy < height),
h AS (SELECT px.image_id, tx, px.y, sum(w * v) / sum(w) AS v FROM px JOIN wx ON px.image_id = wx.image_id AND px.x = fx GROUP BY ALL),
k AS (SELECT h.image_id, tx AS x, ty AS y, sum(w * v) / sum(w) AS v FROM h JOIN wy ON h.image_id = wy.image_id AND h.y = fy GROUP BY ALL)
SELECT image_id, x::BIGINT AS x, y::BIGINT AS y, round(greatest(0.0, least(255.0, v)) + 1e-9, 4) AS v FROM k
UNION ALL SELECT image_id, x::BIGINT, y::BIGINT, round(v + 1e-9, 4) FROM px JOIN z USING (image_id) WHERE scale <= 1"""

QUERIES = {
    "image_skews": (image_skews, SKEWS_SQL), "turned_images": (turned_images, TURNED_SQL), "upright_images": (upright_images, UPRIGHT_SQL), "enlarged_images": (enlarged_images, ENLARGED_SQL),
    "second_readings": (second_readings, SECOND_SQL),
    "binarised_images": (binarised_images, BINARISED_SQL), "equalised_images": (equalised_images, EQUALISED_SQL), "image_outlines": (image_outlines, OUTLINES_SQL),
}
