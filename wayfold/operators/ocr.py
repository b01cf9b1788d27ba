"""Words and rows of recognised images: lines, bands, readings, plates, detections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.clues import plate_repairs, strict_plates
from wayfold.functions.text import normalize, text_score
from wayfold.operators.shapes import gap_groups, mode_value
from wayfold.tables import stored

WORDS = "image_id string, variant int, y double, x double, text string, conf double"


def text_lines(words: DataFrame, least_conf: float = 0.25, least_gap: float = 12.0, share: float = 0.08) -> DataFrame:
    """image_id, variant, line, text, conf: words by height, a new line where the gap to the word before is large."""
    key = ["image_id", "variant"]
    kept = words.where(F.col("conf") >= least_conf)
    span = F.greatest(F.lit(1.0), F.max("y").over(Window.partitionBy(*key)) - F.min("y").over(Window.partitionBy(*key)))
    kept = kept.withColumn("tol", F.greatest(F.lit(least_gap), share * span))
    lined = gap_groups(kept, key, ["y", "x", "text"], F.col("y") - F.col("previous") > F.col("tol"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "text"))), lambda w: w["text"])
    return lined.groupBy(*key, "line").agg(F.array_join(ordered, " ").alias("text"), F.avg("conf").alias("conf"))


def mean_confidence(words: DataFrame) -> DataFrame:
    """Mean of the positive confidences, as whole percents, of each reading; 0 if there is none."""
    c = F.floor("conf")
    return words.groupBy("image_id", "variant").agg(F.coalesce(F.avg(F.when(c > 0, c)), F.lit(0.0)).alias("conf"))


def text_bands(rows: DataFrame, share: float = 0.06, least_ink: float = 30.0, merge: int = 8, height: int = 10, pad: int = 3) -> DataFrame:
    """image_id, top, bottom: runs of inked rows (image_id, y, ink), near ones merged, low ones dropped, padded."""
    floor = F.greatest(share * F.max("ink").over(Window.partitionBy("image_id")), F.lit(least_ink))
    inked = rows.withColumn("floor", floor).where("ink >= floor").select("image_id", "y")
    runs = gap_groups(inked, ["image_id"], ["y"], F.col("y") - F.col("previous") > 1 + merge)
    bands = runs.groupBy("image_id", "line").agg(F.min("y").alias("top"), F.max("y").alias("bottom")).where(F.col("bottom") - F.col("top") + 1 >= height)
    last = rows.groupBy("image_id").agg(F.max("y").alias("last"))
    return bands.join(last, "image_id").select("image_id", F.greatest(F.lit(0), F.col("top") - pad).alias("top"), F.least("last", F.col("bottom") + pad).alias("bottom"))


def best_readings(readings: DataFrame) -> DataFrame:
    """The reading (image_id, variant, text) of each image with the largest score, ties to the smaller variant."""
    scored = readings.withColumn("score", text_score(F.col("text")))
    return scored.groupBy("image_id").agg(F.max_by(F.struct("variant", "text", "score"), F.struct("score", -F.col("variant"))).alias("b")).select("image_id", "b.*")


def merged_lines(lines: DataFrame) -> DataFrame:
    """Lines of an image, the best of equal squeezed text, without those that begin another one.

    A shorter line is dropped wherever a longer one of the same image begins with it, whichever came first.
    Numbers come first, then lines that begin with a street word, then the rest.
    """
    key = F.replace(normalize(F.col("text")), F.lit(" "), F.lit(""))
    best = lines.withColumn("key", key).where("key <> ''").groupBy("image_id", "key").agg(F.max_by("text", F.struct(text_score(F.col("text")), F.col("text"))).alias("text"))
    w = Window.partitionBy("image_id").orderBy("key")
    # In key order whatever begins with a key follows it at once.
    alone = best.withColumn("next", F.lead("key").over(w)).where(F.col("next").isNull() | ~F.startswith("next", "key"))
    low = normalize(F.col("text"))
    order = F.when(low.rlike(r"^\d"), 0).when(low.rlike(r"^ул"), 1).otherwise(2)
    return alone.select("image_id", "text", F.row_number().over(Window.partitionBy("image_id").orderBy(order, "text")).cast("long").alias("line"))


def merged_lines_in_order(lines: DataFrame) -> DataFrame:
    """Like ``merged_lines``, but a line replaces only shorter beginnings that came before it (image_id, seq, text)."""

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        kept: dict[str, str] = {}
        for text in frame.sort_values("seq").text:
            key = "".join((text or "").lower().replace("ё", "е").split())
            if not key:
                continue
            for old in [k for k in kept if key.startswith(k) and k != key]:
                del kept[old]
            if key not in kept or len(text) > len(kept[key]):
                kept[key] = text
        return pd.DataFrame({"image_id": frame.image_id.iloc[0], "text": list(kept.values())})

    return lines.groupBy("image_id").applyInPandas(merge, "image_id string, text string")


def best_plates(readings: DataFrame, regions: DataFrame) -> DataFrame:
    """The plate most readings (image_id, variant, text) of an image agree on, its code repaired by the region table."""
    # Plates are looked for once in each of an image's different texts.
    read = readings.groupBy("image_id", "text").agg(F.min("variant").alias("variant"), F.count("*").alias("times"))
    found = stored(read.select("image_id", "variant", "times", F.posexplode(strict_plates(F.col("text"))).alias("pos", "p")).select("image_id", "variant", "times", "pos", "p.*"))
    best = mode_value(found, "image_id", "plate", ["variant", "pos"], "times")
    codes = found.select("image_id", "plate", "code").distinct()
    tried = best.join(codes, ["image_id", "plate"]).select("image_id", "plate", "code", F.posexplode(plate_repairs(F.col("code"))).alias("nth", "try"))
    known = tried.join(regions.select(F.col("code").alias("try")), "try").groupBy("image_id").agg(F.min_by("try", "nth").alias("region"))
    return best.join(codes, ["image_id", "plate"]).join(known, "image_id", "left").select("image_id", "plate", F.coalesce("region", "code").alias("code"), F.col("region").isNotNull().alias("known"))


def panel_score(area: Column, width: Column, height: Column, fill: Column, image_width: Column, image_height: Column) -> Column:
    """Score of a sign panel's outline: area times filled share, more for usual shapes; -1 for outlines that are no panel."""
    least = F.greatest(0.012 * image_width * image_height, F.lit(600.0))
    shape = width / F.greatest(height, F.lit(1))
    panel = (area > 0) & (width >= 25) & (height >= 18) & (fill >= 0.22) & (area >= least)
    return F.when(panel, area * fill * F.when((shape > 0.2) & (shape < 4.5), 1.25).otherwise(0.75)).otherwise(-1.0)


def recognised(hit: Column, default: float = 0.75) -> Column:
    """(text, conf) of a reader's hit as JSON: [box, text, conf], [box, text], [text, conf] or a text; null if it has none."""
    parts = F.from_json(hit, "array<string>")
    first, number = F.get(parts, 0), lambda c: c.try_cast("double")
    boxed = F.startswith(F.coalesce(first, F.lit("")), F.lit("["))
    text = F.when(boxed, F.get(parts, 1)).otherwise(first)
    conf = F.when(boxed, number(F.get(parts, 2))).otherwise(number(F.get(parts, 1)))
    plain = F.when(F.startswith(F.trim(hit), F.lit('"')), F.regexp_extract(hit, r'^\s*"(.*)"\s*$', 1))
    found = F.coalesce(text, plain)
    return F.when(found.isNotNull(), F.struct(found.alias("text"), F.coalesce(conf, F.lit(default)).alias("conf")))


def crops(detections: DataFrame, images: DataFrame, least: int = 12) -> DataFrame:
    """Boxes (x1, y1, x2, y2) clamped to their image (width, height), without slivers."""
    clamp = lambda c, top: F.greatest(F.lit(0), F.least(F.col(c), F.col(top)))
    kept = detections.join(images.select("image_id", "width", "height"), "image_id")
    kept = kept.withColumns({"x1": clamp("x1", "width"), "x2": clamp("x2", "width"), "y1": clamp("y1", "height"), "y2": clamp("y2", "height")})
    return kept.where((F.col("x2") - F.col("x1") >= least) & (F.col("y2") - F.col("y1") >= least)).drop("width", "height")
