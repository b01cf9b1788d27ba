"""Images as tables of pixels (image_id, x, y, v with v from 0 to 255): thresholds, local contrast, outlines, readings in stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.text import text_score
from wayfold.operators.ocr import panel_score
from wayfold.operators.shapes import gap_groups
from wayfold.tables import stored

OUTLINE = "image_id long, label long, x1 long, y1 long, x2 long, y2 long, area long"


def otsu(pixels: DataFrame) -> DataFrame:
    """image_id, threshold: the value that parts an image's pixels into two classes of the largest variance between them.

    From a histogram (256 rows an image at most) by running sums; the smallest value at ties, the only one if there is no other.
    """
    histogram = pixels.groupBy("image_id", "v").agg(F.count("*").alias("n"))
    so_far, whole = Window.partitionBy("image_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("image_id")
    mass = F.col("n") * F.col("v")
    sums = histogram.select("image_id", "v", F.sum("n").over(so_far).alias("low"), F.sum(mass).over(so_far).alias("low_mass"), F.sum("n").over(whole).alias("all"), F.sum(mass).over(whole).alias("all_mass"))
    apart = (F.col("all") * F.col("low_mass") - F.col("low") * F.col("all_mass")).cast("double")
    between = F.when(F.col("low") < F.col("all"), apart * apart / (F.col("low") * (F.col("all") - F.col("low"))).cast("double")).otherwise(-1.0)
    return sums.groupBy("image_id").agg(F.max_by("v", F.struct(between, -F.col("v"))).alias("threshold"))


def binarised(pixels: DataFrame) -> DataFrame:
    """Pixels as 0 or 255 by their image's threshold; images that come out mostly dark are inverted (dark text on light)."""
    cut = pixels.join(otsu(pixels), "image_id").withColumn("light", F.col("v") > F.col("threshold"))
    dark = cut.groupBy("image_id").agg((2 * F.count_if(~F.col("light")) > F.count("*")).alias("inverted"))
    return cut.join(dark, "image_id").select("image_id", "x", "y", F.when(F.col("light") != F.col("inverted"), 255).otherwise(0).alias("v"))


def equalised(pixels: DataFrame, images: DataFrame, tiles: int = 8, clip: float = 2.5) -> DataFrame:
    """Pixels with local contrast: each of tiles x tiles parts of an image (width, height) has its own curve, pixels lie between four of them.

    A part's curve is the running sum of its histogram, no value counting for more than ``clip`` times the mean; what is cut off
    is spread over all 256 values.  Curves have 256 rows a part, and meet pixels in a join on image, part and value.
    """
    placed = pixels.join(images.select("image_id", "width", "height"), "image_id")
    side = lambda c, size: F.least(F.floor(F.col(c) * tiles / F.col(size)), F.lit(tiles - 1)).cast("int")
    histogram = placed.groupBy("image_id", side("x", "width").alias("tx"), side("y", "height").alias("ty"), "v").agg(F.count("*").alias("n"))
    part = ["image_id", "tx", "ty"]
    sizes = histogram.groupBy(*part).agg(F.sum("n").alias("size"))
    cut = histogram.join(sizes, part).withColumn("most", F.greatest(F.lit(1.0), clip * F.col("size") / 256)).withColumn("kept", F.least(F.col("n").cast("double"), F.col("most")))
    left = cut.groupBy(*part).agg(F.first("size").alias("size"), F.sum(F.col("n") - F.col("kept")).alias("spread"))
    every = left.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(255)))).join(cut.select(*part, F.col("v").cast("int").alias("v"), "kept"), [*part, "v"], "left")
    run = F.sum(F.coalesce("kept", F.lit(0.0))).over(Window.partitionBy(*part).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    curves = every.select(*part, "v", (255 * (run + F.col("spread") * (F.col("v") + 1) / 256) / F.col("size")).alias("to"))

    def sides(c: str, size: str) -> Column:
        """(part, weight) of the two parts beside a pixel, those beyond an edge taken for the one at it."""
        at = (F.col(c) + 0.5) * tiles / F.col(size) - 0.5
        low, share = F.floor(at), at - F.floor(at)
        inside = lambda k: F.least(F.greatest(k, F.lit(0)), F.lit(tiles - 1)).cast("int")
        return F.array(F.struct(inside(low).alias("t"), (1 - share).alias("w")), F.struct(inside(low + 1).alias("t"), share.alias("w")))

    spread = placed.select("image_id", "x", "y", F.col("v").cast("int").alias("v"), F.explode(sides("x", "width")).alias("a"), sides("y", "height").alias("b"))
    spread = spread.select("image_id", "x", "y", "v", "a", F.explode("b").alias("b")).select("image_id", "x", "y", "v", F.col("a.t").alias("tx"), F.col("b.t").alias("ty"), (F.col("a.w") * F.col("b.w")).alias("w"))
    met = spread.join(curves, [*part, "v"])
    return met.groupBy("image_id", "x", "y").agg(F.sum(F.col("w") * F.col("to")).alias("v"))


def _touching(image: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a run (from a to b) and one of the row above that it touches, corners too; runs come by image, y and a."""
    row = np.cumsum(np.r_[False, (image[1:] != image[:-1]) | (y[1:] != y[:-1])])
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    follows = np.r_[False, (image[first[1:]] == image[first[:-1]]) & (y[first[1:]] == y[first[:-1]] + 1)]
    below = np.flatnonzero(follows[row])
    # Columns by their order, so that row and column fit one number.
    span = 4 * len(y)
    low, start, end, high = np.unique(np.concatenate([a - 1, a, b, b + 1]), return_inverse=True)[1].reshape(4, -1)
    above = (row[below] - 1) * span
    left, right = np.searchsorted(row * span + end, above + low[below]), np.searchsorted(row * span + start, above + high[below], "right")
    times = right - left
    return np.repeat(below, times), np.repeat(left - np.cumsum(times) + times, times) + np.arange(times.sum())


def _united(one: np.ndarray, other: np.ndarray, size: int) -> np.ndarray:
    """The smallest of ``size`` nodes that each is linked with, itself included."""
    up = np.arange(size)
    while True:
        x, z = up[one], up[other]
        apart = x != z
        if not apart.any():
            return up
        one, other = one[apart], other[apart]
        np.minimum.at(up, np.maximum(x, z)[apart], np.minimum(x, z)[apart])
        while (up[up] != up).any():
            up = up[up]


def _areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """OUTLINE of runs (image_id, y, a, b) that come by image, y and a, all images of a batch at once.

    Beside a batch (or batches of as many runs as are held) only the last two rows before it are held, and the areas that these
    belong to.
    """
    merge = (np.minimum, np.minimum, np.minimum, np.minimum, np.maximum, np.maximum, np.add)
    names = [c.split()[0] for c in OUTLINE.split(", ")]
    whole = lambda rows: pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names)
    near, open_, last, seen, waiting = np.empty((5, 0), np.int64), np.empty((7, 0), np.int64), None, 0, []
    for batch in chain(batches, [None]):
        waiting += [] if batch is None else [batch]
        size = sum(w.num_rows for w in waiting)
        # Runs that are held are looked at again, so as many new ones should come with them.
        if not size or (batch is not None and size < near.shape[1]):
            continue
        image, y, a, b = (c.to_numpy().astype(np.int64) for c in pa.Table.from_batches(waiting).columns)
        waiting = []
        first = np.flatnonzero(np.r_[True, image[1:] != image[:-1]])
        label = np.arange(size) - np.repeat(first, np.diff(first, append=size))
        label[image == last] += seen
        last, seen = image[-1], label[-1] + 1
        known = np.hstack([open_, [image, label, a, y, b + 1, y + 1, b - a + 1]])
        runs = np.hstack([near, [image, y, a, b, open_.shape[1] + np.arange(size)]])
        one, other = _touching(*runs[:4])
        root, group = np.unique(_united(runs[4, one], runs[4, other], known.shape[1]), return_inverse=True)
        order = np.argsort(group, kind="stable")
        found = np.stack([f.reduceat(c, np.searchsorted(group[order], np.arange(len(root)))) for f, c in zip(merge, known[:, order], strict=True)])
        near = runs[:, (runs[0] == last) & (runs[1] >= y[-1] - 1)]
        still, near[4] = np.unique(group[near[4]], return_inverse=True)
        open_ = found[:, still]
        yield whole(np.delete(found, still, axis=1))
    yield whole(open_)


def outlines(mask: DataFrame) -> DataFrame:
    """OUTLINE of each connected area of a mask's pixels (image_id, x, y), corners touching too; the label is its first run.

    Pixels become runs of a row (windows); runs, far fewer, are sorted by image and row and united where they touch a run of
    the row above, many images or a part of one at once.  Pixels without an image or a place take no part.
    """
    once = mask.select("image_id", "y", "x").dropna().distinct()
    lined = gap_groups(once, ["image_id", "y"], ["x"], F.col("x") - F.col("previous") > 1)
    runs = lined.groupBy("image_id", "y", "line").agg(F.min("x").alias("a"), F.max("x").alias("b")).select("image_id", "y", "a", "b")
    return runs.repartition("image_id").sortWithinPartitions("image_id", "y", "a").mapInArrow(_areas, OUTLINE)


def best_panels(found: DataFrame, images: DataFrame) -> DataFrame:
    """The outline of each image (width, height) with the best score as a sign's panel; images without a panel have none."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    score = panel_score(F.col("area"), w, h, F.col("area") / (w * h), F.col("width"), F.col("height"))
    scored = found.join(images.select("image_id", "width", "height"), "image_id").withColumn("score", score).where("score > 0")
    best = F.max_by(F.struct("label", "x1", "y1", "x2", "y2", "area", "score"), F.struct("score", -F.col("label"))).alias("b")
    return scored.groupBy("image_id").agg(best).select("image_id", "b.*")


def in_stages(asked: DataFrame, stages: list[Callable[[DataFrame], DataFrame]], enough: Column) -> DataFrame:
    """Readings of images (image_id), stage by stage: a stage reads only those that no stage before has read well ``enough``.

    Ends when no image is left.  Adds stage (from 0).
    """
    found, left = [], stored(asked.select("image_id").distinct())
    for n, read in enumerate(stages):
        rows = stored(read(left).withColumn("stage", F.lit(n).cast("long")))
        found.append(rows)
        if n + 1 < len(stages):
            left = stored(left.join(rows.where(enough).select("image_id").distinct(), "image_id", "left_anti"))
            if left.isEmpty():
                break
    return reduce(DataFrame.unionByName, found)


def best_of_variants(readings: DataFrame, again: Callable[[DataFrame], DataFrame], short: int = 4, bonus: float = 35.0, least: int = 40) -> DataFrame:
    """image_id, text, conf, score: the reading (image_id, variant, text, conf) with the largest confidence, then score.

    Images whose best reading has at most ``short`` characters are read ``again`` (a function of their ids); such a reading
    counts from a score of ``least`` on, with ``bonus`` added to its confidence.  Ties stay with the earlier stage, the smaller variant, the larger text.
    """
    def scored(rows: DataFrame) -> DataFrame:
        return rows.where("text <> ''").withColumn("score", text_score(F.col("text")))

    def first(_: DataFrame) -> DataFrame:
        order = F.struct("conf", "score", -F.col("variant"), "text")
        return scored(readings).groupBy("image_id").agg(F.max_by(F.struct("text", "conf", "score", "variant"), order).alias("b")).select("image_id", "b.*")

    def second(left: DataFrame) -> DataFrame:
        return scored(again(left)).where(F.col("score") >= least).withColumn("conf", F.col("conf") + bonus).select("image_id", "text", "conf", "score", "variant")

    # Images without any reading are not read again.
    every = in_stages(first(readings), [first, second], F.length(F.trim("text")) > short)
    order = F.struct("conf", "score", -F.col("stage"), -F.col("variant"), "text")
    return every.groupBy("image_id").agg(F.max_by(F.struct("text", "conf", "score"), order).alias("b")).select("image_id", "b.*")
