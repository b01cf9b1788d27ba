"""Images as tables of pixels against plain arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfold.operators import images


def table(spark, arrays):
    rows = [(i, x, y, int(v)) for i, a in enumerate(arrays) for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "image_id long, x int, y int, v int")


def best_threshold(a):
    best = (-1.0, 0)
    for t in np.unique(a):
        low, high = a[a <= t], a[a > t]
        if len(high):
            best = max(best, (len(low) * len(high) * (low.mean() - high.mean()) ** 2, -int(t)))
    return -best[1] if best[0] >= 0 else int(a.max())


def test_thresholds_and_black_and_white(spark):
    rng = np.random.default_rng(0)
    arrays = [np.where(rng.random((9, 11)) < 0.3, rng.integers(10, 60, (9, 11)), rng.integers(150, 250, (9, 11))), rng.integers(0, 256, (5, 4)), np.full((3, 3), 7), np.where(rng.random((6, 6)) < 0.8, 20, 200)]
    pixels = table(spark, arrays)
    assert {r.image_id: r.threshold for r in images.otsu(pixels).collect()} == {i: best_threshold(a) for i, a in enumerate(arrays)}
    cut = {(r.image_id, r.x, r.y): r.v for r in images.binarised(pixels).collect()}
    for i, a in enumerate(arrays):
        light = a > best_threshold(a)
        light = ~light if (~light).sum() * 2 > light.size else light
        assert all(cut[i, x, y] == 255 * light[y, x] for (y, x) in np.ndindex(a.shape))
    assert images.binarised(pixels.limit(0)).count() == 0


@pytest.mark.parametrize("clip", [1.0, 3.0, 300.0])
def test_local_contrast(spark, clip):
    rng = np.random.default_rng(1)
    a, tiles = rng.integers(40, 90, (12, 10)), 3
    sizes = spark.createDataFrame([(0, 10, 12)], "image_id long, width int, height int")
    got = {(r.x, r.y): r.v for r in images.equalised(table(spark, [a]), sizes, tiles, clip).collect()}
    ty, tx = np.minimum(np.arange(12) * tiles // 12, tiles - 1), np.minimum(np.arange(10) * tiles // 10, tiles - 1)
    curve = np.zeros((tiles, tiles, 256))
    for j in range(tiles):
        for i in range(tiles):
            n = np.bincount(a[ty == j][:, tx == i].ravel(), minlength=256).astype(float)
            kept = np.minimum(n, max(1.0, clip * n.sum() / 256))
            curve[j, i] = 255 * (np.cumsum(kept) + (n - kept).sum() * np.arange(1, 257) / 256) / n.sum()
    for (y, x), v in np.ndenumerate(a):
        ay, ax = (y + 0.5) * tiles / 12 - 0.5, (x + 0.5) * tiles / 10 - 0.5
        j, i = int(np.floor(ay)), int(np.floor(ax))
        side = lambda k: min(max(k, 0), tiles - 1)
        want = sum(wy * wx * curve[side(jj), side(ii), v] for jj, wy in ((j, 1 - ay + j), (j + 1, ay - j)) for ii, wx in ((i, 1 - ax + i), (i + 1, ax - i)))
        assert got[x, y] == pytest.approx(want)


def areas(mask):
    """Boxes and areas by flooding."""
    left, out = set(zip(*np.nonzero(mask), strict=True)), []
    while left:
        open_, seen = [left.pop()], []
        while open_:
            y, x = open_.pop()
            seen.append((y, x))
            near = {(y + j, x + i) for j in (-1, 0, 1) for i in (-1, 0, 1)} & left
            left -= near
            open_ += near
        ys, xs = zip(*seen, strict=True)
        out.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(seen)))
    return sorted(out)


def test_outlines_equal_flooding(spark):
    rng = np.random.default_rng(2)
    arrays = [rng.random((rng.integers(1, 14), rng.integers(1, 14))) < p for p in (0.2, 0.4, 0.5, 0.6, 0.8) for _ in range(6)] + [np.zeros((3, 3), bool)]
    spiral = np.array([[c == "#" for c in row] for row in ("#######", "......#", "#####.#", "#...#.#", "#.###.#", "#.....#", "#######")])
    arrays.append(spiral)
    found = images.outlines(table(spark, arrays).where("v = 1")).collect()
    for i, a in enumerate(arrays):
        assert sorted((r.x1, r.y1, r.x2, r.y2, r.area) for r in found if r.image_id == i) == areas(a)
    panel = np.zeros((60, 80), bool)
    panel[10:40, 20:70] = True
    panel[45:50, 0:10] = True
    sizes = spark.createDataFrame([(0, 80, 60)], "image_id long, width int, height int")
    best = images.best_panels(images.outlines(table(spark, [panel]).where("v = 1")), sizes).first()
    assert (best.x1, best.y1, best.x2, best.y2, best.area, best.score) == (20, 10, 70, 40, 1500, 1875.0)


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_outlines_of_many_images_share_batches(spark, batch):
    rng = np.random.default_rng(3)
    arrays = [rng.random((9, 8)) < p for p in (0.3, 0.5, 0.7) for _ in range(10)] + [rng.random((40, 60)) < 0.5]
    rows = [(i * 2**40 - 2**44, x - 5, y - 5) for i, a in enumerate(arrays) for (y, x), v in np.ndenumerate(a) if v for _ in range(1 + (x + y) % 2)]
    mask = spark.createDataFrame([*rows, (None, 1, 1), (1, None, 1), (1, 1, None)], "image_id long, x int, y int")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        made = images.outlines(mask)
        assert "InPandas" not in made._jdf.queryExecution().toString()  # a call of Python for each image
        found = made.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = sorted((i * 2**40 - 2**44, x1 - 5, y1 - 5, x2 - 5, y2 - 5, n) for i, a in enumerate(arrays) for x1, y1, x2, y2, n in areas(a))
    assert sorted((r.image_id, r.x1, r.y1, r.x2, r.y2, r.area) for r in found) == want
    assert len({(r.image_id, r.label) for r in found}) == len(found)


def test_areas_end_before_all_runs_are_read():
    runs = [(k // 50, k % 50 * 2, 3, 4) for k in range(5000)]
    read, out, most = 0, 0, 0

    def batches():
        nonlocal read, most
        for at in range(0, len(runs), 100):
            most = max(most, read - out)
            read += 100
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*runs[at : at + 100], strict=True)], ["image_id", "y", "a", "b"])

    for made in images._areas(batches()):
        out += made.num_rows
    assert (out, most) == (5000, 1)


def test_outlines_of_rows_wider_than_a_batch():
    rng = np.random.default_rng(4)
    mask = rng.random((6, 3000)) < 0.4
    runs = [(0, y, int(a), int(b) - 1) for y, row in enumerate(mask) for a, b in np.flatnonzero(np.diff(np.r_[0, row.astype(int), 0])).reshape(-1, 2)]
    for size in (1, 10, 300):
        parts = (pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*runs[at : at + size], strict=True)], ["image_id", "y", "a", "b"]) for at in range(0, len(runs), size))
        made = [r for batch in images._areas(parts) for r in batch.to_pylist()]
        assert sorted((r["x1"], r["y1"], r["x2"], r["y2"], r["area"]) for r in made) == areas(mask)


def test_stages_read_what_is_left(spark):
    asked = spark.range(6).withColumnRenamed("id", "image_id")
    seen = []

    def stage(limit):
        def read(left):
            seen.append(sorted(r.image_id for r in left.collect()))
            return left.select("image_id", (F.col("image_id") <= limit).alias("ok"))

        return read

    out = images.in_stages(asked, [stage(1), stage(3), stage(9), stage(9)], F.col("ok"))
    assert seen == [[0, 1, 2, 3, 4, 5], [2, 3, 4, 5], [4, 5]]
    assert sorted((r.image_id, r.stage) for r in out.where("ok").collect()) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (5, 2)]
